"""Shot analytics on Spark: features, models, calibration and evaluation as DataFrame plans."""
