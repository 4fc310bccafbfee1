"""DataFrame in, DataFrame out: states, encoders, metrics, calibration, matching, reports."""
