"""Feature sets, models and searches composed from the operators."""
