"""Tables, provider files, feature store."""
