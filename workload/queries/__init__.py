"""One module per group of operators; importing them registers the queries."""

from workload.queries import encoders, features, metrics, models, sources  # noqa: F401
