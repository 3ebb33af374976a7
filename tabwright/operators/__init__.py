"""DataFrame operators: cleaning, profiling, features, models, metrics, catalog, logs."""
