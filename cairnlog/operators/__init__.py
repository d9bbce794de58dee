"""DataFrame operators: search, projection, counting, percentiles, anomalies, alerts."""
