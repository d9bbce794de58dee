"""Structured Streaming forms of tail, counters, anomaly scoring and alert rules."""
