"""Streaming anomaly detection and sequence prediction over DataFrames."""
