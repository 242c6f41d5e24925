"""Structured Streaming: sources and sinks, the amount rule, the anomaly rule, alert views."""
