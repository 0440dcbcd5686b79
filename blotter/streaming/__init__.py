"""Structured Streaming form of the cleaning flow (raw CSV files as they arrive -> layer)."""
