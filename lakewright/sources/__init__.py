"""Readers: relational sources, generated rows, job metrics, logs, file listings."""
