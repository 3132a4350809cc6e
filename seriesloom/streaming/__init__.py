"""Windowed aggregation of event streams; the same functions take batch and streaming frames."""
