"""Structured Streaming jobs: incremental index, trace extraction, bounded history."""
