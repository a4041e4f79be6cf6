"""Readers (corpus, reports, logs) and sinks (vector tables, report files)."""
