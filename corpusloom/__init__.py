"""Corpus analytics as Spark DataFrame functions.

Every operator takes and returns DataFrames (or builds a Column), so Catalyst sees the whole plan.
Packages: ``functions`` (column builders), ``sources`` (readers and sinks), ``operators`` (DataFrame to DataFrame),
``streaming`` (Structured Streaming jobs) and ``plans`` (queries over the driver tables).
"""

__version__ = "0.1.0"
