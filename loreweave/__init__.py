"""Knowledge-base analytics on Spark DataFrames.

Sub-packages: ``functions`` (column expressions), ``operators`` (DataFrame to
DataFrame), ``sources`` (readers and sinks), ``plans`` (registered queries with
their SQL), ``streaming`` (Structured Streaming jobs).
"""
