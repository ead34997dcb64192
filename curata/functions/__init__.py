"""Column builders: plain Spark expressions without jobs or shuffles."""
