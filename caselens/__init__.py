"""Process-conformance analytics over event logs and deviation tables, as Spark DataFrame operators."""
