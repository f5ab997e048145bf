"""Column expressions; none of them uses a Python UDF."""
