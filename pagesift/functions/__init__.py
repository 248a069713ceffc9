"""Column expressions: scalar functions and predicates. None uses a Python UDF."""
