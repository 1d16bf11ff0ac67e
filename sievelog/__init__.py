"""A PySpark engine for permission-filtered facts: schemas, logged changes, queries, live views."""
