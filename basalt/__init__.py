"""A SQL analytics engine on PySpark: a small dialect front end, DataFrame operators and versioned tables."""
