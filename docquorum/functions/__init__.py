"""Column functions. Everything here stays inside Spark expressions."""
