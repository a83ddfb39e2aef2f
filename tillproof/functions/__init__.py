"""Column -> Column functions. All stay inside the JVM; there is no Python UDF."""
