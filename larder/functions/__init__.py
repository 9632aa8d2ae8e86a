"""Column expressions: everything here compiles to JVM-side Spark expressions."""
