"""Column expressions used by the operators; all of them stay inside the JVM."""
