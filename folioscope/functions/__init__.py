"""Column functions: no row leaves the JVM, everything stays inside one projection."""
