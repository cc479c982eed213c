"""Column expressions: everything here runs in the JVM, no Python workers."""
