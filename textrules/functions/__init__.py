"""Column expressions: text, page and matching functions that stay inside the JVM."""
