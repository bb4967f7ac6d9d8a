"""Column expressions: everything here is built-in functions only and stays on the JVM."""
