"""Column-level building blocks; everything here stays inside generated JVM code."""
