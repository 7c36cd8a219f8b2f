"""Column functions: masks, text helpers and JSON helpers. All of them stay on the JVM side."""
