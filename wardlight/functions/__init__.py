"""Column expressions: geometry, text, scoring and display."""
