"""Column expressions: text, attributes, comparison."""
