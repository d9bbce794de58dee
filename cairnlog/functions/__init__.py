"""Column functions: text, numbers, field access, timestamps."""
