"""Column expressions: polynomials, data types and operator costs."""
