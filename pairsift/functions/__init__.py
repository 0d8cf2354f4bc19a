"""Column expressions: every function here maps Columns (or a DataFrame's columns) to Columns."""
