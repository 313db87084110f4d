"""Column expressions: scalar functions, special functions, age distributions."""
