"""Column expressions: string normalisation and scoring formulas."""
