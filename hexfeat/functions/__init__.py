"""Column expressions: scalar formulas and the hexagonal grid."""
