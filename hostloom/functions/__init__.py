"""Column expressions: addresses, roles, labels and small arithmetic helpers."""
