"""Column expressions without any cross-row work."""
