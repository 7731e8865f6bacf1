"""Column expressions and small aggregates that several operators use."""
