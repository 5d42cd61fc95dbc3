"""Column expressions and plan-time schema helpers."""
