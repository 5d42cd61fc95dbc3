"""Reusable shapes of plans: wide-to-long, exact quantiles, row positions."""
