"""Registered plans: operators applied to the given tables."""
