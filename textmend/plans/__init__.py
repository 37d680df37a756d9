"""Composed plans: diagnosis and the repair ladder."""
