"""Diagnosis and repair of damaged Arabic text as DataFrame transformations."""

__version__ = "0.1.0"
