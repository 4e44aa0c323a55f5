"""Operators for preparing training text: one module each, Spark does the moving."""
