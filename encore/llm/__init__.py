"""Operators for preparing training text: ten components, their queries and their SQL."""
