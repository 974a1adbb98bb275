"""Operators of a large-scale training-data pipeline (nothing else imports this)."""
