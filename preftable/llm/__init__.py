"""Operators for large-scale training-data pipelines, their queries and SQL (nothing else imports this)."""
