"""Operators for large-scale training data and for statistics over very many values. Nothing else imports this package."""
