"""Interpretable fuzzy-rule analytics and classification on PySpark."""
