"""Quittance: expense-document analytics and training-data preparation on PySpark."""
