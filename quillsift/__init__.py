"""Screening analytics and text preparation on PySpark DataFrames."""
