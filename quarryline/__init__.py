"""quarryline: reusable PySpark jobs, written as functions from DataFrame to DataFrame."""
