"""Text-to-time alignment and ordered-record analytics on PySpark DataFrames."""
