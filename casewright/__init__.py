"""Casewright: document-evidence analytics on Spark DataFrames."""
