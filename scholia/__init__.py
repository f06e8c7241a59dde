"""Scholia: study analytics and document-corpus operators on Spark DataFrames."""
