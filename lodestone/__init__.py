"""Corpus search and evidence engine written as DataFrame and Spark SQL operators."""
