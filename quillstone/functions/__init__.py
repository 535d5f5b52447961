"""SPARQL values and functions as Spark columns."""
