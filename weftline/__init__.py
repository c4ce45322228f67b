"""Weftline: a semantic-mapping and data-processing engine written as Spark plans."""
