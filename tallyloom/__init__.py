"""Spark-native analytics for statement text: parsing, linkage, enrichment, validation."""
