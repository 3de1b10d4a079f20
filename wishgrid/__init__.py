"""Bulk free-text property search analytics on Spark: ``DataFrame -> DataFrame`` operators."""
