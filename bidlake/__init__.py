"""Procurement analytics on Spark: DataFrame-to-DataFrame operators, sources, plans and streams."""
