"""Evidence analytics on Spark: retrieval, governance and evaluation as DataFrame operators."""
