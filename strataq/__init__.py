"""strataq: Spark-first document-detail analytics."""
