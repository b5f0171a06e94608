"""Scene scoring and dataset curation as Spark DataFrame operations."""
