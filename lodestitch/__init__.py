"""lodestitch: record linkage and master-data resolution as Spark DataFrame operators."""
