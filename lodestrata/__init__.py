"""lodestrata: a Spark-first engine for slide-conversion planning and corpus preparation."""
