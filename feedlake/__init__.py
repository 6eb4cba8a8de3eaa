"""feedlake: content-recommendation analytics expressed as Spark jobs."""
