"""Product-feed enrichment as Spark jobs: every step maps DataFrames to DataFrames."""
