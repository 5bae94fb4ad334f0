"""quillspark: catalogue queries, text search and corpus preparation as Spark jobs."""
