"""Catalog pages to rows, as Spark jobs."""
