"""Catalogue matching, price comparison and corpus preparation as Spark jobs."""
