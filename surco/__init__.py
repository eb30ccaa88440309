"""Crop phenology and crop-progress analytics as Spark DataFrame jobs."""
