"""Spark jobs over segmentation rasters and over training-data tables."""
