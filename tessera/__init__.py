"""Mesh, point-cloud and sequence analytics expressed as Spark DataFrame plans."""
