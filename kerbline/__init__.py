"""Pedestrian-network and corpus analytics expressed as Spark DataFrame jobs."""
