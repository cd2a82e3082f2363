"""Spark-native analytics for trajectories, point clouds and sensor streams."""
