"""Spark-native analytics for volumes, voxel graphs and neuron trees."""
