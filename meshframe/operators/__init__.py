"""Mesh operators: functions from MeshFrames and DataFrames to DataFrames."""
