"""meshframe: analytics over unstructured meshes as Spark DataFrames."""

__version__ = "0.1.0"
