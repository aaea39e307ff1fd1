"""Column functions: 3-vector algebra and ordered lists."""
