"""Image-phenotyping analytics on Spark: catalogue, pixel and feature tables as DataFrame operators."""
