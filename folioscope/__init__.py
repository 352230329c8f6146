"""Batch and streaming Spark operators for collections of posts, articles and pages."""

__version__ = "0.1.0"
