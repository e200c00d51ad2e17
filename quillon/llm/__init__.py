"""Operators for large training-data pipelines. Nothing else in quillon imports this subpackage."""
