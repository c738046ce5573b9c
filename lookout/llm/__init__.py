"""Operators for training-data pipelines on text; nothing outside this subpackage imports it."""
