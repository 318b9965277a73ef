"""Sufficient statistics kept over streams."""
