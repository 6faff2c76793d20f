"""Operators on pixel, point and feature tables."""
