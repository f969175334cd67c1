"""Operators on cubes and samples."""
