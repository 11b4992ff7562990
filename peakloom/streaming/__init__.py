"""Intentionally empty.

The engine this repository is measured against has no streaming operator
"""
