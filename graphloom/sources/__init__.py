"""Graphloom sources."""
