"""Graphloom streaming."""
