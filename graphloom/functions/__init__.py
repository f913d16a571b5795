"""Graphloom functions."""
