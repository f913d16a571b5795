"""Graphloom operators."""
