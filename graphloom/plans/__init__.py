"""Graphloom plans."""
