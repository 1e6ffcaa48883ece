"""Iterative algorithms, criteria and minimisers."""
