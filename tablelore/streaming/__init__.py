"""Inputs that grow, read a piece at a time."""
