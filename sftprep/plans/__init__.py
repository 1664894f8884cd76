"""Whole jobs, composed from the functions and operators."""
