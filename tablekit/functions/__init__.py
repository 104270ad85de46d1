"""Scalar kernels and aggregate functions."""
