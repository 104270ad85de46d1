"""Incremental reading of files that keep arriving."""
