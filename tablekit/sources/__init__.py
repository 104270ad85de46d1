"""Readers and writers of file formats, unions of files, and JDBC."""
