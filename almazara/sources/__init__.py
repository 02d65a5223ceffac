"""Readers and writers of files and layers."""
