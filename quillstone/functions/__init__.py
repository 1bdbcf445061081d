"""Subpackage of quillstone."""
