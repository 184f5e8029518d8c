"""Subpackage of lodegraph."""
