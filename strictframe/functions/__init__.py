"""Typed column functions."""
