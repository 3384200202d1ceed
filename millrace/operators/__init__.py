"""Millrace operators."""
