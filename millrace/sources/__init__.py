"""Millrace sources."""
