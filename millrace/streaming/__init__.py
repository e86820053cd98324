"""Millrace streaming."""
