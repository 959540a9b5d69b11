"""Retail operators as DataFrame-to-DataFrame functions."""
