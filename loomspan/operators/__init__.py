"""Relational and interval operators as DataFrame functions."""
