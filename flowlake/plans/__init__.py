"""Reusable plan shapes and the jobs composed from them."""
