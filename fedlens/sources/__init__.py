"""Readers for the driver tables, run logs, and the frames derived from them."""
