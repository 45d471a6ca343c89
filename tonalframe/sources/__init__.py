"""Readers of the driver tables and the shared scratch folder."""
