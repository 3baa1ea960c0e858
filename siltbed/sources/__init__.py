"""Inputs: the driver tables as logs and key-value tables, and a persistent store of sorted runs."""
