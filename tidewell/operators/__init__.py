"""Operators over typed tables of series, events, configurations and signals."""
