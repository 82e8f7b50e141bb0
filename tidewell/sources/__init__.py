"""Readers of reports, side signals and diaries, and adapters of the test tables."""
