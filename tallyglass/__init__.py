"""Tallyglass: DataFrame jobs for the data that language-model systems leave behind."""

__version__ = "0.1.0"
