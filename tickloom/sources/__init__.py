"""Readers of the tables and files that the operators work on."""
