"""Binds every analysis to the tables of a dataset directory."""
