"""Registered queries over the tables of a folder, each with its SQL."""
