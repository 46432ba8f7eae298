"""Registered queries over the star-schema and text tables, each with its SQL twin where SQL can express it."""
