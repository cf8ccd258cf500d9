"""Queries offered to the driver, each with the SQL that checks it."""
