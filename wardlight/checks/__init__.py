"""Derived report tables over the supplied data, registered queries and their SQL twins."""
