"""Relational, spatial and graph operators over report tables."""
