"""Registered queries and their SQL oracles, one module per area."""
