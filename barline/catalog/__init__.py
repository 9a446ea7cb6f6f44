"""Registered queries: each operator run over the driver tables, with its SQL."""
