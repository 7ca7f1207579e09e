"""Registered queries: every operator over the whole driver tables (or, where the tables hold no such data, over small literals)."""
