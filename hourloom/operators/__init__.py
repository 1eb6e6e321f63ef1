"""Relational building blocks: cleaning, grids, windows, ranks, profiles."""
