"""Whole runs: scanning libraries into the catalog, and packaging it as a site."""
