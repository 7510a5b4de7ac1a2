"""Registered queries: each operator on the given tables, with an independent SQL statement."""

from catalog import abundance, exposure, posterior

MODULES = (abundance, exposure, posterior)
