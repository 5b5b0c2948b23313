"""Operators on point catalogs: pairs, counts, two- and three-point statistics."""
