"""Importing this registers every query."""

from manifoldry.plans import q_geometry, q_order, q_pairs, q_scalars, q_sources, q_tables  # noqa: F401
