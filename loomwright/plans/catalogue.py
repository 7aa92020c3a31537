"""Imports every module that registers queries."""

from loomwright.plans import annotate, changes, filters, groups, joins, media, models, pages, recommend, scalars  # noqa: F401
