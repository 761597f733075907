"""Registered queries and their SQL twins."""

from . import aggregates, core, models, tables, whole  # noqa: F401
