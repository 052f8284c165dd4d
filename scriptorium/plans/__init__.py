"""Registered queries and whole runs."""

from scriptorium.plans import queries, survey  # noqa: F401  (survey adds its queries to those of `queries`)
