"""All registered queries."""

from . import contexts, drafting, profiles, reviewing  # noqa: F401
from .tables import QUERIES

__all__ = ["QUERIES"]
