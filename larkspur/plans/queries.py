"""All registered queries of the moderation and support engine."""

from . import access, moderation, reports, similarity, support  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
