"""Importing this module registers every query."""

from shorelark.plans import (  # noqa: F401
    calendar_queries,
    conditions_queries,
    findings_queries,
    places_queries,
    source_queries,
    stream_queries,
    text_queries,
)
