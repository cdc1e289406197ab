"""Registered queries and the SQL they are checked against."""

from __future__ import annotations

from hydromelt.catalog import cells, dictionary, folders, mapping, measures, reviewing, streams

_TOPICS = (measures, cells, mapping, folders, dictionary, reviewing, streams)

QUERIES = {name: fn for topic in _TOPICS for name, fn in topic.query.queries.items()}
ORACLES = {name: sql for topic in _TOPICS for name, sql in topic.query.oracles.items()}
