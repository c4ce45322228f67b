"""The queries of the engine's own operators, and SQL that gives the same rows."""

from __future__ import annotations

from weftline.queries import building, catalog, claims, graphs, identities, interpretation, mapping, patterns, search, stores, streams, studies, written  # noqa: F401
from weftline.queries.base import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "vocab_resolve_stage"
