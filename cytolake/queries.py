"""All queries of the library; importing the modules registers them."""

from __future__ import annotations

from cytolake.plans import provenance_queries as _provenance  # noqa: F401
from cytolake.operators import (  # noqa: F401
    catalog_queries as _catalog,
    expression_queries as _expression,
    fulltext_queries as _fulltext,
    graph_queries as _graph,
    ingest_queries as _ingest,
    metadata_queries as _metadata,
    qc_queries as _qc,
    retrieval_queries as _retrieval,
    stats_queries as _stats,
)
from cytolake.registry import QUERIES, SQL, Query
from cytolake.sources import file_queries as _files, source_queries as _sources  # noqa: F401
from cytolake.streaming import event_queries as _events  # noqa: F401


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
