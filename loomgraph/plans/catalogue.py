"""Named queries over the driver tables, each with the SQL that checks it where SQL can express it."""

from __future__ import annotations

from . import evaluation_queries, graph_queries, inference_queries, library_queries, stream_queries, survey_queries, text_queries

_PARTS = (graph_queries, inference_queries, evaluation_queries, text_queries, survey_queries, library_queries, stream_queries)
QUERIES = {k: q for p in _PARTS for k, q in p.QUERIES.items()}
ORACLES = {k: q for p in _PARTS for k, q in p.ORACLES.items()}
FLAGSHIP = "motif_census"
