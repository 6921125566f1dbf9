"""Name -> query and name -> SQL oracle of every operator outside the llm subpackage."""

from __future__ import annotations

from . import detection_queries, fusion_queries, quality_queries, source_queries, spatial_queries, streaming_queries

QUERIES: dict = {}
ORACLES: dict = {}
for _part in (detection_queries, fusion_queries, quality_queries, source_queries, spatial_queries, streaming_queries):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
