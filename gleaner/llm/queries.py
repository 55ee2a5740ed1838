"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm.alignment import op11_gallop_alignment
from gleaner.llm.decontamination import op4_bm25_leaks
from gleaner.llm.fingerprints import op13_improbable_digest
from gleaner.llm.jaccard import op9_count_vector_join
from gleaner.llm.language import op8_language_mixture
from gleaner.llm.neighbours import op10_graph_neighbours
from gleaner.llm.packing import op2_pack_windows
from gleaner.llm.passages import op3_block_anchors
from gleaner.llm.privacy import op5_sanitise_terms
from gleaner.llm.secrets import op7_guess_cost
from gleaner.llm.sharding import op1_shuffle_shards
from gleaner.llm.spelling import op12_variable_grams
from gleaner.llm.substrings import op6_sampled_names

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_shuffle_shards": op1_shuffle_shards,
    "op2_pack_windows": op2_pack_windows,
    "op3_block_anchors": op3_block_anchors,
    "op4_bm25_leaks": op4_bm25_leaks,
    "op5_sanitise_terms": op5_sanitise_terms,
    "op6_sampled_names": op6_sampled_names,
    "op7_guess_cost": op7_guess_cost,
    "op8_language_mixture": op8_language_mixture,
    "op9_count_vector_join": op9_count_vector_join,
    "op10_graph_neighbours": op10_graph_neighbours,
    "op11_gallop_alignment": op11_gallop_alignment,
    "op12_variable_grams": op12_variable_grams,
    "op13_improbable_digest": op13_improbable_digest,
}

#: None of these can be expressed in SQL on whole tables; tests hold them against brute-force versions.
ORACLE_SQL: dict[str, str] = {}
