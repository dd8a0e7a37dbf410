"""Registered queries of this subpackage, each over its whole table, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pregame.llm.collocations import OP11_SQL, op11_phrase_collocations
from pregame.llm.decontaminate import op8_decontamination
from pregame.llm.divergence import OP13_SQL, op13_quality_rules
from pregame.llm.jaccard_join import op1_jaccard_join
from pregame.llm.language_id import op4_language_id
from pregame.llm.neighbours import op2_nearest_neighbours
from pregame.llm.packing import op7_best_fit_packing
from pregame.llm.pii import op6_pii
from pregame.llm.quality import op10_quality
from pregame.llm.secret_scan import op5_secret_scan
from pregame.llm.token_counts import op3_token_counts
from pregame.llm.toxicity import op9_toxicity
from pregame.llm.whitening import op12_embedding_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_nearest_neighbours": op2_nearest_neighbours,
    "op3_token_counts": op3_token_counts,
    "op4_language_id": op4_language_id,
    "op5_secret_scan": op5_secret_scan,
    "op6_pii": op6_pii,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_decontamination": op8_decontamination,
    "op9_toxicity": op9_toxicity,
    "op10_quality": op10_quality,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_quality_rules": op13_quality_rules,
}

#: The other queries of this subpackage have no oracle SQL: models, hashes, tokenizers and iterations have none, and the
#: joins are too slow in SQL on whole tables. They are tested against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {"op11_phrase_collocations": OP11_SQL, "op13_quality_rules": OP13_SQL}
