"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm.alignment import op12_alignment
from lodestrata.llm.decontaminate import op10_decontamination
from lodestrata.llm.exact_dedup import OP4_SQL, op4_exact_dedup
from lodestrata.llm.html_extract import op8_html_text
from lodestrata.llm.language import op7_language_id
from lodestrata.llm.minmax_dedup import op9_minhash
from lodestrata.llm.packing import op6_best_fit_packing
from lodestrata.llm.partenum import op13_jaccard_join
from lodestrata.llm.preferences import OP3_SQL, op3_preferences
from lodestrata.llm.prefix_trie import OP11_SQL, op11_prefix_trie
from lodestrata.llm.quality import op2_quality
from lodestrata.llm.sharding import op5_sharding
from lodestrata.llm.sstable import op1_token_shards


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_shards, op2_quality, op3_preferences, op4_exact_dedup, op5_sharding, op6_best_fit_packing, op7_language_id, op8_html_text, op9_minhash, op10_decontamination, op11_prefix_trie, op12_alignment, op13_jaccard_join)}


def oracle_sql() -> dict[str, str]:
    return {"op3_preferences": OP3_SQL, "op4_exact_dedup": OP4_SQL, "op11_prefix_trie": OP11_SQL}
