"""The registered query of every operator in this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortforge.llm.boosted_quality import op5_quality_trees
from cohortforge.llm.bpe import op9_bpe
from cohortforge.llm.chat_format import op7_chat_format
from cohortforge.llm.chosen_path import op3_chosen_path
from cohortforge.llm.deobfuscate import op1_toxicity
from cohortforge.llm.conversation_trie import OP13_SQL, op13_conversation_trie
from cohortforge.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from cohortforge.llm.id_store import op8_id_store
from cohortforge.llm.language_fusion import op10_language
from cohortforge.llm.lempel_ziv_spans import OP12_SQL, op12_lempel_ziv
from cohortforge.llm.packing import op6_packing
from cohortforge.llm.pii_vote import op4_pii_vote
from cohortforge.llm.posting_lists import op2_posting_lists
from cohortforge.llm.shipping import ship

def _shipped(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(ship(spark), sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _shipped(fn) for name, fn in {
    "op1_toxicity": op1_toxicity,
    "op2_posting_lists": op2_posting_lists,
    "op3_chosen_path": op3_chosen_path,
    "op4_pii_vote": op4_pii_vote,
    "op5_quality_trees": op5_quality_trees,
    "op6_packing": op6_packing,
    "op7_chat_format": op7_chat_format,
    "op8_id_store": op8_id_store,
    "op9_bpe": op9_bpe,
    "op10_language": op10_language,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_lempel_ziv": op12_lempel_ziv,
    "op13_conversation_trie": op13_conversation_trie,
}.items()}

# DuckDB SQL for the queries that SQL can express on whole tables.
ORACLES: dict[str, str] = {"op11_hard_negatives": OP11_SQL, "op12_lempel_ziv": OP12_SQL,
                           "op13_conversation_trie": OP13_SQL}
