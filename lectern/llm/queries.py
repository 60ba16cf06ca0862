"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.llm.bpe import op13_byte_bpe
from lectern.llm.chat import op1_chat_format
from lectern.llm.dedup import OP9_SQL, op9_exact_dedup
from lectern.llm.mix import op3_mix_sources
from lectern.llm.neardup import op6_ngram_jaccard
from lectern.llm.pack import op7_tiered_packing
from lectern.llm.periodic import OP12_SQL, op12_periodic_runs
from lectern.llm.ranked import OP11_SQL, op11_ranked_search
from lectern.llm.repetition import op8_repetition_rules
from lectern.llm.shard import op2_rendezvous_shards
from lectern.llm.tokens import op10_token_counts
from lectern.llm.toxicity import op4_toxicity
from lectern.llm.urls import op5_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_rendezvous_shards": op2_rendezvous_shards,
    "op3_mix_sources": op3_mix_sources,
    "op4_toxicity": op4_toxicity,
    "op5_url_filter": op5_url_filter,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_tiered_packing": op7_tiered_packing,
    "op8_repetition_rules": op8_repetition_rules,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_token_counts": op10_token_counts,
    "op11_ranked_search": op11_ranked_search,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_byte_bpe": op13_byte_bpe,
}
SQL: dict[str, str] = {"op9_exact_dedup": OP9_SQL, "op11_ranked_search": OP11_SQL, "op12_periodic_runs": OP12_SQL}
