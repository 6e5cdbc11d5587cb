"""The queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dossier.llm import chat, embedding_dedup, exact_dedup, lexical_search, mixing, prefix_trie, recompression, suffix_dedup
from dossier.llm.chat import op9_chat
from dossier.llm.embedding_dedup import op6_embeddings
from dossier.llm.exact_dedup import op11_exact_dedup
from dossier.llm.langid import op3_langid
from dossier.llm.lexical_search import op13_lexical_search
from dossier.llm.mixing import op1_mixing
from dossier.llm.packing import op2_packing
from dossier.llm.prefix_trie import op12_prefix_trie
from dossier.llm.quality import op5_quality
from dossier.llm.recompression import op10_recompression
from dossier.llm.simhash import op7_simhash
from dossier.llm.suffix_dedup import op4_suffix_dedup
from dossier.llm.toxicity import op8_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_mixing, op2_packing, op3_langid, op4_suffix_dedup, op5_quality, op6_embeddings, op7_simhash, op8_toxicity, op9_chat, op10_recompression,
        op11_exact_dedup, op12_prefix_trie, op13_lexical_search,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the query; the others are tested against brute force or held-out rows."""
    return {
        "op1_mixing": mixing.ORACLE_SQL,
        "op4_suffix_dedup": suffix_dedup.ORACLE_SQL,
        "op6_embeddings": embedding_dedup.ORACLE_SQL,
        "op9_chat": chat.ORACLE_SQL,
        "op10_recompression": recompression.ORACLE_SQL,
        "op11_exact_dedup": exact_dedup.ORACLE_SQL,
        "op12_prefix_trie": prefix_trie.ORACLE_SQL,
        "op13_lexical_search": lexical_search.ORACLE_SQL,
    }
