"""From raw documents to packed training sequences, in five stages.

Each stage works on all that the one before kept, written as Parquet and reread:

1. toxicity: documents that the lexicon model scores at 0.5 or more go;
2. simhash: of each component of near copies (five-word shingles alike to 0.8 or more, each link verified) the
   document with the smallest doc_id stays; candidates are fingerprints linked by vantage-point trees and, beyond
   their radius, min-hash bands (see near_copies);
3. suffix_array: bytes of 100-byte strings that stand earlier are cut out, at whole characters;
4. mixing: every document stays, those of small sources repeated up to the limit;
5. packing: pieces of at most 2048 tokens in best-fit sequences (columns of op2).

All but the last return the columns of documents.  An empty table gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dossier.llm import mixing, packing, simhash, suffix_dedup, toxicity
from dossier.llm.common import Scratch, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, read(spark, sf_dir, "labels", "doc_id", "toxic"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.strip_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("suffix_array", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither the automaton nor the packing; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    docs, scratch = read(spark, sf_dir, "documents"), Scratch(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.write(docs, name)
    return docs
