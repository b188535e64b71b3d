"""A pipeline over `documents`: language ID, toxicity, near-duplicates, decontamination, encoding.

Every stage reads what the one before has written, and its decisions take effect:
all but the last return the columns of `documents`.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptlake.llm import bpe, decontaminate, langid, similar, toxicity
from promptlake.llm.base import apart, held_out, hidden, stored, table
from promptlake.session import ship_package


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that the corpus's labels teach; `source` stands for the host."""
    ship_package(spark)
    name = hidden(docs, "language__")
    told = langid.identify(docs, langid.train(docs), host="source", as_column=name)
    return told.where(F.col(name)["accepted"]).select(docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose toxicity is 0.5 or more."""
    ship_package(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out(0, 5))
    name = hidden(docs, "toxicity__")
    return toxicity.score(docs, model, as_column=name).where(F.col(name) < 0.5).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near copies: that with the smallest id, then the smallest digests of text and row.

    Candidates come by SimHash fingerprints and, beyond their reach, by MinHash bands; near copies have a Jaccard similarity
    of 0.8 or more in shingles of five words. Rows without an id come last.
    """
    ship_package(spark)
    place = F.struct(F.isnull("doc_id").alias("none"), "doc_id", F.sha2("text", 256).alias("text"), F.xxhash64(*docs.columns).alias("row"))
    groups = stored(similar.near_copies(docs.select("doc_id", "text", place.alias("place__")), shingle=5, least=0.8).select("copy_of", "place__"), "pipeline-copies")
    kept = groups.groupBy("copy_of").agg(F.min("place__").alias("place__")).select("place__.*")
    text, row = hidden(docs, "text__"), hidden(docs, "row__")
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"k.{c}")) for c in ("doc_id", text, row)]
    told = docs.withColumns({text: F.sha2("text", 256), row: F.xxhash64(*docs.columns)}).alias("d")
    one = told.join(apart(kept.select("doc_id", F.col("text").alias(text), F.col("row").alias(row))).alias("k"), reduce(and_, same), "left_semi")
    # what is left of a group are equal rows
    return one.dropDuplicates(["doc_id", text, row]).select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of whose words at least five in a hundred are the benchmark's."""
    ship_package(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of each kept document."""
    ship_package(spark)
    coded = bpe.round_trip(docs.select("doc_id", "text", "lang", "source"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", "lang", "source", "coded.n_tokens", "coded.ids_sha256", "coded.decoded_sha256")


STAGES = [
    ("language_id", language),
    ("toxicity", toxic),
    ("simhash", near_duplicates),
    ("decontamination", decontaminated),
    ("bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained model, fingerprints and byte-pair merges have no form in SQL.
ORACLE_SQL = None


__all__ = ["ORACLE_SQL", "STAGES", "run"]
