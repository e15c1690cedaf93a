"""A training corpus in five stages: language ID, line dedup, near-dedup, mixing to target weights, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwork.llm import _common, language, lines, mixing, neardup, packing

#: A language ID less sure than this (with a text's score tempered to a few words) is rejected, as are texts without letters.
SURE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose language is told, by what the labelled rows teach.

    Rows whose text is null, empty or has no letter go, as do those less sure than SURE; repeated rows are judged alike; null
    ids, languages and sources pass; an empty table, or one without any label, gives an empty result.
    """
    _common.ship_code(spark)
    model = language.learn(docs, public_tokenizers.path("piece_bpe_32k.model"))
    named = _common.fresh(docs, "lang_pred"), _common.fresh(docs, "score")
    judged = language.identify(docs, model, tuple(docs.columns), named)
    return judged.where((F.col(named[0]) != language.UND) & (F.col(named[1]) >= SURE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without the lines that repeat an earlier one, or nearly; rows of which nothing is left go.

    Null and empty texts stay as they are; repeated rows (same doc_id and text) get the same result each; rows that share a
    doc_id, or have none, are told by their text; n_chars follows the text; an empty table gives an empty result.
    """
    return lines.dedup_lines(docs)


def minhash_neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the smallest doc_id.

    Null and empty texts are alone in their group; rows that share a doc_id are one group, of which the least text stays;
    rows without a doc_id stay; an empty table gives an empty result.
    """
    _common.ship_code(spark)
    gone = _common.stash(neardup.near_duplicates(docs, words=5, threshold=80).where("NOT kept").select("doc_id").distinct())
    known = F.broadcast(gone) if gone.count() <= neardup.MOST_BROADCAST else gone
    kept = docs.join(known, docs["doc_id"].cast("long") == known["doc_id"], "left_anti")
    again = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    again = _common.stash(again)
    if again.isEmpty():
        return kept
    # Rows that share a doc_id are one group as well.
    one = Window.partitionBy("doc_id").orderBy("text")
    lone = kept.join(again, "doc_id", "left_anti").select(*docs.columns)
    nth = _common.fresh(docs, "nth")
    first = kept.join(again, "doc_id", "left_semi").withColumn(nth, F.row_number().over(one)).where(F.col(nth) == 1).select(*docs.columns)
    return lone.unionByName(first)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them: never, once or twice.

    Rows without words, null texts among them, stay once; null sources are a source; repeated rows are rows of their own;
    an empty table gives an empty result.
    """
    return mixing.mixed(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each row, placed in a sequence.

    Null texts are empty ones, which are their closing id alone; repeated rows are packed each; null ids stay null; an empty
    table gives an empty result.
    """
    _common.ship_code(spark)
    return packing.best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("minhash_neardup", minhash_neardup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the first, second and last stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage's result is written to the shared folder and read again."""
    docs = _common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = _common.stash(docs)
    return docs
