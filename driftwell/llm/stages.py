"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and works on all rows of ``docs``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, mixing, quality, sentencepiece
from .ngram_join import ngram_classes
from .queries import tokenizer_path
from .shared import written

#: Word n-grams and similarity of near duplicates.
NEAR_WORDS, NEAR_NUM, NEAR_DEN = 5, 4, 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality rules reject, and failing lines from the texts of the others.

    Null, empty and blank texts are rejected; rows are judged one by one, so repeated rows and null ids or sources have no
    effect.  All columns stay, whatever their names and types; texts may be of any length; an empty table gives none.
    """
    return quality.cleaned(docs)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised texts one stays: the longest, then the one with the smallest id.

    Documents without an equal one stay as they are.  A row of a group stays if it is the group's choice; where the
    choice's id and text come in several rows, one of these stays.  Null counts as an empty text; texts may be of any
    length; an empty table gives none.
    """
    return exact_dedup.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near duplication the one with the smallest id stays.

    Documents without words link with nothing and stay, as do rows without an id; rows that share an id are one document
    and stay or go together.  All columns stay; texts may be of any length; an empty table gives none.
    """
    classes = ngram_classes(docs, NEAR_WORDS, NEAR_NUM, NEAR_DEN)
    dropped = written(classes.where("component_id <> doc_id").select("doc_id").distinct(), "dropped")
    few = dropped.count() <= exact_dedup.BROADCAST_HASHES
    rows = docs.select(F.struct("*").alias("row"), "doc_id")
    return rows.join(F.broadcast(dropped) if few else dropped, "doc_id", "left_anti").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it; documents taken no times are left out.

    A null source is a source; null and empty texts have size 0 and are taken at their source's rate.  All columns stay; texts may be of any length; an empty table gives none.
    """
    return mixing.mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_chars, ids, n_fallback`` of every document, and its other columns but the text; columns
    named ``ids`` or ``n_fallback`` give way to the new ones.

    Null and empty texts have no ids; texts may be of any length; rows are encoded one by one; an empty table gives none.
    """
    return sentencepiece.encode(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("encode_pieces", encode_pieces),
]
