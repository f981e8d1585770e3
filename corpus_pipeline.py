"""Corpus pipeline: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heirloom.llm import mixture, sharding, shingle_join, toxicity, winnowing
from heirloom.llm.common import numbered, settle, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is scored 0.3 or more go; all labelled documents may be examples.

    Null and empty texts get the score of examples without words, and stay if there are none; without labels all stay.  Rows may repeat.  Columns of
    any name keep their values.
    """
    index = toxicity.build_index(docs, table(spark, sf_dir, "labels"))
    plain, name = numbered(docs)
    return toxicity.score_toxicity(plain, index, text=name["text"]).where("predicted = 0").select(*name.values()).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similarity 0.8 or more connect, the one with the smallest id stays.

    Null and empty texts are copies of each other.  Null ids come last; rows with one id or none are told apart by their values, and of rows
    equal in all columns one stays.
    """
    return shingle_join.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share ten consecutive words with a benchmark item, or hold a shorter item wholly, go.

    Null and empty texts stay, and all if there are no items.  Rows may repeat.  Columns of any name keep their values.
    """
    plain, name = numbered(docs)
    judged = winnowing.decontaminate(plain, table(spark, sf_dir, "benchmark"), text=name["text"])
    return judged.where("NOT contaminated").select(*name.values()).toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with words once, in training order, and of sources that the weights favour some a second time.

    The mix takes 150 % of all words; each source gets its own size first and at most twice that, so no
    document is lost, and the weights 3, 1, 2 deal out the rest.  Texts without words, null ones too, come once.
    Null sources are one source.  Repeated rows each count.  Columns of any name keep their values.
    """
    return mixture.mixed_stream(docs, least=1)


def shard_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in 8 shards that differ by one row at most, in uniformly random order.

    Null ids and texts are placed like others; repeated rows each get a slot.  A column named like an added one (size, text_crc32, law, shard, slot,
    grown_shard) is replaced.
    """
    return sharding.shard(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("sharding", shard_rows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Hash-drawn samples and nearest neighbours have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None
