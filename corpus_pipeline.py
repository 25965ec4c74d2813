"""A corpus pipeline of five stages, each an operator of archlens.llm applied to all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archlens.llm import mixing, packing
from archlens.llm import quality as quality_
from archlens.llm import toxicity as toxicity_
from archlens.llm.common import Scratch, table
from archlens.llm.minhash_dedup import deduplicated
from archlens.llm.queries import tokenizer_path


def plain(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents out of a struct beside which a decision stood: no name of theirs can clash with it."""
    return rows.select(*[F.col(f"doc.`{c}`").alias(c) for c in columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below 0.5. Null and empty texts have no hits and are judged like others; rows that repeat an id or
    a text are judged each, alike for equal texts. Without usable labels nothing goes. All columns stay, whatever their names."""
    model = toxicity_.fit(docs, table(spark, sf_dir, "labels"))
    return plain(toxicity_.judged(docs, model).where("judged.score < 0.5"), docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality is at least 0.3. Null and empty texts are judged by statistics that are all 0; rows that repeat an id or
    a text are judged each. Without usable labels every score is 0.5 and nothing goes. All columns stay, whatever their names."""
    model = quality_.fit(docs, table(spark, sf_dir, "labels"))
    return plain(quality_.judged(docs, model).where("score >= 0.3"), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words a shingle, similarity 0.8.

    Texts without words all stay. Only linked texts are reduced, whatever their ids: of rows that repeat an id those with other texts
    stay, and rows without id link like any others. The one with the smallest id stays, a row without id only if none has one.
    """
    return deduplicated(docs, k=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, which may be never, and at most three times. Texts without words have size 0 and share
    the fate of their hash. A null source is a source of its own; rows of a source that repeat an id are taken together."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, a repeated document as often as the mix repeats it. A null or empty text is a piece of one id, its
    end; an overlong one is cut into full windows."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_dedup", near_dedup), ("mixing", mix), ("packing", pack)]
#: Tokenisers and learned models cannot be put in SQL: the tests hold each stage against a plain version of its own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages; each is written to the shared folder and read again."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
    return docs
