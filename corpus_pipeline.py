"""From raw documents to placed training rows, in five stages.

Each stage gets all that the one before has kept, written as Parquet and read again, and returns
rows with the columns of `documents`; the last adds each row's slot and shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.llm.common import fold, table, written
from chronoloom.llm.decontamination import remove_contaminated
from chronoloom.llm.language_id import UNKNOWN, learn, predict_language
from chronoloom.llm.mixing import mix_sources
from chronoloom.llm.near_dedup import keep_one_of_each
from chronoloom.llm.sharding import N_SHARDS, TABLE_SIZE, assign_shards


#: A text goes if it scores lower than all but this share of the held-back training texts of its language do; a language with fewer than
#: LEAST_SCORED of them has no such bound. Scores are counted in CELLS cells from 0 to 1 to find the one that holds the bound.
LOW, LEAST_SCORED, CELLS = 0.001, 1000, 10_000


def least_scores(train: DataFrame) -> dict[str, float]:
    """For each language the score that all but `LOW` of its training texts reach by the profiles of the half they aren't in.

    All training texts are learnt from and scored. Rows that are named another language by these profiles don't count.
    """
    halves = [(fold("doc_id") == k) for k in (0, 2)]
    scored = [predict_language(train.filter(mine), learn(train.filter(other), most=None), name_col="__lang", score_col="__score").select("lang", "__lang", "__score") for mine, other in (halves, halves[::-1])]
    right = scored[0].union(scored[1]).filter("lang = __lang")
    counts = written(right.groupBy("lang", "__score").agg(F.count("*").alias("n")).withColumn("cell", F.floor(F.col("__score") * CELLS)), "language-scores")
    upto = lambda order: W.partitionBy("lang").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    cells = counts.groupBy("lang", "cell").agg(F.sum("n").alias("n")).withColumn("all", F.sum("n").over(W.partitionBy("lang"))).withColumn("to", F.sum("n").over(upto("cell")))
    place = F.floor(F.col("all") * LOW)
    holding = cells.filter((F.col("all") >= LEAST_SCORED) & (F.col("to") > place) & (F.col("to") - F.col("n") <= place)).select("lang", "cell", (place - F.col("to") + F.col("n")).alias("before"))
    near = counts.join(F.broadcast(holding), ["lang", "cell"]).withColumn("to", F.sum("n").over(upto("__score")))  # a cell a language
    return {r.lang: r.least for r in near.filter("to > before").groupBy("lang").agg(F.min("__score").alias("least")).collect()}  # `learn` bounds their number


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter, null and empty ones included, and those that score too low in the language they are nearest
    to (see `LOW`). Whole texts are scored; rows that repeat an id are judged each by its text.

    Where no training row has a language, all texts with letters stay. An empty table gives an empty one.
    """
    train = docs.filter(fold("doc_id") != 1)
    profiles = learn(train, most=None)
    if not profiles.names:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = predict_language(docs, profiles, name_col="__lang", score_col="__score").filter(F.col("__lang") != UNKNOWN)
    least = least_scores(train)
    if least:
        bound = F.element_at(F.create_map(*[F.lit(x) for pair in least.items() for x in pair]), F.col("__lang"))
        found = found.filter(F.col("__score") >= F.coalesce(bound, F.lit(0.0)))
    return found.select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate class; texts without words, null ones too, all stay."""
    return keep_one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a window of a benchmark item; null and empty texts stay."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents as the mix takes them: a row for each time its words are taken.

    Documents stay whole: one of whose words the last block takes a part is there once more. Null and empty
    texts have no words to take and go; rows that repeat an id are there as often as the one that is taken most.
    """
    copies = (
        mix_sources(docs.select("doc_id", "source", "text"))
        .filter("taken > 0")
        .groupBy(F.col("doc_id").alias("__id"))
        .agg(F.max(F.ceil(F.col("taken") / F.col("size"))).cast("int").alias("__copies"))
    )
    joined = docs.join(copies, F.col("doc_id").eqNullSafe(F.col("__id")))
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), "__copies"))).select(*docs.columns)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds slot and shard; all copies of a document are in one shard, null ids count as one."""
    return assign_shards(docs, "doc_id", N_SHARDS, TABLE_SIZE)


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: Signatures and learned profiles are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
