"""Mixing sources to target weights by Sainte-Laguë apportionment.

Targets: the sources share all words by weight; a target stops at `max_repeats` times its
source's size and the excess goes to the others by weight (water-filling, in closed form
over the sorted ratios of cap to weight). Equal blocks of words then go to the sources by
the highest quotients target / (2k + 1), and each source's blocks to its shards by the same
rule on the shards' sizes. A shard holds about `docs_per_shard` documents of one source,
chosen by a seeded hash of id and text, so a hot source, or an id of many rows, has more shards, not
larger ones. In a shard the documents stand in seeded order; the shard's stream of words, repeated, is cut into blocks
and the first `quota` of them are taken.

Texts are read once. What moves is one small row per document; sources and shards have one
row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import require, seeded, seeded_number, table, written

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
DOCS_PER_SHARD = 512
#: Blocks are so many words that there are about 2^24 of them, from 1 up to 2048 words.
BLOCKS, LARGEST_BLOCK = 1 << 24, 2048
SEED = 17
#: Bins of quotients in one e-fold.
QUOTIENT_BINS = 1 << 16


def words(text: Column) -> Column:
    """Number of runs of characters that aren't ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def place_in_order(id_col: str, text_col: str, seed: int) -> Column:
    """Hex digits by which rows are dealt to shards and stand in them: of id and text, so rows of one id are spread, too."""
    text = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    return seeded(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), text), seed)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, docs, n) with rank, weight, total and target added. One row per source, so one task."""
    every = W.orderBy("ratio", "rank").rowsBetween(W.unboundedPreceding, -1)
    after = W.orderBy("ratio", "rank").rowsBetween(W.currentRow, W.unboundedFollowing)
    all_rows = W.orderBy("ratio", "rank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = ranked.withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("rank") % len(weights) + 1).cast("bigint")
    ).withColumn("ratio", F.lit(max_repeats) * F.col("n") / F.col("weight"))
    level = (
        weighed.withColumn("total", F.sum("n").over(all_rows))
        .withColumn("capped", F.coalesce(F.sum(F.lit(max_repeats) * F.col("n")).over(every), F.lit(0)))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.sum("weight").over(after))
    )
    return (
        level.withColumn("level", F.max("level").over(all_rows))
        .withColumn("target", F.least((F.lit(max_repeats) * F.col("n")).cast("double"), F.col("level") * F.col("weight")))
        .select("source", "rank", "docs", "n", "weight", "total", "target")
    )


def apportion(df: DataFrame, group: list[str], key: str, votes: str, seats: str, known: tuple[str, str] | None = None) -> DataFrame:
    """Adds `quota`: `seats` (a column, one value in each group) shared by votes, as Sainte-Laguë does.

    known: columns with the group's sum of votes and its number of parties, or more, if there are such.

    Seats differ from the proportional share by less than half the share's part of the number
    of parties, and one; so only the quotients within that distance are compared. They are counted
    in narrow bins; bins above the one in which the seats run out win whole, and only the quotients
    of that bin are put in order, so no task holds all parties of a large group.
    """
    if known:
        summed = df.withColumn("__sum", F.col(known[0])).withColumn("__parties", F.col(known[1]))
    else:
        summed = df.join(df.groupBy(*group).agg(F.sum(votes).alias("__sum"), F.count("*").alias("__parties")), group)
    share = (
        summed
        .withColumn("__part", F.when(F.col("__sum") > 0, F.col(votes) / F.col("__sum")).otherwise(F.lit(0.0)))
        .withColumn("__near", F.ceil(F.col("__part") * F.col("__parties") / 2).cast("bigint") + 2)
        .withColumn("__base", F.floor(F.col("__part") * F.col(seats)).cast("bigint"))
        .withColumn("__sure", F.greatest(F.lit(0).cast("bigint"), F.col("__base") - F.col("__near")))
    )
    quotients = (
        share.filter(F.col(votes) > 0)
        .select(*group, key, F.col(seats).alias("__seats"), F.col(votes).alias("__votes"), F.explode(F.sequence("__sure", F.col("__base") + F.col("__near"))).alias("__k"))
        .withColumn("__q", F.col("__votes") / (2 * F.col("__k") + 1))
        .withColumn("__bin", F.floor(-F.ln("__q") * QUOTIENT_BINS))
    )
    above = W.partitionBy(*group).orderBy(F.col("__bin").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    sure = share.groupBy(*group).agg(F.lit(None).cast("bigint").alias("__bin"), F.sum("__sure").alias("__n"), F.first(seats).alias("__seats"))
    last = (
        quotients.groupBy(*group, "__bin")
        .agg(F.count("*").alias("__n"), F.first("__seats").alias("__seats"))
        .unionByName(sure)
        .withColumn("__left", F.col("__seats") - F.coalesce(F.sum("__n").over(above), F.lit(0)))
        .filter("__bin IS NOT NULL AND __left > 0")
        .groupBy(*group)
        .agg(F.max("__bin").alias("__last"), F.min("__left").alias("__left"))
    )
    near = quotients.join(last, group)
    best = W.partitionBy(*group).orderBy(F.desc("__q"), key, "__k")
    ordered = near.filter("__bin = __last").withColumn("__place", F.row_number().over(best)).filter("__place <= __left")
    won = near.filter("__bin < __last").select(*group, key).unionByName(ordered.select(*group, key)).groupBy(*group, key).agg(F.count("*").alias("__won"))
    return share.join(won, [*group, key], "left").select(
        *df.columns, (F.col("__sure") + F.coalesce(F.col("__won"), F.lit(0))).cast("bigint").alias("quota")
    )


def mix_sources(
    df: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple[int, ...] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    docs_per_shard: int = DOCS_PER_SHARD,
    block: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """One row per row of `df`: id, size, source_size, target, taken.

    size: words of the text, 0 for null. target: of the row's source. taken: words of the row
    that the mix takes, repeats counted, at most `max_repeats` times size. A null source is a
    source of its own, the last; the empty string is another. Rows that repeat an id count
    each; only those that repeat id and text share a place in the order, and they are alike. Where all texts are empty, targets and taken are 0. An empty table gives an empty
    result. Other columns don't matter. `block`: words in a block; by default about 2^24
    blocks in all, each of 1 to 2048 words. Equal inputs, parameters and seed take alike.
    """
    require(df, id_col, source_col, text_col)
    docs = written(
        df.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            words(F.col(text_col)).alias("size"),
            place_in_order(id_col, text_col, seed).alias("order"),
        ),
        "mix-sizes",
    )
    sizes = docs.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("n"))
    blocks = (
        F.lit(block).cast("bigint")
        if block
        else F.least(
            F.lit(LARGEST_BLOCK), F.greatest(F.lit(1), F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(F.col("total"), F.lit(1)) / BLOCKS)))) 
        ).cast("bigint")
    )
    every = W.partitionBy("all")
    targets = written(
        source_targets(sizes, weights, max_repeats)
        .withColumn("block", blocks)
        .withColumn("all", F.lit(0))
        .withColumn("blocks", F.floor(F.col("total") / F.col("block") + 0.5).cast("bigint"))
        .withColumn("shards", F.ceil(F.col("docs") / docs_per_shard).cast("bigint"))
        .withColumn("targets", F.sum("target").over(every))
        .withColumn("parties", F.count("*").over(every)),
        "mix-targets",
    )
    sources = written(apportion(targets, ["all"], "rank", "target", "blocks", ("targets", "parties")).withColumnRenamed("quota", "source_quota"), "mix-sources")
    placed = docs.join(
        sources.select(F.col("source").alias("__source"), "rank", "n", "target", "shards", "block", "source_quota"),
        F.col("source").eqNullSafe(F.col("__source")),
    ).withColumn("shard", seeded_number(F.reverse("order")) % F.col("shards"))
    totals = [F.sum("size").alias("m"), *[F.first(c).alias(c) for c in ("block", "source_quota", "n", "shards")]]
    cells = written(placed.groupBy("rank", "shard").agg(*totals), "mix-cells")
    cells = written(apportion(cells, ["rank"], "shard", "m", "source_quota", ("n", "shards")).select("rank", "shard", "m", "block", "quota"), "mix-shards")
    before = W.partitionBy("rank", "shard").orderBy("order", "id").rowsBetween(W.unboundedPreceding, -1)
    stream = (
        placed.drop("block")
        .join(cells, ["rank", "shard"])
        .withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
        .withColumn("take", F.least(F.col("quota") * F.col("block"), F.lit(max_repeats) * F.col("m")))
        .withColumn("passes", F.when(F.col("m") > 0, F.floor(F.col("take") / F.col("m"))).otherwise(F.lit(0)).cast("bigint"))
        .withColumn("rest", F.col("take") - F.col("passes") * F.col("m"))
    )
    part = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("size"), F.col("rest") - F.col("start")))
    return stream.select(
        F.col("id").alias(id_col),
        "size",
        F.col("n").alias("source_size"),
        "target",
        (F.col("passes") * F.col("size") + part).alias("taken"),
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


OP10_SQL = rf"""
WITH d AS (
  SELECT doc_id AS id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS ord
  FROM documents
), s0 AS (
  SELECT source, count(*) AS docs, sum(size)::BIGINT AS n FROM d GROUP BY source
), s1 AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s0
), s2 AS (
  SELECT *, [5, 2, 1][rank % 3 + 1]::BIGINT AS weight FROM s1
), s3 AS (
  SELECT *, (sum(n) OVER ())::BIGINT AS total, {MAX_REPEATS} * n / weight AS ratio FROM s2
), s4 AS (
  SELECT *, (total - coalesce(sum({MAX_REPEATS} * n) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT
            / (sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS lvl FROM s3
), s5 AS (
  SELECT *, least(({MAX_REPEATS} * n)::DOUBLE, max(lvl) OVER () * weight) AS target,
         least({LARGEST_BLOCK}, greatest(1, pow(2.0, floor(log2(greatest(total, 1) / {BLOCKS})))))::BIGINT AS block,
         ceil(docs / {DOCS_PER_SHARD})::BIGINT AS shards FROM s4
), s6 AS (
  SELECT *, floor(total / block + 0.5)::BIGINT AS blocks, count(*) OVER () AS parties,
         CASE WHEN sum(target) OVER () > 0 THEN target / sum(target) OVER () ELSE 0 END AS part FROM s5
), s7 AS (
  SELECT *, greatest(0, floor(part * blocks)::BIGINT - ceil(part * parties / 2)::BIGINT - 2) AS sure,
         floor(part * blocks)::BIGINT + ceil(part * parties / 2)::BIGINT + 2 AS most FROM s6
), q AS (
  SELECT rank, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, rank, k) AS place, open
  FROM (SELECT *, blocks - (sum(sure) OVER ())::BIGINT AS open FROM s7) s, unnest(range(sure, most + 1)) u(k) WHERE target > 0
), s8 AS (
  SELECT s7.*, sure + coalesce(won, 0) AS source_quota
  FROM s7 LEFT JOIN (SELECT rank, count(*) AS won FROM q WHERE place <= open GROUP BY rank) USING (rank)
), p AS (
  SELECT d.*, s8.rank, s8.n, s8.target, s8.block, s8.source_quota, ('0x' || substr(reverse(ord), 1, 15))::BIGINT % shards AS shard
  FROM d JOIN s8 ON d.source IS NOT DISTINCT FROM s8.source
), c0 AS (
  SELECT rank, shard, sum(size)::BIGINT AS m, any_value(block) AS block, any_value(source_quota) AS seats FROM p GROUP BY rank, shard
), c1 AS (
  SELECT *, count(*) OVER w AS parties, CASE WHEN sum(m) OVER w > 0 THEN m / (sum(m) OVER w)::BIGINT ELSE 0 END AS part FROM c0 WINDOW w AS (PARTITION BY rank)
), c2 AS (
  SELECT *, greatest(0, floor(part * seats)::BIGINT - ceil(part * parties / 2)::BIGINT - 2) AS sure,
         floor(part * seats)::BIGINT + ceil(part * parties / 2)::BIGINT + 2 AS most FROM c1
), cq AS (
  SELECT rank, shard, row_number() OVER (PARTITION BY rank ORDER BY m / (2 * k + 1) DESC, shard, k) AS place, open
  FROM (SELECT *, seats - (sum(sure) OVER (PARTITION BY rank))::BIGINT AS open FROM c2) s, unnest(range(sure, most + 1)) u(k) WHERE m > 0
), c3 AS (
  SELECT c2.rank, c2.shard, m, block, sure + coalesce(won, 0) AS quota
  FROM c2 LEFT JOIN (SELECT rank, shard, count(*) AS won FROM cq WHERE place <= open GROUP BY rank, shard) USING (rank, shard)
), t AS (
  SELECT p.*, m, least(quota * c3.block, {MAX_REPEATS} * m) AS take,
         coalesce(sum(size) OVER (PARTITION BY rank, shard ORDER BY ord, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM p JOIN c3 USING (rank, shard)
), u AS (
  SELECT *, CASE WHEN m > 0 THEN take // m ELSE 0 END AS passes FROM t
)
SELECT id AS doc_id, size, n AS source_size, target,
       (passes * size + greatest(0, least(size, take - passes * m - start)))::BIGINT AS taken
FROM u
"""
