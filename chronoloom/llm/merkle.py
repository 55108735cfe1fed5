"""Merkle manifest of a table: a digest per row, a tree per part, a tree of the parts, a proof per row.

1. Each row's columns give a leaf in one pass over the texts; from then on rows are ids and digests.
2. Leaves are range-partitioned in their order and numbered by partition offsets, so a part of
   any size is dealt over all tasks. Aligned blocks of 2^`HEIGHT` leaves become one row each.
3. A block's root is folded from its leaves. Block roots are the nodes of the next level, which
   is dealt into blocks in the same way, until each part has one block; parts are a level of their own.
4. Proofs go downwards: the proof of a block, made on the level above, is joined with the block's
   row. Fractal traversal (Jakobsson, Leighton, Micali, Szydlo 2003) then walks the block's nodes: of
   each of its stacked subtrees of height `SUBTREE` the existing one gives the siblings, while the
   desired one, next in line, grows by two steps a node. A path is given out, with the block's own
   proof behind it, before the next one is made; no tree is held as a whole.

Texts are read once and never move. What moves are ids and 32-byte digests, about 50 bytes a row
for the order and twice a block's row for the blocks. A block has at most 2^`HEIGHT` leaves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import require, table, written

#: Levels of nodes in a block, and in one of its stacked subtrees.
HEIGHT, SUBTREE = 10, 2
#: Bits of monotonically_increasing_id below the partition's number.
IN_PARTITION = 33
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: A proof: for each level whether the sibling stands before the node, and its digest, null where a node is folded alone.
PROOF = "array<struct<before:boolean,digest:string>>"


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """Lower-case hex SHA-256 of the values' fields."""
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def folded(*digests: bytes) -> bytes:
    """A run's parent: digests go in as hex text."""
    return sha256(b"".join(d.hex().encode() for d in digests)).digest()


def levels(n: int) -> int:
    """Times that `n` nodes are folded until one remains."""
    return max(n - 1, 0).bit_length()


def block_height(n: int, height: int) -> int:
    """A block of the only one of its part ends at the root; one of several is folded `height` times, however few nodes it has."""
    return height if n > 1 << height else levels(n)


def _pair(left: bytes | None, right: bytes | None) -> bytes | None:
    """A parent over nodes of which the right one, or both, may lie behind the last node."""
    return None if left is None else folded(left) if right is None else folded(left, right)


class Grown:
    """The subtree of height `top - bottom` that ends at node (`top`, `index`), grown step by step from the leaves below it.

    Kept are its nodes from level `bottom` to below `top`, which are the siblings paths need, and the
    stack of nodes not yet folded, one a level at most.
    """

    def __init__(self, leaves: Sequence[bytes], bottom: int, top: int, index: int):
        self.kept: dict[tuple[int, int], bytes | None] = {}
        self.root: bytes | None = None
        self._steps = self._grow(leaves, bottom, top, index)

    def _grow(self, leaves, bottom: int, top: int, index: int) -> Iterator[None]:
        stack: list[tuple[int, int, bytes | None]] = []
        for at in range(index << top, min((index + 1) << top, len(leaves) + (-len(leaves) % (1 << top)))):
            level, node = 0, leaves[at] if at < len(leaves) else None
            while True:
                if bottom <= level < top:
                    self.kept[level, at >> level] = node
                yield
                if not stack or stack[-1][0] != level or level == top:
                    break
                node, level = _pair(stack.pop()[2], node), level + 1
            stack.append((level, at >> level, node))
        self.root = stack[0][2] if stack else None

    def step(self, times: int = 1) -> None:
        for _ in range(times):
            next(self._steps, None)

    def whole(self) -> Grown:
        for _ in self._steps:
            pass
        return self


def block_root(leaves: Sequence[bytes], height: int) -> bytes:
    return Grown(leaves, height, height, 0).whole().root


def paths(leaves: Sequence[bytes], height: int, subtree: int = SUBTREE) -> Iterator[list[bytes | None]]:
    """For each leaf in order the siblings on its way up `height` levels, null where there's none."""
    cuts = [*range(0, height, subtree), height]
    stacked = list(zip(cuts, cuts[1:], strict=False))
    existing = [Grown(leaves, bottom, top, 0).whole() for bottom, top in stacked]
    desired = [Grown(leaves, bottom, top, 1) for bottom, top in stacked]
    for at in range(len(leaves)):
        yield [existing[i].kept.get((level, (at >> level) ^ 1)) for i, (bottom, top) in enumerate(stacked) for level in range(bottom, top)]
        for i, (bottom, top) in enumerate(stacked):
            desired[i].step(2)
            if not (at + 1) % (1 << top):  # two steps a leaf are enough: the next subtree is ready
                existing[i] = desired[i].whole()
                desired[i] = Grown(leaves, bottom, top, ((at + 1) >> top) + 1)


def numbered(df: DataFrame, key: str, *order: str, label: str) -> DataFrame:
    """`df` with `place` (0-based, in the order given, in each part) and `n` (rows of the part).

    Rows are range-partitioned by all of key and order; a partition's rows of a part begin where those of the
    partitions before end. The table of offsets has a row per part and one per partition.
    """
    row = written(
        df.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("__row", F.monotonically_increasing_id()), f"{label}-sorted"
    )
    row = row.withColumn("__p", F.shiftright("__row", IN_PARTITION))
    offsets = row.groupBy(F.col(key).alias("__key"), F.col("__p").alias("__part")).agg(F.min("__row").alias("__first"), F.count("*").alias("__n"))
    before = W.partitionBy("__key").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = offsets.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).withColumn("n", F.sum("__n").over(W.partitionBy("__key")))
    joined = row.join(written(offsets, f"{label}-offsets"), (F.col(key) == F.col("__key")) & (F.col("__p") == F.col("__part")))
    return joined.withColumn("place", F.col("__row") - F.col("__first") + F.col("__before")).select(*df.columns, "place", "n")


def in_blocks(nodes: DataFrame, height: int, *more: str) -> DataFrame:
    """(key, place, n, digest, ...) to one row per block of nodes, `nodes` in order, with the block's place."""
    block = F.shiftright("place", height)
    return nodes.groupBy("key", block.alias("place"), "n").agg(F.array_sort(F.collect_list(F.struct("place", "digest", *more))).alias("nodes"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield batch.slice(row, 1)


def _schema(*fields: StructField) -> tuple[StructType, pa.Schema]:
    kind = StructType([*fields])
    return kind, to_arrow_schema(kind)


def with_roots(blocks: DataFrame, height: int) -> DataFrame:
    out, schema = _schema(*blocks.schema.fields, StructField("root", BinaryType()))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in _rows(batches):
            digests = one.column("nodes").flatten().field("digest").to_pylist()
            root = block_root(digests, block_height(one.column("n")[0].as_py(), height))
            yield pa.RecordBatch.from_arrays([*one.columns, pa.array([root], pa.binary())], schema=schema)

    return blocks.mapInArrow(fold, out)


def with_proofs(blocks: DataFrame, above: DataFrame, height: int) -> DataFrame:
    """Blocks and what is known of them from above (key, place, proof, subroot) to a row per node: key, subroot, the node's columns, its whole proof."""
    known = above.select("key", "place", F.col("proof").alias("above"), "subroot")
    joined = blocks.join(known, ["key", "place"]).select("key", "place", "n", "subroot", "nodes", "above")
    out, schema = _schema(blocks.schema["key"], above.schema["subroot"], above.schema["proof"], *blocks.schema["nodes"].dataType.elementType.fields)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in _rows(batches):
            nodes, first = one.column("nodes").flatten(), one.column("place")[0].as_py() << height
            rest = [(s["before"], s["digest"]) for s in one.column("above")[0].as_py()]
            digests = nodes.field("digest").to_pylist()
            walked = paths(digests, block_height(one.column("n")[0].as_py(), height))
            proofs = [[(bool((first + at) >> level & 1), s and s.hex()) for level, s in enumerate(path)] + rest for at, path in enumerate(walked)]
            same = [pa.repeat(one.column(c)[0], len(digests)) for c in ("key", "subroot")]
            yield pa.RecordBatch.from_arrays([*same, pa.array(proofs, schema.field("proof").type), *nodes.flatten()], schema=schema)

    return joined.mapInArrow(walk, out)


def proved(nodes: DataFrame, height: int, label: str, above: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Nodes (key, place, n, digest, ...) to rows (key, subroot, proof, place, digest, ...).

    `above` gets the roots of the parts (key, root) and gives (key, proof, subroot).
    """
    more = [c for c in nodes.columns if c not in ("key", "place", "n", "digest")]
    most, tower = nodes.agg(F.max("n")).first()[0] or 0, []
    while not tower or most > 1:
        tower.append(written(with_roots(in_blocks(nodes, height, *(() if tower else more)), height), f"{label}-{len(tower)}"))
        most = -(-most >> height)
        nodes = tower[-1].select("key", "place", F.ceil(F.col("n") / (1 << height)).cast("bigint").alias("n"), F.col("root").alias("digest"))
    known = above(tower[-1].select("key", "root")).withColumn("place", F.lit(0).cast("bigint"))
    for blocks in reversed(tower):
        known = with_proofs(blocks, known, height)
    return known


def fold_proof(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give: at each step the sibling, if any, goes before the node or behind it."""

    def parent(node: Column, s: Column) -> Column:
        both = F.when(s["before"], F.concat(s["digest"], node)).otherwise(F.concat(node, F.coalesce(s["digest"], F.lit(""))))
        return F.sha2(both.cast("binary"), 256)

    return F.aggregate(proof, leaf, parent)


def proof_digest(proof: Column) -> Column:
    """SHA-256 of a proof's siblings from the leaf upwards."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: s["digest"]), "").cast("binary"), 256)


def merkle_manifest(
    df: DataFrame,
    columns: Sequence[str] = COLUMNS,
    id_col: str = "doc_id",
    part_col: str = "lang",
    carried: dict[str, Column] | None = None,
    height: int = HEIGHT,
) -> DataFrame:
    """One row per row of `df`: id, leaf, subroot, root, proof, and what `carried` computes of the row.

    leaf: hex SHA-256 of the columns' fields (see `field`); null and the empty string differ. Rows of
    a part stand in order of id, null first, then of leaf; rows alike in both are a leaf each. Every two
    nodes in turn, or a last one alone, become their parent while a part has several. Parts stand in order
    of the part column's UTF-8 bytes, null first, and are folded likewise; a lone node is the root itself.
    proof: see `PROOF`, from the leaf to the root. An empty table gives an empty result. Other columns
    don't matter, whatever their names.
    """
    require(df, *columns, id_col, part_col)
    carried = carried or {}
    part = F.coalesce(F.concat(F.lit("="), F.col(part_col).cast("string")), F.lit("-"))  # "-" stands before "="
    leaves = written(
        df.select(
            part.alias("key"),
            F.col(id_col).alias("id"),
            F.unhex(leaf_digest(*[F.col(c) for c in columns])).alias("digest"),
            *[c.alias(f"carried_{name}") for name, c in carried.items()],
            F.monotonically_increasing_id().alias("alike"),
        ),
        "leaves",
    )
    top: list[bytes] = []

    def over_all(roots: DataFrame) -> DataFrame:
        top.extend(r.root for r in roots.collect())  # one, or none
        return roots.select("key", F.from_json(F.lit("[]"), PROOF).alias("proof"), F.lit(None).cast("binary").alias("subroot"))

    def over_parts(roots: DataFrame) -> DataFrame:
        parts = numbered(roots.select(F.lit("").alias("key"), F.col("key").alias("part"), F.col("root").alias("digest")), "key", "part", label="parts")
        found = proved(parts, height, "part-blocks", over_all)
        return written(found.select(F.col("part").alias("key"), "proof", F.col("digest").alias("subroot")), "part-proofs")

    ordered = numbered(leaves, "key", "id", "digest", "alike", label="leaves").drop("alike")
    found = proved(ordered, height, "leaf-blocks", over_parts)
    hexed = lambda name: F.lower(F.hex(name)).alias(name)
    return found.select(
        F.col("id").alias(id_col),
        F.lower(F.hex("digest")).alias("leaf"),
        hexed("subroot"),
        F.lit(top[0].hex() if top else None).cast("string").alias("root"),
        "proof",
        *[F.col(f"carried_{name}").alias(name) for name in carried],
    )


def altered_leaf(every: int = 7) -> Column:
    """The leaf of a row of `documents` whose n_chars was raised by one, where `every` divides the id's CRC-32; else null."""
    changed = [(F.col(c) + 1 if c == "n_chars" else F.col(c)) for c in COLUMNS]
    return F.when(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % every == 0, F.unhex(leaf_digest(*changed)))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle_manifest(table(spark, sf_dir, "documents"), carried={"altered": altered_leaf()})
    folded_root = fold_proof(F.coalesce(F.lower(F.hex("altered")), F.col("leaf")), F.col("proof"))
    return found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), folded_root.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root")
    )


def _field_sql(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR, '-')"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field_sql(n_chars if c == "n_chars" else c) for c in COLUMNS) + ")"


#: DuckDB: trees level by level, then each document's node and sibling on every level; CRC-32 bit by bit.
OP11_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {_leaf_sql('n_chars')} AS leaf,
         list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
           lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))) AS crc,
         {_leaf_sql('n_chars + 1')} AS altered FROM documents
), l AS (
  SELECT doc_id, lang, leaf, CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN altered ELSE leaf END AS given,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM d
), tree AS (
  SELECT lang, 0 AS level, place, n, leaf AS digest FROM l
  UNION ALL
  SELECT lang, level + 1, place // 2, any_value((n + 1) // 2), sha256(string_agg(digest, '' ORDER BY place)) FROM tree WHERE n > 1 GROUP BY lang, level, place // 2
), subroots AS (
  SELECT lang, digest AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM tree WHERE n = 1
), crown AS (
  SELECT 0 AS level, place, n, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, place // 2, any_value((n + 1) // 2), sha256(string_agg(digest, '' ORDER BY place)) FROM crown WHERE n > 1 GROUP BY level, place // 2
), steps AS (
  SELECT doc_id, r.level, l.place >> r.level AS pos, t.digest FROM l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang, range(s.height) r(level)
  LEFT JOIN tree t ON t.lang IS NOT DISTINCT FROM l.lang AND t.level = r.level AND t.place = xor(l.place >> r.level, 1)
  UNION ALL
  SELECT doc_id, s.height + r.level, s.place >> r.level, c.digest
  FROM l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang, range((SELECT max(level) FROM crown)) r(level) LEFT JOIN crown c ON c.level = r.level AND c.place = xor(s.place >> r.level, 1)
), up AS (
  SELECT doc_id, 0::BIGINT AS level, given AS node FROM l
  UNION ALL
  SELECT up.doc_id, up.level + 1, sha256(CASE WHEN pos % 2 = 1 THEN digest || node ELSE node || coalesce(digest, '') END) FROM up JOIN steps USING (doc_id, level)
), proofs AS (
  SELECT doc_id, sha256(coalesce(string_agg(digest, '' ORDER BY level), '')) AS proof_sha256 FROM steps GROUP BY doc_id
), top AS (
  SELECT digest AS root FROM crown WHERE n = 1
)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, node AS folded_root, node = root AS verified
FROM l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang CROSS JOIN top LEFT JOIN proofs USING (doc_id)
JOIN (SELECT doc_id, arg_max(node, level) AS node FROM up GROUP BY doc_id) USING (doc_id)
"""
