"""Merkle manifest, SimHash components and delta clustering: SQL, plain twins, odd rows."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from chronoloom.llm import clustering, merkle, simhash
from tests.conftest import spark_rows
from tests.llm.test_native_ops import DOCS, ODD_DOCS, save

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("module", "name", "sql"), [(merkle, "op11_merkle_manifest", "OP11_SQL"), (clustering, "op13_centroids", "OP13_SQL")])
def test_sql(spark, duck, module, name, sql):
    assert spark_rows(getattr(module, name)(spark, FOLDER)) == duck(getattr(module, sql), FOLDER)


# --- Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """Levels of a tree, the leaves first."""
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def plain_manifest(rows):
    """(id, leaf, subroot, root, siblings) by nested loops."""
    one = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    parts = {}
    for i, text, lang, source, n in rows:
        parts.setdefault(lang, []).append(((i is not None, i or 0), h(*map(one, (i, source, lang, n, text))), i))
    names = sorted(parts, key=lambda x: (x is not None, (x or "").encode()))
    trees = [tree([leaf for _, leaf, _ in sorted(parts[x], key=lambda r: r[:2])]) for x in names]
    crown, out = tree([t[-1][0] for t in trees]), []
    for k, x in enumerate(names):
        for p, (_, leaf, i) in enumerate(sorted(parts[x], key=lambda r: r[:2])):
            steps = [(level[q ^ 1] if q ^ 1 < len(level) else None, q & 1) for j, level in enumerate(trees[k][:-1]) for q in [p >> j]]
            steps += [(level[q ^ 1] if q ^ 1 < len(level) else None, q & 1) for j, level in enumerate(crown[:-1]) for q in [k >> j]]
            out.append((i, leaf, trees[k][-1][0], crown[-1][0], steps))
    return out


@pytest.mark.parametrize("height", [1, 2, 3, 10])
def test_manifest_is_the_plain_one(spark, height):
    rng = random.Random(height)
    rows = [(100 + i, f"text {rng.random()} é", rng.choice([None, "", "a", "-", "ü", "zz"]), None, rng.choice([None, 7])) for i in range(60)]
    rows += [*ODD_DOCS, *ODD_DOCS[:3], (None, "x", "a", None, None), (None, "x", "a", None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS).withColumn("place", F.lit(1)).withColumn("n", F.lit("x")).withColumn("key", F.lit(None).cast("int")).repartition(5)
    got = merkle.merkle_manifest(df, height=height, carried={"twice": F.col("n_chars") * 2}).withColumn("again", merkle.fold_proof(F.col("leaf"), F.col("proof"))).collect()
    assert all(r.again == r.root for r in got)
    assert {r.twice for r in got if r.doc_id == 1} == {10}
    found = sorted(((r.doc_id, r.leaf, r.subroot, r.root, [(s.digest, int(s.before)) for s in r.proof]) for r in got), key=repr)
    assert found == sorted(plain_manifest(rows), key=repr)


def test_manifest_of_no_rows_and_of_one(spark):
    assert merkle.merkle_manifest(spark.createDataFrame([], DOCS)).count() == 0
    (one,) = merkle.merkle_manifest(spark.createDataFrame([(5, None, None, None, None)], DOCS)).collect()
    assert one.leaf == one.subroot == one.root == h("1:5----") and one.proof == []


def test_a_changed_row_is_found(spark):
    df = spark.createDataFrame(ODD_DOCS, DOCS)
    kept = merkle.merkle_manifest(df).alias("k")
    leaf = merkle.leaf_digest(*[F.concat("text", F.lit("!")) if c == "text" else F.col(c) for c in merkle.COLUMNS])
    changed = df.filter("text IS NOT NULL").select("doc_id", leaf.alias("new"))
    checked = kept.join(changed, "doc_id").select((merkle.fold_proof(F.col("new"), F.col("proof")) == F.col("root")).alias("same"))
    assert [r.same for r in checked.collect()] == [False] * 9


@pytest.mark.parametrize("subtree", [1, 2, 3, 5, 9])
@pytest.mark.parametrize("n", [1, 2, 3, 13, 31, 32])
def test_fractal_paths_are_the_trees(n, subtree):
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
    for height in {merkle.levels(n), 5}:
        level, all_levels = leaves, []
        for _ in range(height):
            all_levels.append(level)
            level = [merkle.folded(*level[i : i + 2]) for i in range(0, len(level), 2)]
        want = [[x[(p >> k) ^ 1] if (p >> k) ^ 1 < len(x) else None for k, x in enumerate(all_levels)] for p in range(n)]
        assert list(merkle.paths(leaves, height, subtree)) == want
        assert [merkle.block_root(leaves, height)] == level


def test_fractal_state_is_bounded(monkeypatch):
    live, most = [], []
    real = merkle.Grown

    class Counted(real):
        def __init__(self, *a):
            super().__init__(*a)
            live.append(self)

    monkeypatch.setattr(merkle, "Grown", Counted)
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(1 << 9)]
    for _ in merkle.paths(leaves, 9, 3):
        newest = live[-6:]
        most.append(sum(len(x.kept) for x in newest))
    assert max(most) <= 2 * 3 * 14  # two subtrees of 14 nodes on each of three levels


# --- SimHash


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in hashes) > len(hashes))


def plain_components(nodes):
    """{(id, print): smallest id reachable}, all pairs compared."""
    prints = sorted({p for _, p in nodes})
    name = {p: p for p in prints}

    def root(p):
        while name[p] != p:
            p = name[p]
        return p

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                name[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for i, p in nodes:
        if i is not None:
            least[root(p)] = min(least.get(root(p), i), i)
    return {(i, f"{p:016x}"): least.get(root(p)) for i, p in nodes}


def test_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 7)
    texts = ["", " \t\n", "A", "a B", "A b\x0bc", "a b c d É\xa0x", "İI ǅ z", "x " * 500, "one two three four five six seven" * 9, "a" * 100]
    assert [simhash.fingerprint(t.encode()) for t in texts] == [plain_print(t) for t in texts]


@pytest.mark.parametrize("heavy", [0, 3, simhash.HEAVY])
def test_components_of_near_prints(spark, monkeypatch, heavy):
    rng = random.Random(8)
    bits = lambda n: sum(1 << b for b in rng.sample(range(64), n))
    centres = [0, (1 << 64) - 1, 1 << 63, *[rng.getrandbits(64) for _ in range(20)]]
    prints = [c ^ bits(rng.randint(0, 6)) for c in centres for _ in range(25)]
    prints += [centres[5] ^ (rng.getrandbits(12) << 20) for _ in range(300)]
    nodes = [(rng.randint(0, 10**6), p) for p in prints] + [(None, 0), (None, 12345 << 40), (7, centres[4]), (7, centres[6])]
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in nodes]
    monkeypatch.setattr(simhash, "with_fingerprints", lambda df, *_: df.select("id", "fp"))
    df = spark.createDataFrame(rows, "id long, fp long").withColumn("text", F.lit(""))
    got = simhash.simhash_components(df, "text", "id", heavy)
    assert {(r.id, r.fingerprint): r.component_id for r in got.collect()} == plain_components(nodes)
    assert got.count() == len(rows)


def test_components_of_odd_rows(spark):
    rows = [*ODD_DOCS, *ODD_DOCS[:2], (None, "a b c", None, None, None), (11, "A B C", "x", None, 1)]
    df = spark.createDataFrame(rows, DOCS).withColumn("fp", F.lit("x")).withColumn("key", F.lit(1)).withColumn("a", F.lit(1))
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_components(df).collect()), key=repr)
    want = plain_components([(r[0], plain_print(r[1])) for r in rows])
    assert got == sorted(((r[0], f, want[r[0], f]) for r in rows for f in [f"{plain_print(r[1]):016x}"]), key=repr)
    assert simhash.simhash_components(df.limit(0)).count() == 0


def test_whole_query(spark):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op12_simhash(spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    want = plain_components([(d.doc_id, plain_print(d.text)) for d in docs])
    assert got == {i: (f, c) for (i, f), c in want.items()} and len(got) == len(docs)


# --- centroids


def plain_lloyd(rows, clusters, rounds, scale=1024, seed=3):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [list(v) for _, v in first[:clusters]]
    best = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centres))
    for _ in range(rounds):
        owned = [best(v)[1] for _, v in kept]
        for k in range(len(centres)):
            mine = [v for (_, v), o in zip(kept, owned, strict=True) if o == k]
            if mine:
                centres[k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out = [(i, *best(v)) for i, v in kept]
    inertia = {k: sum(d for _, d, o in out if o == k) for k in range(len(centres))}
    return [(i, k, d, inertia[k], sum(inertia.values()), centres[k]) for i, d, k in out]


@pytest.mark.parametrize(("n", "clusters", "rounds"), [(400, 8, 10), (5, 8, 10), (60, 3, 0), (60, 3, 1), (1, 1, 2)])
def test_delta_lloyd_is_lloyd(spark, monkeypatch, n, clusters, rounds):
    monkeypatch.setattr(clustering, "BLOCK", 32)
    rng = random.Random(n)
    rows = [(i, [rng.choice([-1.5, 0.0, 0.3, 2.0]) + rng.choice([0, 0, rng.gauss(0, 0.2)]) for _ in range(3)]) for i in range(n)]
    rows += rows[: n // 9] + [(None, list(rows[0][1]))]
    bad = [(900, None), (901, []), (902, [1.0, 2.0]), (903, [1.0, None, 2.0]), (904, [1.0, float("nan"), 2.0]), (905, [1.0, 2.0, float("-inf")]), (906, [1.0] * 4)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("block", F.lit(1)).withColumn("id", F.lit("x")).withColumn("cluster", F.lit(1))
    got = clustering.delta_lloyd(df, clusters=clusters, rounds=rounds, dimension=3).collect()
    assert sorted([(r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid) for r in got], key=repr) == sorted(plain_lloyd(rows, clusters, rounds), key=repr)


def test_without_vectors(spark):
    df = spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<float>")
    assert clustering.delta_lloyd(df).count() == 0
    with pytest.raises(ValueError):
        clustering.delta_lloyd(df, clusters=0)


def test_only_what_moved_is_compared(monkeypatch):
    rng = np.random.default_rng(1)
    numbers, centres = rng.integers(-99, 99, (200, 4)), rng.integers(-99, 99, (5, 4))
    owner, distance = clustering.reassigned(numbers, centres, np.ones(5, bool), np.full(200, -1, np.int32), np.zeros(200, np.int64))
    compared, real = [], clustering.nearest
    monkeypatch.setattr(clustering, "nearest", lambda n, c, among, o, d: (compared.append(len(n) * len(among)), real(n, c, among, o, d))[1])
    centres[2] += 7
    moved = np.arange(5) == 2
    after, far = clustering.reassigned(numbers, centres, moved, owner, distance)
    all_distances = ((numbers[:, None, :] - centres) ** 2).sum(axis=2)
    assert (after == all_distances.argmin(axis=1)).all() and (far == all_distances.min(axis=1)).all()
    assert sum(compared) == 5 * (owner == 2).sum() + (owner != 2).sum()
    changes = clustering.transfers(numbers, owner, after)
    assert sum(t["n"] for t in changes) == 0 and all(t["sums"] == (numbers[after == t["cluster"]].sum(axis=0) - numbers[owner == t["cluster"]].sum(axis=0)).tolist() for t in changes)


def test_rounds_join_without_a_shuffle(spark):
    df = spark.createDataFrame([(i, [float(i)]) for i in range(50)], "block long, v array<double>").selectExpr("block", "CAST('x' AS BINARY) AS numbers")
    a, b = (clustering.Bucketed(df.repartition(8, "block"), "probe", 8) for _ in "ab")
    plan = a.rows.hint("merge").join(b.rows, "block")._jdf.queryExecution().executedPlan().toString()
    a.drop()
    b.drop()
    assert "Exchange" not in plan
