"""Sharding, exact dedup, mixing and chat formatting: SQL, brute force and odd rows."""

import collections
import hashlib
import random

import pytest

from chronoloom.llm import chat_format, exact_dedup, mixing, sharding
from tests.conftest import spark_rows


def save(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


ODD_DOCS = [
    (1, "a b c", "en", "s1", 5),
    (2, "a bc", "en", "s1", 4),
    (3, None, None, None, None),
    (4, "", "en", "", 0),
    (5, " \t\n\r\x0b\x0c", "en", None, 6),
    (6, "Ünï x " * 3000, "fr", "s2", 18000),
    (7, "Ünïx" * 3000, "fr", "s2", 12000),
    (8, "a b\xa0c", "en", "s3", 5),
    (9, "abc", "en", "s1", 3),
    (10, "ab c ", "en", "s3", 5),
]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_fill_is_even_and_steady():
    names = [f"s{i}" for i in range(20)]
    owners = sharding.fill(names, 2003)
    counts = collections.Counter(owners)
    assert set(counts) == set(range(20)) and max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.fill(names[:-1], 2003)
    moved = sum(a != b for a, b in zip(owners, fewer, strict=True) if a != 19)
    assert moved < 0.1 * 2003
    with pytest.raises(ValueError):
        sharding.fill(names, 2000)


def test_fill_takes_turns():
    names, size = ["a", "b", "c"], 13
    owner, tried = {}, [0] * 3
    turn = 0
    while len(owner) < size:
        i = turn % 3
        first, step = sharding.walk(names[i], size)
        while (slot := (first + tried[i] * step) % size) in owner:
            tried[i] += 1
        owner[slot] = i
        turn += 1
    assert sharding.fill(names, size) == [owner[s] for s in range(size)]


def test_shards_of_odd_rows(spark):
    rows = [(1, "x", 5), (1, "y", 6), (None, "z", 7), (2**62, None, 8)]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, slot string, shard int")).collect()
    assert len(got) == 4 and len({r.shard for r in got if r.doc_id == 1}) == 1 and all(0 <= r.shard < 32 for r in got)
    slot = int(hashlib.md5(b"0:1").hexdigest()[:15], 16) % 4099
    assert {r.slot for r in got if r.doc_id == 1} == {slot}
    assert sharding.assign_shards(spark.createDataFrame([], "doc_id long")).count() == 0


def test_dedup_odd_rows(spark, tmp_path, duck):
    folder = save(spark, tmp_path, "documents", ODD_DOCS, DOCS)
    got = spark_rows(exact_dedup.op5_exact_dedup(spark, folder))
    assert got == duck(exact_dedup.OP5_SQL, folder)
    by = {r[0]: r[2] for r in got[1]}
    assert by[1] == by[2] == by[9] == by[10] == 1 and by[3] == by[4] == by[5] == 5 and by[8] == 8 and by[7] == by[6] == 6


def test_dedup_of_named_rows(spark):
    rows = [("b", "same text"), ("a", "same text"), ("c", "same  text"), (None, "sametext"), ("d", "other")]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(i, "c", 4) for i in ("a", "b", "c", None)} | {("d", "d", 1)}


def test_dedup_with_colliding_hashes(spark):
    from pyspark.sql import functions as F

    random.seed(3)
    rows = [(i, "".join(random.choice("ab ") for _ in range(random.randint(0, 6))), i) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, hash int")
    strong = spark_rows(exact_dedup.exact_dedup(df))
    assert strong == spark_rows(exact_dedup.exact_dedup(df, hashed=lambda c: F.length(c) % 2))
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


def brute_mix(rows, weights=(5, 2, 1)):
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            free.discard(s)
    return sizes, target


def brute_apportion(votes, seats):
    won = [0] * len(votes)
    for _ in range(seats):
        i = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        won[i] += 1
    return won


def test_mix_against_brute_force(spark, tmp_path, duck):
    random.seed(5)
    names = ["a", "b", "c", "d", "é", "", None]
    rows = [(i, " ".join("w" * random.randint(0, 40)), random.choices(names, [900, 300, 60, 8, 20, 3, 10])[0]) for i in range(3000)]
    rows += [(5000, None, "a"), (5001, "", "only-empty"), (5002, "x " * 9000, "d")]
    folder = save(spark, tmp_path, "documents", [(i, t, "en", s, 0) for i, t, s in rows], DOCS)
    got = mixing.op10_mixing(spark, folder)
    assert spark_rows(got) == duck(mixing.OP10_SQL, folder)
    sizes, target = brute_mix(rows)
    source = {i: s for i, _, s in rows}
    taken = collections.Counter()
    for r in got.collect():
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-6 * max(1, target[s]) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= max(1, 0.001 * target[s]) for s in sizes)
    assert spark_rows(got) == spark_rows(mixing.op10_mixing(spark, folder))


def test_apportion_is_sainte_lague(spark):
    random.seed(9)
    for seats in (0, 1, 7, 100, 1234):
        votes = [random.choice([0, 1, 5, 40, 900]) * random.random() for _ in range(9)] + [3.0]
        df = spark.createDataFrame([(0, i, v, seats) for i, v in enumerate(votes)], "g int, k int, v double, s long")
        got = {r.k: r.quota for r in mixing.apportion(df, ["g"], "k", "v", "s").collect()}
        assert [got[i] for i in range(len(votes))] == brute_apportion(votes, seats)


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert mixing.mix_sources(empty).count() == 0
    assert [tuple(r) for r in mixing.mix_sources(spark.createDataFrame([(1, None, "en", None, 0)], DOCS)).collect()] == [(1, 0, 0, 0.0, 0)]


CHATS = [
    (1, 0, "user", "How do I sort a list?\nI tried many things."),
    (1, 1, "assistant", "On Monday someone wrote:\n> how do I  SORT a list?\nUse sorted."),
    (1, 2, "user", ">> How do I sort a list?\n> Use sorted.\n\nThanks!\n>not from here"),
    (1, 3, "assistant", "> Thanks!\n\n\n\nWelcome."),
    (1, 4, "user", "> Welcome.\n> Use sorted.\n>\n> I tried many things.\nok"),
    (2, 0, "user", "Thanks!"),
    (2, 1, None, "> How do I sort a list?\nother conversation"),
    (2, 2, "user", None),
    (2, 3, "user", ""),
    (2, 3, "user", "> Thanks!\nsame turn twice"),
    (None, 0, "user", "> Thanks!\nnull conversation"),
    (3, None, "user", "Thanks!"),
    (3, 5, "user", "> > deep\n>>> deeper\r\n> a\rb"),
    (3, 6, "user", "wrote:\n" + "long line " * 5000 + "\n> " + "x " * 4000),
]
TURNS = "conv_id long, turn long, role string, text string"


def test_chats_against_sql(spark, tmp_path, duck):
    random.seed(2)
    rows = list(CHATS)
    for c in range(10, 30):
        said = []
        for t in range(12):
            lines = [random.choice(["alpha beta", "gamma.", "delta epsilon zeta", "eta"]) + f" {random.randint(0, 3)}" for _ in range(3)]
            if said and random.random() < 0.8:
                old = random.choice(said).split("\n")
                lines = [">" * random.randint(1, 2) + " " + x for x in old[: random.randint(1, 3)]] + lines
            said.append("\n".join(lines))
            rows.append((c, t, "user", said[-1]))
    folder = save(spark, tmp_path, "conversations", rows, TURNS)
    got = spark_rows(chat_format.op7_chat_formatting(spark, folder))
    assert got == duck(chat_format.OP7_SQL, folder)
    by = {(r.conv_id, r.turn): r for r in chat_format.op7_chat_formatting(spark, folder).collect()}
    assert by[1, 1].parent_turn == 0 and by[1, 1].content == "Use sorted." and by[1, 1].n_quotes == 1
    assert by[1, 2].parent_turn == 1 and by[1, 2].n_linked == 2 and by[1, 2].n_quotes == 3 and by[1, 2].depth == 2
    assert by[1, 4].thread_root == 0 and by[1, 4].parent_turn == 0  # the longest piece found
    assert by[2, 1].parent_turn is None and by[None, 0].parent_turn is None


def test_no_chats(spark):
    assert chat_format.format_chats(spark.createDataFrame([], TURNS)).count() == 0


def test_mix_of_repeated_ids_does_not_depend_on_row_order(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2, 3, i]), "w " * rng.randint(0, 30) + f"x{rng.randint(0, 9)}", "en", rng.choice(["a", "b", "c", None]), 1) for i in range(3000)]
    rows += [(5, "same id, other text " + str(i) * (i % 7), "en", "a", 1) for i in range(2000)] + [(6, "same", "en", "b", 1)] * 50
    got = [spark_rows(mixing.mix_sources(spark.createDataFrame(order, DOCS).repartition(parts))) for order, parts in ((rows, 3), (rows[::-1], 7), (sorted(rows, key=repr), 1))]
    assert got[0] == got[1] == got[2] and len(got[0][1]) == len(rows)


def test_rows_of_one_id_are_dealt_over_shards(spark):
    df = spark.createDataFrame([(5, f"text {i}", "en", "a", 1) for i in range(3000)], DOCS)
    order = df.select(mixing.place_in_order("doc_id", "text", mixing.SEED).alias("o"))
    assert order.distinct().count() == 3000
