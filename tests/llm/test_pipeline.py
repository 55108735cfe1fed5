"""The stages of the corpus pipeline, one by one and together, against brute force."""

import collections
import itertools
import math
import random

import pytest

import corpus_pipeline
from chronoloom.llm import decontamination, mixing, near_dedup, sharding
from tests.llm.test_native_ops import DOCS, brute_mix, save
from tests.llm.test_python_ops import BENCH, WORDS, classes_by_brute_force, prose


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(21)
    rows, n = [], 0
    for _ in range(60):
        base = prose(rng.randint(40, 120), rng)
        for k in range(rng.choice([1, 1, 3])):
            copy = list(base)
            if k:
                copy[rng.randrange(len(copy))] = "edited"
            if rng.random() < 0.15:
                copy[5:5] = WORDS[3:18]
            rows.append((n, " ".join(copy), rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", "c", None]), n))
            n += 1
    rows += [(n, None, "en", "a", 0), (n + 1, "", "en", "a", 0), (n + 2, "123 ... !!", "en", "b", 0), (n + 3, "Word " * 40_000, "en", "c", 0)]
    folder = save(spark, tmp_path_factory.mktemp("corpus"), "documents", rows, DOCS)
    spark.createDataFrame([b for b in BENCH if b[0] is not None], "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows


def brute_classes(rows):
    """Connected components at a weighted or plain Jaccard similarity of 0.8, all pairs compared; ids are the smallest."""
    counts = []
    for _, t in rows:
        w = decontamination.words_of((t or "").lower().encode())
        counts.append(collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else {})
    df = collections.Counter(g for c in counts for g in c)
    idf = lambda g: 1 + near_dedup.IDF_SPAN * min(1, math.log(df[g] / len(rows)) / math.log(near_dedup.RARE))
    vectors = [{g: (1 + math.log(n)) * idf(g) for g, n in c.items()} for c in counts]
    at = {i: i for i, _ in rows}
    for ((i, _), a), ((j, _), b) in itertools.combinations(zip(rows, vectors, strict=True), 2):
        low = sum(min(a[g], b[g]) for g in a.keys() & b.keys())
        both = len(a.keys() & b.keys())
        if low and (low >= 0.8 * (sum(a.values()) + sum(b.values()) - low) or both / (len(a) + len(b) - both) >= 0.8):
            x, y = at[i], at[j]
            at = {k: min(x, y) if v in (x, y) else v for k, v in at.items()}
    return at


def test_stages(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_dedup", "decontamination", "mixing", "sharding"]
    text = {r[0]: r[1] for r in rows}

    kept = stages["language_id"](spark, docs, folder)
    ids = sorted(r.doc_id for r in kept.collect())
    assert kept.columns == docs.columns and ids == [i for i, t in text.items() if any(c.isalpha() for c in t or "")]

    unique = stages["near_dedup"](spark, kept, folder)
    left = sorted(r.doc_id for r in unique.collect())
    assert unique.columns == docs.columns and left == sorted(set(brute_classes([(i, text[i]) for i in ids]).values()))

    clean = stages["decontamination"](spark, unique, folder)
    items = [decontamination.words_of((t or "").encode()) for i, t in BENCH if i is not None]
    grams = {tuple(w[s : s + 10]) for w in items if w for s in range(max(1, len(w) - 9))}

    def hit(t):
        w = decontamination.words_of(t.encode())
        return any(tuple(w[s : s + n]) in grams for n in {len(g) for g in grams} for s in range(len(w) - n + 1))

    fine = sorted(r.doc_id for r in clean.collect())
    assert clean.columns == docs.columns and fine == [i for i in left if not hit(text[i])] and len(fine) < len(left)

    mixed = stages["mixing"](spark, clean, folder)
    copies = collections.Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns and set(copies) <= set(fine) and max(copies.values()) <= 3
    source = {r[0]: r[3] for r in rows}
    sizes, target = brute_mix([(i, text[i], source[i]) for i in fine])
    words = collections.Counter()
    for i, k in copies.items():
        words[source[i]] += k * len(text[i].split())
    longest = max(len(text[i].split()) for i in fine)
    assert all(abs(words[s] - target[s]) <= longest + 0.01 * target[s] for s in sizes)

    placed = stages["sharding"](spark, mixed, folder).collect()
    assert len(placed) == sum(copies.values()) and all(0 <= r.shard < sharding.N_SHARDS for r in placed)


def test_near_dedup_links_at_a_plain_similarity(spark, corpus):
    """As the stage was tested before its weights came in: the corpus has a pair at a plain 0.8 that they leave below."""
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("text rlike '[a-zA-Z]'")
    left = sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, folder).collect())
    assert left == sorted(set(classes_by_brute_force([(i, t) for i, t, *_ in rows if any(c.isalpha() for c in t or "")]).values()))


def test_language_stage_rejects_what_is_in_no_language(spark):
    rng = random.Random(31)
    letters = {"en": "etaoinshrdlu", "pt": "aeosrindmçãv"}
    words = {k: ["".join(rng.choices(c, k=rng.randint(2, 7))) for _ in range(150)] for k, c in letters.items()}
    rows = [(i, " ".join(rng.choices(words[k], k=40)), k, "a", 0) for i in range(4000) for k in [("en", "pt")[i % 2]]]
    rows += [(5000 + i, "".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(60)), None, "a", 0) for i in range(20)]
    left = {r.doc_id for r in corpus_pipeline.language_stage(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    assert sum(i < 4000 for i in left) >= 4000 * 0.995 and sum(i >= 5000 for i in left) <= 2


def test_language_stage_without_a_language_keeps_letters(spark):
    rows = [(1, "some words", None, "a", 0), (2, "é", None, "a", 0), (3, "12 ...", None, "a", 0), (4, None, None, "a", 0), (5, "日本", None, "a", 0)]
    assert {r.doc_id for r in corpus_pipeline.language_stage(spark, spark.createDataFrame(rows, DOCS), "").collect()} == {1, 2, 5}


def test_run_gives_the_stages(spark, corpus):
    folder, _ = corpus
    got = sorted((r.doc_id, r.shard) for r in corpus_pipeline.run(spark, folder).collect())
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert got == sorted((r.doc_id, r.shard) for r in docs.collect()) and mixing.MAX_REPEATS == 3


def test_empty_corpus(spark, tmp_path):
    folder = save(spark, tmp_path, "documents", [], DOCS)
    save(spark, tmp_path, "benchmark", [], "item_id long, text string")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_odd_rows_and_more_columns(spark, tmp_path):
    rows = [(None, "one two three four five six", None, None, None, 1), (1, None, "en", "a", 1, 2), (1, "Same text here", "en", "a", 1, 3), (1, "Same text here", "en", "a", 1, 3), (2, "x " * 60_000, "en", None, 0, None)]
    folder = save(spark, tmp_path, "documents", rows, DOCS + ", shard int")
    save(spark, tmp_path, "benchmark", [(1, None)], "item_id long, text string")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        out.collect()
    assert corpus_pipeline.run(spark, folder).count() >= 1


def test_bounds_come_from_all_training_texts(spark, monkeypatch):
    """Each held-back text counts, equal ones each for themselves, whatever their number."""
    from pyspark.sql import functions as F

    from chronoloom.llm.common import fold
    from chronoloom.llm.language_id import learn, predict_language

    monkeypatch.setattr(corpus_pipeline, "LOW", 0.05)
    monkeypatch.setattr(corpus_pipeline, "LEAST_SCORED", 50)
    rng = random.Random(5)
    rows = [(i, " ".join(prose(rng.randint(3, 30), rng)) if i % 4 else "the same words", "en", "a", 0) for i in range(150)]
    train = spark.createDataFrame(rows, DOCS).filter(fold("doc_id") != 1)
    scores = []
    for mine, other in ((0, 2), (2, 0)):
        profiles = learn(train.filter(fold("doc_id") == other), most=None)
        scores += [r.score for r in predict_language(train.filter(fold("doc_id") == mine), profiles).select(F.col("score")).collect()]
    scores.sort()
    assert corpus_pipeline.least_scores(train) == {"en": scores[int(len(scores) * 0.05)]}
