"""Near duplicates in buckets that a template fills: nothing is compared all with all, and no link is lost."""

import random

import numpy as np
import pytest

from chronoloom.llm import near_dedup, similarity_join
from tests.llm.test_python_ops import classes_by_brute_force, prose

SCHEMA = "doc_id long, text string"


def template_texts(n: int, rng: random.Random, shared: int = 70, own: int = 16) -> list[str]:
    template = prose(shared, rng)
    return [" ".join(template + [f"w{rng.getrandbits(40)}" for _ in range(own)]) for _ in range(n)]


def compared(spark, monkeypatch, texts) -> tuple[int, dict]:
    """Text copies that the second step compares, and the classes."""
    seen, real = [], near_dedup.refined_blocks

    def counted(*a):
        blocks = real(*a)
        seen.append(blocks.count())
        return blocks

    monkeypatch.setattr(near_dedup, "refined_blocks", counted)
    got = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()
    return sum(seen), {r.doc_id: r.class_id for r in got}


def test_template_texts_are_not_crossed(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "MEMBERS", 64)
    rng = random.Random(2)
    for n in (300, 600):
        copies, classes = compared(spark, monkeypatch, template_texts(n, rng))
        assert copies == 0 and classes == {i: i for i in range(n)}


def test_copies_under_a_template_are_linked_in_linear_work(spark, monkeypatch):
    """Each own part occurs in three texts, with up to two words changed."""
    monkeypatch.setattr(near_dedup, "MEMBERS", 64)
    rng = random.Random(4)
    made = []
    for n in (100, 200):
        texts = []
        for base in template_texts(n, rng, 60, 40):
            words = base.split()
            for k in range(3):
                edited = list(words)
                for at in rng.sample(range(62, 99), k):
                    edited[at] = f"edit{rng.random()}"
                texts.append(" ".join(edited))
        copies, classes = compared(spark, monkeypatch, texts)
        want = classes_by_brute_force(list(enumerate(texts)))
        assert classes == {i: want[i] for i in range(len(texts))}
        made.append(copies)
    assert 0 < made[1] <= 2.5 * made[0] <= 2.5 * 3 * 300  # a text is in the groups of its own three at most


@pytest.mark.parametrize("members", [4, 16])
def test_no_link_is_lost(spark, monkeypatch, members):
    """Texts with 3 to 30 own words of 90, some of them twice or thrice, around the threshold."""
    rng = random.Random(members)
    texts = []
    template = prose(90, rng)
    for _ in range(70):
        words, at = list(template), rng.randrange(0, 60)
        own = rng.randrange(3, 30)
        words[at : at + own] = prose(own, rng)
        for _ in range(rng.choice([1, 1, 2, 3])):
            again = list(words)
            again[rng.randrange(90)] = rng.choice(template)
            texts.append(" ".join(again[: rng.randrange(70, 91)]))
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, SCHEMA)
    whole = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()}
    plain = classes_by_brute_force(rows)
    assert len(set(plain.values())) > 5 and all(whole[i] == whole[j] for i, j in plain.items())
    monkeypatch.setattr(near_dedup, "MEMBERS", members)
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()} == whole


def test_prefixes_hold_a_common_feature_of_all_that_are_alike():
    rng = np.random.default_rng(7)
    counts = rng.integers(1, 9, 60)
    weight = rng.random(60).astype(np.float32) + 1
    checked = 0
    for _ in range(4000):
        base = rng.random(60) < 0.6
        sets = [base ^ (rng.random(60) < rng.choice([0.02, 0.1])) for _ in "ab"]
        a, b = (np.flatnonzero(s & (counts > 1) | s & base) for s in sets)
        both = np.intersect1d(a, b)
        low, union = weight[both].sum(dtype=float), weight[np.union1d(a, b)].sum(dtype=float)
        for alike, plain in ((len(both) / max(1, len(np.union1d(a, b))) >= 0.8, True), (union and low / union >= 0.8, False)):
            if not alike:
                continue
            shared = np.maximum(counts, 2 * np.isin(np.arange(60), both))
            pa, pb = (similarity_join.prefix(shared[x], x.astype(np.int64), weight[x], np.ones(len(x), bool), 0.8) for x in (a, b))
            met = np.intersect1d(pa[0], pb[0])
            assert len(met)
            k = 1 if plain else 2
            best = max(min(pa[k][list(pa[0]).index(f)], pb[k][list(pb[0]).index(f)]) / (pa[k + 2] + pb[k + 2] - min(pa[k][list(pa[0]).index(f)], pb[k][list(pb[0]).index(f)])) for f in met)
            assert best >= 0.8 - 1e-4
            checked += 1
    assert checked > 300
