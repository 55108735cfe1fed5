"""Cards as a user cuts them: examples and decisions against plain loops along a recording."""

import random

import pytest
from pyspark.sql import functions as F

from chronoloom.functions.text import OPENER_WORDS, WEAK_TRAILING_WORDS
from chronoloom.operators import style
from chronoloom.plans import style as plans

WORDS = "media_id long, i long, word string, start_ms long, end_ms long, segment_end boolean"
POOL = ["mas", "de", "casa", "foi.", "sim,", "entao", "que", "longo", "a", "hoje!", "e", "bem;"]


def recording(seed, n, media=1):
    rng, at, rows = random.Random(seed), 0, []
    for i in range(n):
        end = at + rng.randrange(50, 600)
        rows.append((media, i, rng.choice(POOL), at, end, rng.random() < 0.1))
        at = end + rng.choice([0, 0, 60, 200, 900])
    return rows


def plain_features(rows, start, i):
    """What a gap looks like in a card that begins at `start`."""
    word, following = rows[i], rows[min(i + 1, len(rows) - 1)]
    window = rows[max(0, i - 4) : i + 1]
    span = window[-1][4] - window[0][3]
    bare = lambda w: w.strip(".,;!")
    mark = 2 if word[2][-1] in ".!" else 1 if word[2][-1] in ",;" else 0
    return [
        max(0, following[3] - word[4]), i - start + 1, word[4] - rows[start][3], len(" ".join(r[2] for r in rows[start : i + 1])), float(bare(word[2]) in WEAK_TRAILING_WORDS), mark,
        float(bare(following[2]) in OPENER_WORDS), float(word[5]), len(window) * 1000 / span if span > 0 else 0.0,
    ]


def plain_examples(rows, card, label, cut):
    """The loop over gaps with the user's card as its state."""
    out, start, now, crossed = [], 0, card[0], False
    for i in range(len(rows) - 1):
        crossed |= cut[i]
        if label[i] is not None:
            if not crossed:
                out.append((i, plain_features(rows, start, i), float(label[i])))
            if label[i]:
                start, now, crossed = i + 1, card[i + 1], False
        elif card[i + 1] is not None and card[i + 1] != now:
            if now is not None:
                start, crossed = i + 1, False
            now = card[i + 1]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_examples_are_those_of_the_loop(spark, seed):
    rng = random.Random(seed)
    rows = recording(seed, 120)
    number, true = 0, []
    for _ in rows:
        true.append(number)
        number += rng.random() < 0.3
    card = [None if rng.random() < 0.2 else c for c in true]
    label = [None if a is None or b is None or rng.random() < 0.1 else int(a != b) for a, b in zip(card, [*card[1:], None], strict=True)]
    cut = [rng.random() < 0.05 for _ in rows]
    words = spark.createDataFrame([*rows, *recording(9, 3, 2)], WORDS)
    alignment = spark.createDataFrame([(1, i, c, y, x) for i, (c, y, x) in enumerate(zip(card, label, cut, strict=True))], "media_id long, i long, card long, label int, cut boolean")
    got = sorted((r.i, list(r.x), r.y) for r in style.gap_examples(words, alignment).collect())
    want = plain_examples(rows, card, label, cut)
    assert [(i, y) for i, _, y in got] == [(i, y) for i, _, y in want] and want
    for (_, a, _), (_, b, _) in zip(got, want, strict=True):
        assert a == pytest.approx(b)


def chance(x):
    """A tree by hand: marks, long pauses in cards of three words or more, much text."""
    return 0.9 if x[5] == 2 or (x[0] >= 200 and x[1] >= 3) or x[3] > 22 else 0.2


def plain_ends(rows, least, most, most_ms):
    out, start = [], 0
    for i in range(len(rows) - 1):
        n, lasts = i - start + 1, rows[i][4] - rows[start][3]
        if n >= least and (n >= most or lasts >= most_ms or chance(plain_features(rows, start, i)) >= 0.5):
            out.append(i)
            start = i + 1
    return out


@pytest.mark.parametrize(("least", "most", "most_ms", "stretch"), [(2, 7, 2600, 256), (1, 4, 900, 8), (3, 6, 10**9, 1), (1, 1, 500, 5), (2, 12, 3000, 16)])
def test_decisions_are_those_of_the_loop(spark, monkeypatch, least, most, most_ms, stretch):
    expression = F.when((F.get("x", F.lit(5)) == 2) | ((F.get("x", F.lit(0)) >= 200) & (F.get("x", F.lit(1)) >= 3)) | (F.get("x", F.lit(3)) > 22), 0.9).otherwise(0.2)
    monkeypatch.setattr(style, "probabilities", lambda model, rows: rows.withColumn("probability", expression))
    made = {m: recording(m, n, m) for m, n in ((1, 150), (2, 1), (3, 2), (4, 37))}
    words = spark.createDataFrame([r for rows in made.values() for r in rows], WORDS)
    ends = style.card_ends(style.decisions(words, None, least, most, most_ms), most, stretch)
    got = {}
    for r in ends.collect():
        got.setdefault(r.media_id, []).append(r.i)
    want = {m: e for m, rows in made.items() if (e := plain_ends(rows, least, most, most_ms))}
    assert {m: sorted(e) for m, e in got.items()} == want
    cards = style.styled_cards(words, ends).filter("media_id = 4").orderBy("card").collect()
    assert [c["last"] for c in cards] == [*want.get(4, []), 36] and " ".join(c.text for c in cards) == " ".join(r[2] for r in made[4])


def test_a_tree_learns_where_cards_end(spark):
    f1 = {r.part: r.f1 for r in plans.tree_model(spark, "/root/testdata/sf0.01").collect()}
    assert set(f1) == {"train", "test"} and all(v > 7000 for v in f1.values())


def test_a_gap_stays_one_row_whatever_the_states(spark):
    words = spark.createDataFrame(recording(5, 60), WORDS)
    steps = style.decisions(words, None, 1, 14, 8000)
    plan = steps._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan  # 14 rows a gap were sorted, and spilled, to be gathered again
    rows = steps.orderBy("place").collect()
    assert [len(r.next) for r in rows] == [min(k + 1, 14) for k in range(59)]
