"""Edit plans against a plain loop; rules on lines, groups, names, sentences and SRT with values written out."""

import random

import pytest
from pyspark.sql import functions as F

from chronoloom.operators import cards, editplan, glossary_rules, validate
from chronoloom.sources import captions

PHRASES = "media_id long, i long, start_ms long, end_ms long, score double, ends boolean, pause_ms double"


def planned(spark, rows, retakes=(), target=10**9):
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], PHRASES)
    found = spark.createDataFrame([(1, first, p) for first, p in retakes], "media_id long, first long, probability double")
    plan = editplan.decided(df, found, target)
    ranges = sorted((r.start_ms, r.end_ms) for r in editplan.planned_ranges(plan).collect())
    return ranges, {r.i: r.reason for r in plan.collect() if not r.kept}, plan


def test_ranges_are_padded_and_pauses_cut(spark):
    # a pause of 1 s keeps 200 ms, 110 behind it and 90 before; the ends are padded by 120 ms
    ranges, gone, _ = planned(spark, [(k * 5000, k * 5000 + 4000, 0.5, True, 200.0) for k in range(3)], target=600_000)
    assert ranges == [(0, 4090), (4890, 9090), (9890, 14120)] and not gone
    ranges, _, _ = planned(spark, [(1000, 2900, 0.5, True, None), (3900, 5000, 0.5, True, None)])
    assert ranges == [(880, 3035), (3735, 5120)]
    # beside a removed phrase the pad is used, but not more than the pause
    ranges, gone, _ = planned(spark, [(0, 1000, 0.5, True, None), (1050, 2000, 0.5, True, None), (2500, 3000, 0.5, True, None)], [(1, 0.5), (0, 0.4)])
    assert ranges == [(0, 1050), (2380, 3120)] and gone == {1: "retake"}
    # ranges that touch are one
    assert planned(spark, [(0, 1000, 0.5, True, None), (1250, 2000, 0.5, True, None)])[0] == [(0, 2120)]


def test_the_weakest_go_until_the_target(spark):
    rows = [(k * 5000, k * 5000 + 4000, 0.9 if k % 2 == 0 else 0.2, True, 200.0) for k in range(10)]
    ranges, gone, _ = planned(spark, rows, target=22_000)
    assert all(start % 10_000 in (0, 9880) for start, _ in ranges) and set(gone) == {1, 3, 5, 7, 9}
    assert sum(e - s for s, e in ranges) <= 22_000 * 1.05


def test_what_prepares_a_strong_phrase_stays(spark):
    rows = [(0, 4000, 0.1, False, None), (4500, 8500, 0.95, True, None), (9000, 13000, 0.1, True, None), (13500, 17500, 0.1, True, None)]
    ranges, gone, _ = planned(spark, rows, target=8100)
    assert set(gone) == {2, 3} and ranges == [(0, 4135), (4335, 8620)]


def plain_plan(rows, retakes, target):
    """The plan as a loop that makes all ranges anew after each removal."""
    keep = [k not in {f for f, p in retakes if p >= 0.5} for k in range(len(rows))]
    why = {k: "retake" for k, x in enumerate(keep) if not x}
    pause = []
    for a, b in zip(rows, rows[1:], strict=False):
        gap = b[0] - a[1]
        pause.append(min(gap, 300) if a[4] is None else max(0, min(gap, round(a[4]))))

    def ranges():
        out = []
        for k, (start, end, *_) in enumerate(rows):
            if not keep[k]:
                continue
            low = round((start * 100 - 55 * pause[k - 1]) / 100) if k and keep[k - 1] else max(0, start - min(120, start - (rows[k - 1][1] if k else 0)))
            last = k + 1 == len(rows)
            high = round((end * 100 + 45 * pause[k]) / 100) if not last and keep[k + 1] else end + (120 if last else min(120, rows[k + 1][0] - end))
            if out and low - out[-1][1] <= 1:
                out[-1] = (out[-1][0], max(high, out[-1][1]))
            else:
                out.append((low, high))
        return out

    for k in sorted(range(len(rows)), key=lambda k: (rows[k][2], k)):
        if sum(e - s for s, e in ranges()) <= target * 1.05:
            break
        guards = k + 1 < len(rows) and keep[k + 1] and rows[k + 1][2] >= 0.8 and rows[k + 1][0] - rows[k][1] < 700 and not rows[k][3]
        if keep[k] and not guards:
            keep[k], why[k] = False, "weak"
    return ranges(), why


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_the_plain_one(spark, seed):
    rng = random.Random(seed)
    given, at = {}, 0
    for media in range(12):
        rows, at = [], rng.randrange(0, 300)
        for _ in range(rng.randrange(1, 40)):
            end = at + rng.randrange(2, 4000)
            rows.append((at, end, rng.choice([rng.random(), 0.85, 0.9, 0.3]), rng.random() < 0.5, rng.choice([None, rng.random() * 500])))
            at = end + rng.choice([0, 1, 40, 200, 300, 302, 699, 700, 1500])
        given[media] = rows, [(k, rng.random()) for k in range(0, len(rows), 5)]
    target = rng.choice([1000, 8000, 20_000])
    df = spark.createDataFrame([(m, i, *r) for m, (rows, _) in given.items() for i, r in enumerate(rows)], PHRASES)
    pairs = spark.createDataFrame([(m, f, p) for m, (_, ps) in given.items() for f, p in ps], "media_id long, first long, probability double")
    plan = editplan.decided(df, pairs, target)
    got = {m: ([], {}) for m in given}
    for r in plan.collect():
        if r.reason:
            got[r.media_id][1][r.i] = r.reason
    for r in editplan.planned_ranges(plan).collect():
        got[r.media_id][0].append((r.start_ms, r.end_ms))
    assert {m: (sorted(a), b) for m, (a, b) in got.items()} == {m: plain_plan(rows, ps, target) for m, (rows, ps) in given.items()}


def test_zooms_begin_in_their_phrase_and_keep_their_distance(spark):
    rows = [(k * 5000, k * 5000 + (200 if k == 12 else 4000), 0.5, True, None) for k in range(20)]
    _, _, plan = planned(spark, rows)
    ranges = editplan.planned_ranges(plan)
    chance = plan.withColumn("probability", F.when(F.col("i").isin(3, 4, 12), 0.9).otherwise(0.15))
    got = sorted((r.i, r.start_ms, r.end_ms) for r in editplan.chosen_zooms(chance, ranges, 1.2, 6000, 600, 1300).collect())
    assert got == [(3, 17_700, 19_000), (12, 60_000, 60_200)]  # 4 is too near to 3; the short phrase is zoomed as a whole
    assert editplan.chosen_zooms(chance, ranges, 0.1, 6000, 600, 1300).count() == 0
    near = [(r.i, r.start_ms) for r in editplan.chosen_zooms(chance, ranges, 9.0, 100, 600, 1300).collect()]
    assert sorted(near) == [(3, 17_700), (4, 22_700), (12, 60_000)]  # below the floor nothing is chosen


def test_markers_stand_where_something_went(spark):
    rows = [(0, 1000, 0.1, True, None), (2000, 3000, 0.1, True, None), (4000, 5000, 0.9, True, None), (6000, 7000, 0.1, True, None)]
    _, gone, plan = planned(spark, rows, [(0, 1.0), (1, 1.0), (3, 0.9)])
    marks = editplan.removal_markers(plan, editplan.planned_ranges(plan)).collect()
    assert sorted((m.t_ms, m.reason) for m in marks) == [(0, "retake"), (1240, "retake")] and set(gone) == {0, 1, 3}


@pytest.mark.parametrize(
    ("source", "back", "found"),
    [
        ("eu não vi", "eu vi", "source: não"),
        ("ninguém sabe", "sabem", "source: ninguém"),
        ("Faltou alguém abrir", "alguém ainda abriu", "source: faltou"),
        ("ela abriu", "ela NAO abriu", "target: nao"),
        ("sem pressa", "nunca corre", None),
        ("vai nadar", "vai nadar", None),
        ("o senão da casa", "a casa", None),
        ("", None, None),
    ],
)
def test_negations(spark, source, back, found):
    df = spark.createDataFrame([(source, back)], "a string, b string")
    assert df.select(validate.negation_mismatch(F.col("a"), F.coalesce("b", F.lit(""))).alias("m")).first().m == found


def violations(spark, groups, texts, characters=None, target="zh"):
    g = spark.createDataFrame([(1, *row) for row in groups], "media_id long, group long, cards array<long>, start_ms long, end_ms long, line string, flag string")
    c = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "media_id long, card long, text string")
    cast = characters and spark.createDataFrame([(1, *x) for x in characters], "media_id long, name string, variants array<string>, rendering string, gender string")
    return sorted((r.rule, r.detail) for r in validate.group_violations(g, c, cast, target).collect())


def test_groups(spark):
    fine = (0, [0, 1], 0, 1200, "很好的一天", "")
    assert violations(spark, [fine], ["a", "b"]) == []
    assert violations(spark, [(0, [1, 0], 0, 1199, "长" * 21, None)], ["a", "b"]) == [("long", "0"), ("order", "0"), ("short", "0")]
    assert violations(spark, [(0, [1], 0, 2000, "好", ""), (1, [0], 0, 2000, "好", "")], ["a", "b"]) == [("order", "1")]
    # with a card missing, the order isn't judged
    assert violations(spark, [(0, [2, 0, 0, 9], 0, 2000, "好", "")], ["a", "b", "c"]) == [("missing", "1"), ("repeated", "0"), ("unknown", "9")]
    assert violations(spark, [(0, [0], 0, 2000, ",ABC", "slow")], ["a"]) == [("flag", "0: slow"), ("marks", "0"), ("script", "0")]
    assert violations(spark, [(0, [0], 0, 2000, "Good, isn't it? " * 9, "")], ["a"], target="en") == []


def test_groups_with_a_glossary(spark):
    cast = [("Rui Costa", [], "鲁伊科", "male"), ("Marta", ["Martinha"], "玛塔", "female")]
    of = lambda line, text: violations(spark, [(0, [0], 0, 2000, line, "")], [text], cast)
    assert of("她走了", "o Rui Costa foi") == [("pronoun", "0: Rui Costa")]
    assert of("她走了", "ela viu o Rui Costa") == []
    assert of("鲁伊科想嫁给她", "Rui Costa quer") == [("marriage_subject", "0: 嫁给"), ("pronoun", "0: Rui Costa")]
    assert of("嫁给了玛塔", "casou com a Marta") == [("marriage_object", "0: 嫁给")]
    assert of("玛塔来了", "o Rui Costa veio") == [("swap", "0: Rui Costa")]
    assert of("鲁伊斯和玛塔娜", "Rui Costa e Martinha") == [("spelling", "0: 玛塔娜|鲁伊斯")]


def test_gender_of_names_of_several_words(spark):
    lines = spark.createDataFrame([(1, "a Maria Clara viu a irma dela"), (1, "Maria e Clara"), (1, "o Joao foi com ele"), (2, "o MARIA CLARA")], "media_id long, text string")
    names = spark.createDataFrame([(1, "Maria Clara"), (1, "Joao"), (1, "Maria"), (2, "Maria Clara"), (2, "Joao"), (1, "?")], "media_id long, name string")
    got = {(r.media_id, r.name): (r.gender, r.male, r.female) for r in glossary_rules.inferred_gender(lines, names).collect()}
    assert got == {
        (1, "Maria Clara"): ("female", 0, 4), (1, "Joao"): ("male", 2, 0), (1, "Maria"): ("female", 0, 4), (1, "?"): ("unknown", 0, 0),
        (2, "Maria Clara"): ("male", 1, 0), (2, "Joao"): ("unknown", 0, 0),
    }


def test_srt_with_any_line_ends(spark):
    text = "1\n00:00:01,000 --> 00:00:02,000\nOne\ntwo\n\n2\n00:00:03,000-->00:00:04,500 \nThree\n\n\n3\n\n4\n00:00:09,000\n"
    for end in ("\n", "\r\n", "\r"):
        got = captions.srt_entries(spark.createDataFrame([("p", ("\n " + text).replace("\n", end))], "path string, value string")).orderBy("pos").collect()
        assert [(r.start, r.end, r.text) for r in got] == [("00:00:01,000", "00:00:02,000", "One\ntwo"), ("00:00:03,000", "00:00:04,500", "Three"), ("00:00:09,000", None, "")]
    assert captions.srt_entries(spark.createDataFrame([("p", " \n\n "), ("q", None)], "path string, value string")).count() == 0


def buckets(*texts, seconds=2.0):
    return cards.sentence_buckets([(t, k * seconds, (k + 1) * seconds) for k, t in enumerate(texts)])


def test_sentences_by_bare_words():
    word = sorted(cards.CONTINUATION)[0]
    assert buckets("a b c d e,", f"{word} f g.") == [[0, 1]]
    assert buckets("a b c d e,", f"{word}, f g.") == [[0], [1]]  # with a mark it is another word
    dangling = sorted(cards.DANGLING)[0]
    assert buckets(" ".join("abcdefghijklmn"), "o p.") == [[0], [1]]
    assert buckets(" ".join("abcdefghijklm") + f" {dangling}", "o p.") == [[0, 1]]
    assert buckets("one,", "two", " ".join("abcdefghijkl"), "end.") == [[0], [1, 2, 3]]
    assert buckets() == [] and buckets("x", seconds=0.1) == [[0]]


def test_short_sentences_join_the_shorter_neighbour():
    rows = [("a b c.", 0.0, 2.0), ("d.", 2.0, 2.5), ("e f.", 2.5, 5.0), ("g.", 5.0, 5.2), ("h.", 5.2, 5.4)]
    assert cards.sentence_buckets(rows) == [[0], [1, 2, 3, 4]]
