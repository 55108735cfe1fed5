"""Lines fitted to cards, with values written out and against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from chronoloom.operators import lines


@pytest.mark.parametrize(
    ("line", "width", "parts"),
    [
        ("短的一句", 20, ["短的一句"]),
        ("甲" * 15 + "，" + "乙" * 15 + "，" + "丙" * 15, 20, ["甲" * 15, "乙" * 15, "丙" * 15]),
        ("他走了，她来了。我看", 20, ["他走了，她来了。我看"]),
        ("他走了，她来了。我看", 8, ["他走了，她来了", "我看"]),
        ("你去吗？我不去！", 4, ["你去吗？", "我不去！"]),
        ("长" * 9, 8, None),
        ("短，" + "长" * 9, 8, None),
        ("，。", 8, None),
        ("", 8, None),
        ("一句话在这里，", 6, ["一句话在这里"]),
    ],
)
def test_parts_of_a_line(spark, line, width, parts):
    df = spark.createDataFrame([(line,)], "t string")
    assert df.select(lines.line_parts(F.col("t"), width).alias("p")).first().p == parts


def test_connectives(spark):
    df = spark.createDataFrame([("然后，他走了",), ("结果她来了",), ("他然后走",), ("然后",), ("但是。",), ("",)], "t string")
    got = [(r.a, r.b) for r in df.select(lines.opening_connective(F.col("t")).alias("a"), lines.without_connective(F.col("t")).alias("b")).collect()]
    assert got == [("然后", "他走了"), ("结果", "她来了"), (None, "他然后走"), ("然后", "然后"), ("但是", "但是。"), (None, "")]


def fitted(spark, line, cards, width=20, least=1200):
    df = spark.createDataFrame([(line, [(k, s, e) for k, (s, e) in enumerate(cards)])], "line string, cards array<struct<card: long, start_ms: long, end_ms: long>>")
    found = lines.fitted_lines(df, width, least).first().parts
    return None if found is None else [(p.line, p.first, p["last"], p.start_ms, p.end_ms) for p in found]


def test_cards_follow_the_lengths(spark):
    six = [(k * 1000, k * 1000 + 1000) for k in range(6)]
    three = "，".join(c * 10 for c in "甲乙丙")
    assert fitted(spark, three, six, 10) == [("甲" * 10, 0, 1, 0, 2000), ("乙" * 10, 2, 3, 2000, 4000), ("丙" * 10, 4, 5, 4000, 6000)]
    assert fitted(spark, three, six[:2], 10) is None  # fewer cards than parts
    assert fitted(spark, "甲" * 10 + "，" + "乙" * 10, [(0, 1000), (1000, 5000)], 10) is None  # the first would be too short to read
    assert fitted(spark, "好", [(0, 500)]) == [("好", 0, 0, 0, 500)]  # one part takes what there is
    assert fitted(spark, "好", []) is None and fitted(spark, "长" * 30, six) is None
    assert fitted(spark, "甲" * 10 + "，" + "乙" * 2, six, 10) is None  # the last would be too short


def plain_cuts(cards, sizes):
    """Nearest borders, one after the other."""
    if len(cards) < len(sizes):
        return None
    total, begin, length = sum(sizes), cards[0][0], cards[-1][1] - cards[0][0]
    cuts, said = [], 0
    for size in sizes[:-1]:
        said += size
        low, high = (cuts[-1] if cuts else 0) + 1, len(cards) - (len(sizes) - len(cuts) - 1)
        cuts.append(min(range(low, high + 1), key=lambda k: (abs((cards[k][0] - begin) * total - length * said), k)))
    return cuts


def test_cuts_are_the_plain_ones(spark):
    rng = random.Random(5)
    rows = []
    for n in range(120):
        at, cards = 0, []
        for k in range(rng.randrange(1, 12)):
            end = at + rng.randrange(1, 3000)
            cards.append((k, at, end))
            at = end + rng.choice([0, 300])
        rows.append((n, cards, [rng.randrange(1, 20) for _ in range(rng.randrange(1, 6))]))
    df = spark.createDataFrame(rows, "n long, cards array<struct<card: long, start_ms: long, end_ms: long>>, sizes array<int>")
    got = {r.n: r.c for r in df.select("n", lines.card_cuts(F.col("cards"), F.col("sizes")).alias("c")).collect()}
    assert got == {n: plain_cuts([c[1:] for c in cards], sizes) for n, cards, sizes in rows}
