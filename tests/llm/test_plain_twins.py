"""Operators that SQL can't express against plain loops from their definitions; passes over large benchmarks."""

import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from chronoloom.llm import decontamination, language_id, quality
from tests.conftest import spark_rows
from tests.llm.test_native_ops import DOCS, ODD_DOCS
from tests.llm.test_python_ops import BENCH, contaminated_docs

# --- language: bind, rotate, bundle, cosine


def plain_letter(code, dimensions, seed):
    return [2 * int(b) - 1 for b in np.random.default_rng([seed, code]).integers(0, 2, dimensions)]


def plain_trigrams(text):
    letters = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text)
    padded = " " + " ".join(letters.split()) + " "
    return Counter(padded[i : i + 3] for i in range(len(padded) - 2)) if letters.strip() else Counter()


def plain_bundle(text, dimensions, seed):
    total = [0] * dimensions
    for gram, n in plain_trigrams(text).items():
        a, b, c = (plain_letter(ord(x), dimensions, seed) for x in gram)
        for d in range(dimensions):
            total[d] += n * a[(d - 2) % dimensions] * b[(d - 1) % dimensions] * c[d]
    return total


def unit(v):
    size = math.sqrt(sum(x * x for x in v))
    return [x / size for x in v] if size else v


def plain_cosines(text, prototypes, dimensions, seed):
    """Cosines of a text with prototypes after what all of them share is taken out."""
    units = [unit(p) for p in prototypes]
    shared = unit([sum(x) / len(units) for x in zip(*units, strict=True)])
    apart = lambda v: unit([x - sum(p * q for p, q in zip(v, shared, strict=True)) * s for x, s in zip(v, shared, strict=True)])
    found = apart(plain_bundle(text, dimensions, seed))
    return [sum(p * q for p, q in zip(found, apart(u), strict=True)) for u in units]


def test_bundles_are_the_plain_ones():
    space = language_id.Space(64, 5)
    for text in ("abc", "a", "Ab  c-d é ß", "日本語 x", "İstanbul ǅ", "aaa aaa aaa"):
        assert space.bundle(*language_id.trigrams(text)).tolist() == plain_bundle(text, 64, 5)
    assert not len(language_id.trigrams("12 -- 3")[0]) and not plain_trigrams("12 -- 3")


def test_predictions_are_the_plain_ones():
    rng = random.Random(6)
    alphabets = {"a": "abcde", "b": "defgh", "c": "zyxwva"}
    words = lambda k, n: " ".join("".join(rng.choices(alphabets[k], k=rng.randint(2, 6))) for _ in range(n))
    prototypes = [plain_bundle(words(k, 60), 128, 5) for k in alphabets]
    profiles = language_id.Profiles(list(alphabets), np.array(prototypes, float), 128, 5)
    texts = [words(rng.choice("abc"), rng.randint(1, 12)) for _ in range(25)] + ["", None, "123"]
    names, scores = profiles.predict(texts)
    for text, name, score in zip(texts, names, scores, strict=True):
        if not plain_trigrams(text or ""):
            assert (name, score) == ("und", 0.0)
            continue
        cosines = plain_cosines(text, prototypes, 128, 5)
        assert score == pytest.approx(min(1.0, max(0.0, max(cosines))), abs=1e-4)
        assert cosines[list(alphabets).index(name)] == pytest.approx(max(cosines), abs=1e-4)


# --- quality: the risk and its gradient


def plain_risk(gp, gu, prior):
    loss = lambda g: 1 / (1 + math.exp(g))
    good = prior * sum(map(loss, gp)) / len(gp)
    bad = sum(loss(-g) for g in gu) / len(gu) - prior * sum(loss(-g) for g in gp) / len(gp)
    return good, bad


@pytest.mark.parametrize(("shift", "prior"), [(0.0, 0.4), (-3.0, 0.9)])
def test_slopes_are_those_of_the_risk(shift, prior):
    rng = np.random.default_rng(3)
    gp, gu = rng.normal(1, 1, 7).tolist(), rng.normal(shift, 1, 9).tolist()
    negative = plain_risk(gp, gu, prior)[1] < 0
    assert negative == (shift < 0)
    value = (lambda p, u: -plain_risk(p, u, prior)[1]) if negative else (lambda p, u: sum(plain_risk(p, u, prior)))
    found = quality.risk_slopes(np.array(gp), np.array(gu), prior)
    for k in range(16):
        both = [gp + gu, gp + gu]
        sides = []
        for side, step in ((0, 1e-6), (1, -1e-6)):
            moved = list(both[side])
            moved[k] += step
            sides.append(value(moved[:7], moved[7:]))
        assert found[k] == pytest.approx((sides[0] - sides[1]) / 2e-6, abs=1e-7)


def test_gradient_of_the_net():
    rng = np.random.default_rng(4)
    x, by = rng.normal(0, 1, (6, 4)), rng.normal(0, 1, 6)
    net = quality.Net.new(x, rng)
    for w, d in zip(net.weights, net.gradient(x, by), strict=True):
        for at in list(np.ndindex(w.shape))[:20]:
            old = w[at]
            w[at] = old + 1e-6
            up = float(net(x) @ by)
            w[at] = old - 1e-6
            down = float(net(x) @ by)
            w[at] = old
            assert d[at] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_lexical_numbers(monkeypatch):
    monkeypatch.setattr(quality, "KEPT_WORDS", 1)
    out = [0.0] * quality.LEXICAL
    for word, n in (("ab", 3), ("é", 1)):
        hashed = crc32(word.encode())
        out[hashed % quality.LEXICAL] += n / 2 * (1 if hashed >= 1 << 31 else -1)
    assert quality.features("AB ab\nab É")[-quality.LEXICAL :] == pytest.approx(out)
    assert len(quality.features("")) == len(quality.features("x y")) and not any(quality.features(None))


def test_rows_of_one_id_are_drawn_by_their_texts(spark, monkeypatch):
    """An id with most of the rows, and copies of one row in great number, don't fill the sample."""
    monkeypatch.setattr(quality, "MAX_POSITIVE", 40)
    monkeypatch.setattr(quality, "MAX_UNLABELLED", 60)
    seen = []
    monkeypatch.setattr(quality, "fit", lambda p, u, **_: (seen.append((len(p), len(u), p.tobytes(), u.tobytes())), (None, 0.5))[1])
    rows = [(7, f"text {i} of one id", "en", "s", 0) for i in range(2000)] + [(8, "the same", "en", "s", 0)] * 2000 + [(i, f"other {i}", "en", "s", 0) for i in range(100, 400)] + ODD_DOCS
    labels = spark.createDataFrame([(7, 1, 0), (8, 1, 0), *((i, 1, 0) for i in range(100, 200)), (3, 1, 0)], "doc_id long, quality int, toxic int")
    for order, parts in ((rows, 2), (rows[::-1], 5)):
        quality.train(spark.createDataFrame(order, DOCS).repartition(parts), labels)
    assert seen[0] == seen[1]
    assert 2 <= seen[0][0] <= 80 and 2 <= seen[0][1] <= 120


# --- decontamination: one block at a time


def test_passes_hold_one_block(spark):
    pairs = decontamination.windows(spark.createDataFrame(BENCH, "item_id long, text string"), "item_id", "text", 10)
    held, blocks = [], []
    for shared, last in decontamination._passes(pairs, 7):
        held.append(shared)
        blocks += shared.value
        assert [x._jbroadcast.isValid() for x in held] == [False] * (len(held) - 1) + [True]
    assert len(held) > 2 and last and sorted(blocks) == sorted((r.window, r.item) for r in pairs.collect())


def test_many_blocks_give_the_same(spark):
    docs, bench = spark.createDataFrame(contaminated_docs(), DOCS), spark.createDataFrame(BENCH, "item_id long, text string")
    want = spark_rows(decontamination.find_contamination(docs, bench))
    assert want == spark_rows(decontamination.find_contamination(docs, bench, max_pairs=3))
    clean = {i for (i, n) in ((r.doc_id, r.n_hit) for r in decontamination.find_contamination(docs, bench).collect()) if not n}
    assert {r.doc_id for r in decontamination.remove_contaminated(docs, bench, max_pairs=3).collect()} == clean
