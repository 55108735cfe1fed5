"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled 1; everything else the training fold holds counts as
unlabelled web text. A text becomes the numbers named in `FEATURES`, which tell its shape, and
`LEXICAL` sums of its words, each hashed to one of them and a sign. On a bounded sample of both kinds (at
most about `MAX_POSITIVE` and `MAX_UNLABELLED` rows, drawn by a hash of id and text) the driver

1. fits a scorer of positives against unlabelled and estimates the class prior as the lowest
   ratio of unlabelled to positive mass above a threshold, on rows not fitted to;
2. minimises the non-negative unbiased risk  pi E_p[l(g)] + max(0, E_u[l(-g)] - pi E_p[l(-g)])
   with the sigmoid loss, by gradient steps that go back where the second part is below 0.

Only the sample's numbers reach the driver. Scoring runs where the texts are.
"""

from __future__ import annotations

from collections import Counter
from operator import eq
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, require, seeded, seeded_number, table, written

MAX_POSITIVE, MAX_UNLABELLED = 20_000, 40_000
HIDDEN, EPOCHS, BATCH, RATE, SEED = 32, 30, 1000, 0.01, 7
#: Lowest share of the positives above a threshold at which the prior is estimated.
LEAST_MASS = 0.2

FEATURES = (
    "log_length letters upper digits spaces newlines stops bangs bars marks symbols distinct_letters letter_entropy "
    "word_length word_spread distinct_words top_word same_as_before title_words upper_words marked_words "
    "line_length distinct_lines ended_lines short_lines"
).split()


#: Sums that hashed words are added to, and words whose place a worker keeps.
LEXICAL, KEPT_WORDS = 64, 1 << 17
_places: dict[str, tuple[int, int]] = {}


def place(word: str) -> tuple[int, int]:
    """A column and a sign by the hash of the lower-cased word."""
    found = _places.get(word)
    if found is None:
        if len(_places) >= KEPT_WORDS:
            _places.clear()
        hashed = crc32(word.lower().encode("utf-8", "replace"))
        found = _places[word] = (hashed % LEXICAL, 1 if hashed >> 31 else -1)
    return found


def lexical(counts: Counter) -> list[float]:
    """Each word adds or takes 1 in the column its hash names, over the square root of the number of words."""
    out = [0] * LEXICAL
    for word, k in counts.items():
        column, sign = place(word)
        out[column] += sign * k
    root = max(1, sum(counts.values())) ** 0.5
    return [x / root for x in out]


def features(text: str | None) -> list[float]:
    """The numbers of one whole text, all 0 for an empty one."""
    if not text:
        return [0.0] * (len(FEATURES) + LEXICAL)
    n, chars = len(text), Counter(text)
    total = lambda signs: sum(chars[c] for c in signs) / n
    letters = sum(k for c, k in chars.items() if c.isalpha())
    upper = sum(k for c, k in chars.items() if c.isupper())
    spaces = sum(k for c, k in chars.items() if c.isspace())
    digits = sum(k for c, k in chars.items() if c.isdigit())
    counts = np.fromiter(chars.values(), float) / n
    words = text.split()
    seen = Counter(words)
    w = max(1, len(words))
    lengths = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    lines = [x for x in text.split("\n") if x]
    m = max(1, len(lines))
    first = Counter(x[0] for x in words)
    last = Counter(x[-1] for x in words)
    return [
        float(np.log1p(n)), letters / n, upper / max(1, letters), digits / n, spaces / n, chars["\n"] / n,
        total(".,;:?"), chars["!"] / n, chars["|"] / n, total("#$%&*@+=<>{}[]~^_"), (n - letters - digits - spaces) / n,
        len(chars) / n**0.5, float(-(counts * np.log(counts)).sum()),
        float(lengths.mean()), float(lengths.std()), len(seen) / w, seen.most_common(1)[0][1] / w if seen else 0.0,
        sum(map(eq, words, words[1:])) / w, sum(k for c, k in first.items() if c.isupper()) / w,
        sum(k for x, k in seen.items() if x.isupper()) / w, sum(k for c, k in last.items() if not c.isalnum()) / w,
        float(np.log1p(n / m)), len(set(lines)) / m, sum(x[-1] in ".!?…" for x in lines) / m, sum(len(x) < 20 for x in lines) / m,
        *lexical(seen),
    ]


class Net:
    """One hidden layer over standardised numbers."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, weights: list[np.ndarray]):
        self.mean, self.spread, self.weights = mean, spread, weights

    @classmethod
    def new(cls, x: np.ndarray, rng: np.random.Generator) -> Net:
        d = x.shape[1]
        parts = [rng.normal(0, (2 / d) ** 0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        return cls(x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6), parts)

    def inner(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return z, np.maximum(z @ self.weights[0] + self.weights[1], 0)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.inner(x)[1] @ self.weights[2] + self.weights[3]

    def gradient(self, x: np.ndarray, by: np.ndarray) -> list[np.ndarray]:
        """Of the weights, where `by` is the risk's derivative by each row's output."""
        z, h = self.inner(x)
        back = np.outer(by, self.weights[2]) * (h > 0)
        return [z.T @ back, back.sum(axis=0), h.T @ by, np.array([by.sum()])]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def descend(net: Net, p: np.ndarray, u: np.ndarray, slopes, rng: np.random.Generator) -> Net:
    """Adam over batches that hold positives and unlabelled rows in their proportion."""
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in net.weights]
    batches = max(1, (len(p) + len(u)) // BATCH)
    t = 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS) + 1e-4
        for a, b in zip(np.array_split(rng.permutation(len(p)), batches), np.array_split(rng.permutation(len(u)), batches), strict=True):
            if not len(a) or not len(b):
                continue
            x = np.concatenate((p[a], u[b]))
            g, t = net(x), t + 1
            for w, m, d in zip(net.weights, moments, net.gradient(x, slopes(g[: len(a)], g[len(a) :])), strict=True):
                d = d + 1e-4 * w
                m[0] = 0.9 * m[0] + 0.1 * d
                m[1] = 0.999 * m[1] + 0.001 * d * d
                w -= rate * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.999**t)) + 1e-8)
    return net


def class_prior(p: np.ndarray, u: np.ndarray, rng: np.random.Generator) -> float:
    """Share of positives among the unlabelled: the lowest ratio of their masses above a threshold."""
    half = lambda x: (x[: len(x) // 2], x[len(x) // 2 :])
    (p_fit, p_test), (u_fit, u_test) = half(p), half(u)
    slopes = lambda gp, gu: np.concatenate((-sigmoid(-gp) / len(gp), sigmoid(gu) / len(gu)))
    net = descend(Net.new(np.concatenate((p_fit, u_fit)), rng), p_fit, u_fit, slopes, rng)
    gp, gu = np.sort(net(p_test)), np.sort(net(u_test))
    cuts = np.quantile(gp, np.linspace(0, 1 - LEAST_MASS, 200))
    above_p = 1 - np.searchsorted(gp, cuts) / len(gp)
    above_u = 1 - np.searchsorted(gu, cuts) / len(gu)
    slack = (np.log(40) / 2 / len(gu)) ** 0.5 + (np.log(40) / 2 / len(gp)) ** 0.5
    best = np.argmin((above_u + slack) / np.maximum(above_p, 1e-9))
    return float(np.clip(above_u[best] / max(above_p[best], 1e-9), 0.02, 0.98))


def risk_slopes(gp: np.ndarray, gu: np.ndarray, prior: float) -> np.ndarray:
    """Derivatives of the non-negative risk by the outputs of positives, then of unlabelled rows; l(g) is sigmoid(-g)."""
    sp, su = sigmoid(gp), sigmoid(gu)
    dp, du = sp * (1 - sp), su * (1 - su)
    rest = su.mean() - prior * sp.mean()  # of l(-g) = sigmoid(g)
    if rest < 0:  # go back: raise the risk of the negative part
        return np.concatenate((prior * dp / len(gp), -du / len(gu)))
    return np.concatenate((-2 * prior * dp / len(gp), du / len(gu)))


def fit(p: np.ndarray, u: np.ndarray, prior: float | None = None, seed: int = SEED) -> tuple[Net, float]:
    """The net of least non-negative risk, and the prior used."""
    rng = np.random.default_rng(seed)
    p, u = p[rng.permutation(len(p))], u[rng.permutation(len(u))]
    if prior is None:
        prior = class_prior(p, u, rng)

    slopes = lambda gp, gu: risk_slopes(gp, gu, prior)
    return descend(Net.new(np.concatenate((p, u)), rng), p, u, slopes, rng), prior


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[Net | None, float]:
    """A net from positives of `labels` and the texts of `docs`; none if there are no positives.

    An id with several labels is a positive if all of them are 1. Rows are drawn by a hash of id and text, alike in every
    run, and rows that repeat both count once; so no id, however often it occurs, brings more than its texts.
    About `MAX_POSITIVE` and `MAX_UNLABELLED` rows are drawn, never more than twice as many.
    """
    require(labels, id_col, label_col)
    good = labels.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(F.coalesce(F.col(label_col), F.lit(0))).alias("__y")).filter("__y = 1")
    text = F.coalesce(F.col(text_col), F.lit("")).alias("__text")
    row = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit(":"), text).cast("binary"))
    rows = docs.select(F.col(id_col).alias("__id"), row.alias("__row"), text)
    keys = written(rows.drop("__text"), "quality-rows")
    trusted = keys.join(good.select(F.col(id_col).alias("__id")), "__id").select("__row")

    def drawn(some: DataFrame, most: int, seed: int) -> list[str]:
        n = some.count()
        place = seeded_number(seeded("__row", seed)) % 1_000_003
        rate = min(1.0, most / max(n, 1)) * 1_000_003
        return [r["__row"] for r in some.filter(place < rate).distinct().orderBy(place, "__row").limit(2 * most).collect()]

    web, positives = set(drawn(keys.select("__row"), MAX_UNLABELLED, SEED + 1)), set(drawn(trusted, MAX_POSITIVE, SEED))
    if not web or not positives:
        return None, 0.0
    wanted = docs.sparkSession.createDataFrame(pd.DataFrame({"__row": sorted(web | positives)}), "__row string")
    sample = rows.select("__row", "__text").join(F.broadcast(wanted), "__row", "left_semi").dropDuplicates(["__row"])
    numbers = F.pandas_udf(lambda texts: pd.Series([features(t) for t in texts]), "array<double>")
    found = sorted((r["__row"], r.x) for r in sample.select("__row", numbers("__text").alias("x")).collect())
    p, u = (np.array([x for key, x in found if key in some], np.float64) for some in (positives, web))
    if len(p) < 2 or len(u) < 2:
        return None, 0.0
    return fit(p, u)


def score_quality(df: DataFrame, net: Net | None, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`df` with a score from 0 to 1 (replacing a column of that name); 0.5 if nothing was learnt.

    A null text scores as an empty one. Whole texts are read; nothing is shuffled.
    """
    require(df, text_col)
    if net is None:
        return df.withColumn(score_col, F.lit(0.5))

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype=float)
        return pd.Series(sigmoid(net(np.array([features(t) for t in texts]))))

    return df.withColumn(score_col, scored(F.col(text_col)))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net, _ = train(docs.filter(fold("doc_id") != 1), labels.filter(fold("doc_id") != 1))
    scored = score_quality(docs.select("doc_id", "text"), net)
    return scored.select("doc_id", (fold("doc_id") == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
