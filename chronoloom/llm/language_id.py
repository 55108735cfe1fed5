"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point; so has the blank that
stands between words. A trigram's vector is the product of its letters' vectors, the first
rotated twice and the second once. A text's vector is the sum over its trigrams; a language's
prototype is the sum over training texts. The predicted language is the prototype with the largest
cosine to the text's vector, after the part that all prototypes share is taken from both.

Training: counts of trigrams by language over a sample of at most about `TRAIN_PER_LANGUAGE`
texts a language (chosen by a hash of the id), summed by Spark; the prototypes, one vector a
language, are all that is broadcast. Prediction runs where the texts are, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, give_back, require, seeded, seeded_number, table

DIMENSIONS = 1024
TRAIN_PER_LANGUAGE = 4000
#: More languages than this are an error, so that the prototypes have a bound (4 KB each).
MAX_LANGUAGES = 10_000
#: Trigram vectors that a worker keeps, 1 KB each, and how many are summed at once.
CACHED, AT_ONCE = 20_000, 2048
SEED = 11
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letter_codes() -> np.ndarray:
    """For each code point: the code point of its lower case if it's a letter, else the blank's."""
    out = np.full(0x110000, 32, np.int32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of letters, three code points in a number, and their counts; words are set off by blanks."""
    codes = letter_codes()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    if not len(codes) or not (codes != 32).any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.concatenate(([32], codes, [32]))
    codes = codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))].astype(np.int64)
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.unique(codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:], return_counts=True)


class Space:
    """Vectors of letters and trigrams."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.dimensions, self.seed = dimensions, seed
        self.letters: dict[int, np.ndarray] = {}
        self.place: dict[int, int] = {}
        self.rows = np.zeros((CACHED, dimensions), np.int8)

    def letter(self, code: int) -> np.ndarray:
        found = self.letters.get(code)
        if found is None:
            bits = np.random.default_rng([self.seed, code]).integers(0, 2, self.dimensions)
            found = self.letters[code] = (bits * 2 - 1).astype(np.int8)
        return found

    def trigram(self, key: int) -> np.ndarray:
        a, b, c = self.letter(key >> 42), self.letter(key >> 21 & 0x1FFFFF), self.letter(key & 0x1FFFFF)
        return np.roll(a, 2) * np.roll(b, 1) * c

    def bundle(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of the trigrams' vectors, each times its count."""
        total = np.zeros(self.dimensions, np.float32)
        for i in range(0, len(keys), AT_ONCE):
            some = keys[i : i + AT_ONCE].tolist()
            missing = [k for k in some if k not in self.place]
            if len(self.place) + len(missing) > CACHED:
                self.place.clear()
                missing = some
            for k in missing:
                self.rows[len(self.place)] = self.trigram(k)
                self.place[k] = len(self.place)
            at = np.fromiter(map(self.place.__getitem__, some), np.int64, len(some))
            total += counts[i : i + AT_ONCE].astype(np.float32) @ self.rows[at].astype(np.float32)
        return total


@lru_cache(maxsize=1)
def space(dimensions: int, seed: int) -> Space:
    return Space(dimensions, seed)


class Profiles:
    """Prototypes of languages, with the shared part taken out."""

    def __init__(self, names: list[str], vectors: np.ndarray, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.names, self.dimensions, self.seed = names, dimensions, seed
        if not names:
            return
        units = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
        mean = units.mean(axis=0)
        self.shared = (mean / max(float(np.linalg.norm(mean)), 1e-9)).astype(np.float32)
        self.own = self.apart(units.astype(np.float32)) if len(names) > 1 else units.astype(np.float32)

    def apart(self, vectors: np.ndarray) -> np.ndarray:
        rest = vectors - (vectors @ self.shared)[:, None] * self.shared
        return rest / np.maximum(np.linalg.norm(rest, axis=1, keepdims=True), 1e-9)

    def predict(self, texts: Iterable[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for text in texts:
            keys, counts = trigrams(text or "")
            name, score = UNKNOWN, 0.0
            if len(keys) and self.names:
                found = space(self.dimensions, self.seed).bundle(keys, counts)[None, :]
                found = self.apart(found) if len(self.names) > 1 else found / np.linalg.norm(found)
                cosines = (found @ self.own.T)[0]
                best = int(cosines.argmax())
                name, score = self.names[best], float(min(1.0, max(0.0, cosines[best])))
            names.append(name)
            scores.append(score)
        return names, scores


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", most: int | None = TRAIN_PER_LANGUAGE) -> Profiles:
    """Profiles from the rows of `df` that have a language. Rows are sampled by a hash of the id,
    with a rate for each language that leaves about `most` of them; None takes all. More than `MAX_LANGUAGES`
    languages are an error; without any there are no profiles, and all texts are `und`."""
    known = df.filter(F.col(lang_col).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang_col).count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"{lang_col} has more than {MAX_LANGUAGES} languages")
    if not sizes:
        return Profiles([], np.zeros((0, DIMENSIONS)))
    drawn = known
    if most is not None:
        rate = F.element_at(F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, min(1.0, most / v))]), F.col(lang_col))
        drawn = known.filter(seeded_number(seeded(id_col, SEED)) % 1_000_003 < rate * 1_000_003)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        vectors = space(DIMENSIONS, SEED)
        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
                keys, counts = trigrams(text.as_py() or "")
                if len(keys):
                    got = vectors.bundle(keys, counts)
                    name = lang.as_py()
                    totals[name] = totals.get(name, 0) + np.round(got / np.linalg.norm(got) * 1e6).astype(np.int64)
        give_back()
        if totals:
            rows = pa.array([v.tolist() for v in totals.values()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), rows], ["lang", "vector"])

    parts = drawn.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(count, "lang string, vector array<long>")
    sums = parts.select("lang", F.posexplode("vector").alias("d", "v")).groupBy("lang", "d").agg(F.sum("v").alias("v"))
    rows = sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "v"))), lambda x: x["v"]).alias("vector")).collect()
    rows.sort(key=lambda r: r.lang)
    return Profiles([r.lang for r in rows], np.array([r.vector for r in rows], np.float64).reshape(len(rows), DIMENSIONS))


def predict_language(df: DataFrame, profiles: Profiles, text_col: str = "text", name_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """`df` with the predicted language and its cosine (0 to 1). Null texts and those without a letter: `und`, 0.

    Columns of those names are replaced; the others stay as they are. Whole texts are read; nothing is shuffled.
    """
    require(df, text_col)

    @F.arrow_udf("name string, score double")
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            names, scores = profiles.predict(t.as_py() for t in texts)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["name", "score"])
        give_back()

    found = df.withColumn("__found", predicted(F.col(text_col)))
    return found.withColumn(name_col, F.col("__found.name")).withColumn(score_col, F.col("__found.score")).drop("__found")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = learn(docs.filter(fold("doc_id") != 1))
    return predict_language(docs.select("doc_id", "text"), profiles).select("doc_id", (fold("doc_id") == 1).alias("held_out"), "lang_pred", "score")
