"""Token counts by a compiled finite-state tokenizer.

The tokenizer file (byte-level BPE whose words end in a mark) is compiled into a deterministic
transducer over characters. A state knows the kind of run it is in and, for the word so far,
which vocabulary entries could still be going on, with the token before each; that is enough
to say how many tokens any continuation adds. Each transition carries the number it adds to the
count. A blank leads to the start from everywhere, so what a word between blanks adds is kept, too, as one transition. States are compiled when first reached, kept by what they know, and dropped all at once
when there are too many, so memory is bounded; the start state is always there.

Why a state suffices: in BPE, the tokens of a prefix of a word are the tokens of a shorter
prefix and one more, and which one is decided by pairs of neighbours alone. `fits` decides it for
a pair by undoing merges, latest first.

A long text is cut into chunks, which run in parallel as rows. What a chunk does to any state is a
map. At a border (after a blank or a number, or where letters and signs meet, without
apostrophes) every state leads to the same one, so only what stands before a chunk's first border,
its `head`, depends on the state at entry, and only what stands after the last, its `tail`, decides
the state at exit; the count between is fixed. Maps compose associatively: a scan of
`ROUNDS` rounds joins `ARITY` neighbours at a time, in parallel, in groups of that size, until a map a
text is left, which is applied to the start. A head or tail is a part of one word; only a word
longer than a chunk is put together again.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import require, table

#: Characters in a chunk; longer texts are cut.
CHUNK = 1 << 15
#: Maps joined in a group of one round; three rounds are enough for the longest string that Spark has.
ARITY, ROUNDS = 64, 3
#: Compiled transitions a worker keeps, some 100 bytes each.
MAX_TRANSITIONS = 600_000
#: Transitions by a whole word that a worker keeps, and the longest such word.
MAX_WORDS, WORD = 200_000, 32
OVER = 2048

#: White space to the tokenizer's normaliser (fixed values: the Unicode property White_Space).
SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
_TO_SPACE = {ord(c): " " for c in SPACE}
#: What follows an apostrophe in a contraction (fixed values of the vocabulary's pattern).
SHORT, LONG = "stmd", {"r": "e", "v": "e", "l": "l"}


def letters_of_bytes() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Bpe:
    """Merges as numbers: tokens 0-255 are bytes, 256-511 bytes at a word's end, then one per merge in order."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        end = model["end_of_word_suffix"]
        letters = letters_of_bytes()
        number = {c: b for b, c in enumerate(letters)} | {c + end: 256 + b for b, c in enumerate(letters)}
        self.parts: list[tuple[int, int] | None] = [None] * 512
        self.merged: dict[tuple[int, int], int] = {}
        self.spelt: list[tuple[int, ...]] = [(i,) for i in range(512)]
        for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
            pair = number[a], number[b]
            token = self.merged[pair] = len(self.parts)
            number[a + b] = token
            self.parts.append(pair)
            self.spelt.append(self.spelt[pair[0]] + self.spelt[pair[1]])
        #: The vocabulary as a tree: for each node the next by symbol, and the token that ends there.
        self.next: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for token, symbols in enumerate(self.spelt):
            if self.whole(token):
                at = 0
                for s in symbols:
                    if s not in self.next[at]:
                        self.next[at][s] = len(self.next)
                        self.next.append({})
                        self.token.append(-1)
                    at = self.next[at][s]
                self.token[at] = token
        self._fits: dict[tuple[int, int], bool] = {}

    def whole(self, token: int) -> bool:
        """Whether the token's own spelling is tokenised as the token."""
        return self.parts[token] is None or self.fits_now(*self.parts[token], below=token)

    def fits_now(self, left: int, right: int, below: int | None = None) -> bool:
        """Whether two tokens stay apart when they meet: no merge across their border came first.

        Undoes the later of the merges at the border step by step; before each step, a merge
        of the two pieces that comes earlier than the one undone would have taken place. With
        equal ranks the left one comes first. `below`: ignore the merge of the pair itself.
        """
        limit = below if below is not None else len(self.parts)
        while True:
            if self.merged.get((left, right), limit) < limit:
                return False
            first, second = self.parts[left], self.parts[right]
            if first is None and second is None:
                return True
            if second is None or (first is not None and left > right):
                limit, left = left, first[1]
            else:
                limit, right = right + 1, second[0]

    def fits(self, left: int, right: int) -> bool:
        pair = left, right
        known = self._fits.get(pair)
        if known is None:
            if len(self._fits) > 1_000_000:
                self._fits.clear()
            known = self._fits[pair] = self.fits_now(left, right)
        return known


#: A word begun: (tree node, token before, its count relative to now) for each start still possible.
BEGUN = ((0, -1, 0),)


class State(dict):
    """Transitions by character: (next state, tokens added). `kind`: "" between words, L in letters,
    O in other signs, else an apostrophe and what may become a contraction. `last`: the byte not yet
    counted, as it may turn out to be the word's last."""

    __slots__ = ("machine", "kind", "open", "last", "final")

    def __init__(self, machine: Transducer, kind: str, open_: tuple, last: int):
        self.machine, self.kind, self.open, self.last = machine, kind, open_, last
        self.final = machine.at_end(self)

    def __missing__(self, ch: str):
        found = self[ch] = self.machine.step(self, ch)
        self.machine.transitions += 1
        return found


class Words(dict):
    """Tokens added from the start by a word and the blank or end behind it, which lead to the start again."""

    __slots__ = ("machine",)

    def __init__(self, machine: Transducer):
        self.machine = machine

    def __missing__(self, word: str) -> int:
        n = self.machine.walk(word)
        if len(word) <= WORD:
            if len(self) >= MAX_WORDS:
                self.clear()
            self[word] = n
        return n


class Transducer:
    def __init__(self, path: str):
        self.bpe = Bpe(path)
        self.transitions, self.known, self.words = 0, {}, Words(self)
        self.start = self.state("", (), -1)
        special = sorted(map(re.escape, self.bpe.special), key=len, reverse=True)
        self.special = re.compile("|".join(special)) if special else None

    def state(self, kind: str, open_: tuple, last: int) -> State:
        key = kind, open_, last
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = State(self, kind, open_, last)
        return found

    def advance(self, open_: tuple, symbol: int) -> tuple[tuple, int]:
        """The word one symbol longer, and the change of its count."""
        bpe, alive, added, token = self.bpe, [], None, -1
        for node, before, count in open_:
            node = bpe.next[node].get(symbol)
            if node is None:
                continue
            alive.append((node, before, count))
            t = bpe.token[node]
            if added is None and t >= 0 and (before < 0 or bpe.fits(before, t)):
                added, token = count + 1, t
        return (*((n, b, c - added) for n, b, c in alive if bpe.next[n]), (0, token, 0)), added

    def longer(self, kind: str, open_: tuple, last: int, ch: str) -> tuple[State, int]:
        added = 0
        for byte in ch.encode("utf-8", "surrogatepass"):
            if last >= 0:
                open_, n = self.advance(open_, last)
                added += n
            last = byte
        return self.state(kind, open_, last), added

    def at_end(self, state: State) -> int:
        if state.kind in ("", "L", "O"):
            return self.advance(state.open, state.last + 256)[1] if state.last >= 0 else 0
        return sum(self.word(w) for w in (state.kind[0], state.kind[1:]) if w)

    def word(self, word: str, kind: str = "O") -> int:
        state, n = self.longer(kind, BEGUN, -1, word)
        return n + state.final

    def step(self, state: State, ch: str) -> tuple[State, int]:
        kind = state.kind
        if kind[:1] == "'":
            if kind == "'" and ch in SHORT or len(kind) == 2 and LONG[kind[1]] == ch:
                return self.start, self.word(kind + ch)
            if kind == "'" and ch in LONG:
                return self.state(kind + ch, (), -1), 0
            if kind == "'":
                state, n = self.longer("O", BEGUN, -1, "'")
            else:
                state, n = self.longer("L", BEGUN, -1, kind[1])
                n += self.word("'")
            to, more = state[ch]
            return to, n + more
        group = "S" if ch == " " else unicodedata.category(ch)[0]
        if group == "S" and ch == " ":
            return self.start, state.final
        if group == "N":
            return self.start, state.final + self.word(ch)
        run = "L" if group == "L" else "O"
        if run == kind:
            return self.longer(run, state.open, state.last, ch)
        if ch == "'":
            return self.state("'", (), -1), state.final
        to, n = self.longer(run, BEGUN, -1, ch)
        return to, state.final + n

    def tidy(self) -> None:
        if self.transitions > MAX_TRANSITIONS:
            self.known.clear()
            self.start.clear()
            self.known["", (), -1] = self.start
            self.transitions = 0

    def run(self, text: str) -> int:
        """Tokens of normalised text without special strings; its words between blanks are known or walked."""
        return sum(map(self.words.__getitem__, text.split(" ")))

    def walk(self, text: str) -> int:
        """Tokens of normalised text, character by character."""
        state, n = self.start, 0
        for ch in text:
            state, more = state[ch]
            n += more
        return n + state.final

    def count(self, text: str) -> int:
        self.tidy()
        if self.special is None or not any(s in text for s in self.bpe.special):
            return self.run(normalised(text))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self.run(normalised(p)) for p in parts)

    def chunk_map(self, text: str) -> tuple[str, int | None, str]:
        """(head, count, tail); count is null if the chunk has no border, after which the state is known."""
        self.tidy()
        head, n, rest = "", None, text
        while self.special and (m := self.special.search(rest)):
            part, rest = normalised(rest[: m.start()]), rest[m.end() :]
            if n is None:
                at = first_border(part)
                head, part, n = part[:at], part[at:], 0
            n += self.run(part) + 1
        rest = normalised(rest)
        if n is None:
            at = first_border(rest)
            if at == len(rest):
                return rest, None, ""
            head, rest, n = rest[:at], rest[at:], 0
        at = last_border(rest)
        return head, n + self.run(rest[:at]), rest[at:]

    def composed(self, a: tuple[str, int | None, str], b: tuple[str, int | None, str]) -> tuple[str, int | None, str]:
        if a[1] is None:
            return (a[0] + b[0], *b[1:])
        if b[1] is None:
            return a[0], a[1], a[2] + b[0]
        return a[0], a[1] + self.run(a[2] + b[0]) + b[1], b[2]

    def applied(self, chunk: tuple[str, int | None, str]) -> int:
        """The count of a map from the start to the end of a text."""
        return self.run(chunk[0]) + (0 if chunk[1] is None else chunk[1] + self.run(chunk[2]))


def sort_of(ch: str) -> str:
    """What a character is to the machine: a blank, a number, an apostrophe, a letter or another sign."""
    if ch in " '":
        return ch
    group = unicodedata.category(ch)[0]
    return group if group in "LN" else "O"


def is_border(before: str, after: str) -> bool:
    """Whether a word ends between two characters of a normalised text, whatever stands before them."""
    a = sort_of(before)
    return a in " N" or a in "LO" and {a, sort_of(after)} == {"L", "O"}


def first_border(text: str) -> int:
    """Where the first border is, or the text's length; behind a last blank or number is one, too."""
    at = next((i for i in range(1, len(text)) if is_border(text[i - 1], text[i])), len(text))
    return at


def last_border(text: str) -> int:
    if text and sort_of(text[-1]) in " N":
        return len(text)
    return next((i for i in range(len(text) - 1, 0, -1) if is_border(text[i - 1], text[i])), 0)


def normalised(text: str) -> str:
    """Canonical composition, white space to blanks, lower case letter by letter."""
    if text.isascii():
        return text.translate(_TO_SPACE).lower()
    text = unicodedata.normalize("NFC", text).translate(_TO_SPACE)
    return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)


def cuts(text: str, special: re.Pattern | None, size: int = CHUNK) -> Iterator[str]:
    """Chunks of about `size` characters; none begins inside a special string or with a
    character that could change the one before it."""
    first = 0
    while len(text) - first > size:
        at = first + size
        while at < len(text):
            c = text[at]
            base = max(first, at - 32)
            spans = special and any(m.start() < at < m.end() for m in special.finditer(text, base, at + 32))
            if not spans and (c.isascii() or unicodedata.category(c)[0] != "M" and not 0x1100 <= ord(c) < 0x1200):
                break
            at += 1
        yield text[first:at]
        first = at
    yield text[first:]


@lru_cache(maxsize=2)
def compiled(path: str) -> Transducer:
    return Transducer(path)


def count_tokens(df: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id", chunk: int = CHUNK) -> DataFrame:
    """One row per row of `df`: id, n_bytes, n_tokens. `path`: the vocabulary file on every node.

    Whole texts, without begin or end tokens; special strings in a text are one token each. A
    null text counts as empty, an empty one has 0 tokens. Rows that repeat an id or text count
    each. Other columns don't matter. An empty table gives an empty result.
    """
    require(df, text_col, id_col)
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn(
        "n_bytes", F.octet_length("text").cast("bigint")
    )
    short, long = rows.filter(F.length("text") <= chunk), rows.filter(F.length("text") > chunk)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(path)
        for b in batches:
            counts = pa.array([machine.count(t.as_py()) for t in b.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_bytes"), counts], ["id", "n_bytes", "n_tokens"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = compiled(path)
        for b in batches:
            for row in b.itertuples(index=False):
                parts = list(cuts(row.text, machine.special, chunk))
                for i in range(0, len(parts), 64):
                    some = parts[i : i + 64]
                    yield pd.DataFrame({"key": [row.key] * len(some), "number": range(i, i + len(some)), "part": some})

    def maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = compiled(path)
        for b in batches:
            got = pd.DataFrame([machine.chunk_map(t) for t in b["part"]], columns=["head", "n", "tail"]).astype({"n": "Int64"})
            yield pd.concat([b[["key", "number"]].reset_index(drop=True), got], axis=1)

    def scan(name: tuple, b: pd.DataFrame) -> pd.DataFrame:
        machine = compiled(path)
        ordered = b.sort_values("number")
        each = ((h, None if pd.isna(n) else int(n), t) for h, n, t in zip(ordered["head"], ordered["n"], ordered["tail"], strict=True))
        head, n, tail = reduce(machine.composed, each)
        return pd.DataFrame({"key": [name[0]], "number": [name[1]], "head": [head], "n": pd.array([n], "Int64"), "tail": [tail]})

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = compiled(path)
        for b in batches:
            each = zip(b["head"], b["n"], b["tail"], strict=True)
            yield b[["key"]].assign(n_tokens=[machine.applied((h, None if pd.isna(n) else int(n), t)) for h, n, t in each])

    counted = short.mapInArrow(whole, f"id {kind}, n_bytes long, n_tokens long")
    keyed = long.withColumn("key", F.sha2("text", 256))  # rows of equal texts share their chunks
    parts = keyed.select("key", "text").mapInPandas(cut, "key string, number long, part string").repartition("key", "number")
    schema = "key string, number long, head string, n long, tail string"
    maps_of = parts.dropDuplicates(["key", "number"]).mapInPandas(maps, schema)
    for _ in range(ROUNDS):
        maps_of = maps_of.groupBy("key", F.floor(F.col("number") / ARITY).alias("next")).applyInPandas(scan, schema)
    totals = maps_of.mapInPandas(last, "key string, n_tokens long")
    joined = keyed.select("key", "id", "n_bytes").join(totals, "key").select("id", "n_bytes", "n_tokens")
    return counted.unionByName(joined).withColumnRenamed("id", id_col)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > OVER)
