"""Near-dedup, token counts, decontamination, language, quality and WARC: brute force, held-out rows, odd rows."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest

from chronoloom.llm import decontamination, language_id, near_dedup, quality, token_counts, warc
from tests.conftest import spark_rows
from tests.llm.test_native_ops import DOCS, ODD_DOCS, save

random.seed(1)
LONG = "palavra " * 30_000
WORDS = ["".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=random.randint(2, 8))) for _ in range(3000)]


def prose(n: int, rng: random.Random) -> list[str]:
    return [rng.choice(WORDS) for _ in range(n)]


# --- token counts


@pytest.fixture(scope="module")
def vocabulary():
    public = pytest.importorskip("public_tokenizers")
    return public.path("word_bpe_49k.json")


def library_counts(path, texts):
    from tokenizers import Tokenizer

    return [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_transducer_is_the_library(vocabulary):
    rng = random.Random(4)
    pool = "abcdefghijklmnopqrstuvwxyz'''  ''srtmdvel0123 \n\té中国日本語ñΣσİ🎉ﬁ½①́̀<|endoftext|>ÀÖßæ가!?.,$%"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += [t[:9] + "<|endoftext|>" + t[9:] for t in texts[:300]] + ["", " ", "it's WE'LL they've 'tis ''s", "日本語" * 500, "a" * 5000]
    machine = token_counts.compiled(vocabulary)
    assert [machine.count(t) for t in texts] == library_counts(vocabulary, texts)


def test_chunk_maps_compose_in_any_order(vocabulary):
    rng = random.Random(5)
    machine = token_counts.compiled(vocabulary)
    pool = "abcde  'srt12é中.,。<|endoftext|> "
    for _ in range(300):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(30, 200)))
        maps = [machine.chunk_map(c) for c in token_counts.cuts(text, machine.special, 16)]
        while len(maps) > 1:
            i = rng.randrange(len(maps) - 1)
            maps[i : i + 2] = [machine.composed(maps[i], maps[i + 1])]
        assert machine.applied(maps[0]) == machine.count(text)


def test_a_word_is_walked_once_and_known_words_are_bounded(monkeypatch, vocabulary):
    machine = token_counts.Transducer(vocabulary)
    walked, walk = [], machine.walk
    monkeypatch.setattr(machine, "walk", lambda text: walked.append(text) or walk(text), raising=False)
    text = "the ox's  fine, they'll see 42 x1 " * 50 + "z" * 100
    assert machine.count(text) == walk(text) and len(walked) == len(set(text.split(" ")))
    monkeypatch.setattr(token_counts, "MAX_WORDS", 3)
    assert machine.count("p q r s t " * 4) == walk("p q r s t " * 4) and len(machine.words) <= 3


def test_states_can_be_dropped(vocabulary, monkeypatch):
    monkeypatch.setattr(token_counts, "MAX_TRANSITIONS", 50)
    machine = token_counts.Transducer(vocabulary)
    texts = [" ".join(prose(30, random.Random(i))) for i in range(30)]
    assert [machine.count(t) for t in texts] == library_counts(vocabulary, texts)


def test_counts_of_odd_rows(spark, vocabulary):
    rows = [(1, None, 5), (2, "", 6), (3, LONG, 7), (3, LONG, 7), (4, "日" * 70_000, 8), (None, "x " * 40_000, 9), (5, "héllo <|endoftext|>", 1)]
    got = token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), vocabulary).collect()
    want = library_counts(vocabulary, [t or "" for _, t, _ in rows])
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == sorted((str(i), len((t or "").encode()), n) for (i, t, _), n in zip(rows, want, strict=True))
    assert token_counts.count_tokens(spark.createDataFrame([], DOCS), vocabulary).count() == 0


# --- decontamination


def test_suffix_array_and_search_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(30):
        text = rng.integers(0, 4, rng.integers(2, 200)).astype(np.int32)
        text[-1] = 0
        zeros = {p: n - 1000 for n, p in enumerate(np.flatnonzero(text == 0))}
        keyed = [[zeros.get(i, int(text[i])) for i in range(s, len(text))] for s in range(len(text))]
        assert decontamination.suffix_array(text).tolist() == sorted(range(len(text)), key=keyed.__getitem__)
        index = decontamination.FmIndex(text, 3)
        patterns = rng.integers(1, 4, (20, 4)).astype(np.int64)
        lengths = rng.integers(1, 5, 20)
        low, high = index.search(patterns, lengths)
        for p, n, a, b in zip(patterns, lengths, low, high, strict=True):
            want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == p[-n:]).all()]
            assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want


BENCH = [(0, " ".join(WORDS[:30])), (1, "Only Three words"), (2, ""), (3, None), (4, "one"), (5, " ".join(WORDS[10:25])), (None, " ".join(WORDS[100:112])), (10, "ÉCOLE é1 x2")]


def contaminated_docs():
    rng = random.Random(8)
    rows = list(ODD_DOCS)
    for i in range(100, 160):
        text = prose(rng.randint(0, 400), rng)
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(text))
            text[at:at] = rng.choice([WORDS[5:20], WORDS[:30], WORDS[0:9], ["only", "THREE", "words"], ["one"], WORDS[100:112] * 2])
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(text), "en", "s", 0))
    return [*rows, (900, LONG + " ".join(WORDS[:12]), "en", "s", 0), (901, None, None, None, None)]


def test_contamination_against_sql(spark, tmp_path, duck):
    folder = save(spark, tmp_path, "documents", contaminated_docs(), DOCS)
    save(spark, tmp_path, "benchmark", [b for b in BENCH if b[0] is not None], "item_id long, text string")
    got = spark_rows(decontamination.op4_decontamination(spark, folder))
    assert got == duck(decontamination.OP4_SQL, folder)
    assert any(r[1] is True or r[0] is True for r in got[1])


def test_blocks_and_small_shards_give_the_same(spark):
    docs = spark.createDataFrame(contaminated_docs(), DOCS).withColumnRenamed("n_chars", "n_hit")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    whole = spark_rows(decontamination.find_contamination(docs, bench))
    assert whole == spark_rows(decontamination.find_contamination(docs, bench, shard_words=500, max_pairs=7))
    assert decontamination.find_contamination(docs.limit(0), bench).count() == 0
    assert {r.n_hit for r in decontamination.find_contamination(docs, bench.limit(0)).collect()} == {0}
    clean = {str(r.doc_id) for r in decontamination.find_contamination(docs, bench).collect() if not r.n_hit}
    for block in (200_000, 5):
        kept = decontamination.remove_contaminated(docs, bench, max_pairs=block, shard_words=700)
        assert kept.schema == docs.schema and {str(r.doc_id) for r in kept.collect()} == clean


# --- near duplicates


def classes_by_brute_force(rows):
    """Connected components of plain shingle sets at 0.8."""
    sets = []
    for _, text in rows:
        w = decontamination.words_of((text or "").lower().encode())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    at = list(range(len(rows)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
            at[root(j)] = root(i)
    ids = {}
    for i, (name, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(name)
    return {name: min(names) for names in ids.values() for name in names}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(11)
    rows, passage = [], prose(60, rng)
    for g in range(25):
        base = prose(rng.randint(60, 300), rng)
        for _ in range(rng.choice([1, 1, 2, 5, 30])):
            copy = list(base)
            for _ in range(rng.randint(0, len(copy) // 150)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            rows.append(" ".join(copy))
    rows += [" ".join(passage + prose(80, rng)) for _ in range(60)]  # a passage that unlike texts share
    rows += [rows[0].upper(), rows[0].replace(" ", ",\n"), "short text", "short text!", "", "...", LONG]
    rows = list(enumerate(rows))
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, class_id int")
    got = near_dedup.near_duplicates(df).collect()
    assert {r.doc_id: r.class_id for r in got} == classes_by_brute_force(rows)
    kept = near_dedup.keep_one_of_each(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {r.class_id for r in got}


def test_chains_of_links_are_followed(spark):
    rng = random.Random(12)
    text, rows = prose(300, rng), []
    for i in range(25):  # each differs a little from the one before, the ends share nothing
        rows.append((i, " ".join(text)))
        text[i * 12 : i * 12 + 8] = prose(8, rng)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0}


def test_near_duplicates_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " . "), (4, "a b"), (4, "a b"), (None, "a  B"), (5, "a b c"), (None, None)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = sorted((str(r.doc_id), str(r.class_id), r.class_size, r.kept) for r in got)
    assert by == sorted([("1", "1", 1, True), ("2", "2", 1, True), ("3", "3", 1, True), ("4", "4", 3, True), ("4", "4", 3, True), ("None", "4", 3, False), ("5", "5", 1, True), ("None", "None", 1, True)])
    assert near_dedup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def edits(rng: random.Random, n: int, groups: int, most: int) -> list[str]:
    """Groups of texts with 0 to `most` edits each, some with repeated ends: many pairs are near 0.8, on either side."""
    texts = []
    for g in range(groups):
        base = prose(rng.randint(3, 130), rng)
        for _ in range(n // groups):
            copy = list(base)
            for _ in range(rng.randint(0, most)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            texts.append(" ".join(copy + copy[-8:] * (rng.randint(1, 9) if rng.random() < 0.2 else 0)))
    return texts


@pytest.mark.parametrize("n, groups", [(2, 1), (3, 1), (40, 3), (300, 2)])
def test_groups_of_a_block_against_brute_force(monkeypatch, n, groups):
    idf = near_dedup.Idf(np.random.default_rng(1).integers(1, 4000, near_dedup.IDF_BUCKETS), 10_000)
    words = [near_dedup.word_hashes(t.encode()) for t in edits(random.Random(n), n, groups, 5)]
    vectors = [idf.vector(w) for w in words]
    at = list(range(len(words)))
    for i, j in itertools.combinations(range(len(words)), 2):
        if at[i] != at[j] and near_dedup.similarity(vectors[i], vectors[j]) >= 0.8:
            at = [min(at[i], at[j]) if x in (at[i], at[j]) else x for x in at]
    want = sorted(g for x in set(at) if len(g := [i for i, y in enumerate(at) if x == y]) > 1)
    assert sorted(map(sorted, near_dedup.linked_groups(words, idf, 0.8))) == want
    for name, size in (("SLAB", 7), ("PAIRS", 50), ("STRIP", 3)):
        monkeypatch.setattr(near_dedup, name, size)
    assert sorted(map(sorted, near_dedup.linked_groups(words, idf, 0.8))) == want


def test_classes_do_not_depend_on_blocks(spark, monkeypatch):
    """Groups with many members around 0.8 and chains give the brute-force classes in one block and in blocks of 8."""
    rows = list(enumerate(edits(random.Random(15), 160, 4, 4)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r.doc_id: (r.class_id, r.class_size) for r in near_dedup.near_duplicates(df).collect()}
    assert len({c for c, n in want.values() if n > 8}) > 1 and sum(n == 1 for _, n in want.values()) > 10
    plain = classes_by_brute_force(rows)
    assert all(want[i][0] == want[j][0] for i, j in plain.items())
    monkeypatch.setattr(near_dedup, "MEMBERS", 8)
    assert {r.doc_id: (r.class_id, r.class_size) for r in near_dedup.near_duplicates(df).collect()} == want


def test_ids_keep_their_digits(spark):
    top = (1 << 63) - 1
    rows = [(top, "a b c d e f"), (top - 1, "a b c d e f g h i j k l"), (None, "other words than these")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == {top, top - 1, None} and all(r.kept for r in got)
    named = spark.createDataFrame([("b", "same words"), ("a", "same words")], "doc_id string, text string")
    assert {(r.doc_id, r.class_id) for r in near_dedup.near_duplicates(named).collect()} == {("a", "a"), ("b", "a")}


def test_plain_similarity_links_too(spark):
    """Pairs at a plain 0.80 to 0.83, in which what differs weighs more, by rarity or as it's repeated."""
    rng, rows = random.Random(14), []
    for i in range(60):
        base = prose(304, rng)
        edited = list(base)
        for at in range(20, 300, 50):  # 30 of 300 shingles
            edited[at] = "edited"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(edited))]
    for i in range(60, 80):
        base, line = prose(200, rng), prose(15, rng)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base + line * 30))]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = classes_by_brute_force(rows)
    assert {r.doc_id: r.class_id for r in got} == want and len(set(want.values())) == 80


def test_rows_of_an_id_go_by_their_own_text(spark):
    rows = [(1, "one text of some words"), (2, "one text of some words"), (2, "another that is not a copy"), (None, "one text of some words"), (None, "a third that none repeats")]
    kept = near_dedup.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted((str(i), t) for i, t in (rows[0], rows[2], rows[4]))


def test_weights_count_repeats(spark):
    rows = [(1, LONG), (2, LONG + "end"), (3, LONG[: len(LONG) // 2])]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {1}  # one word of 30,000 differs, though it makes one of two shingles


def test_samples_agree_as_similarity_says():
    rng = np.random.default_rng(2)
    idf = near_dedup.Idf(rng.integers(1, 50, near_dedup.IDF_BUCKETS), 1000)
    same, sims = [], []
    for i in range(150):
        base = prose(300, random.Random(i))
        other = list(base)
        for _ in range(6):
            other[random.Random(i * 7 + _).randrange(300)] = "new"
        a, b = (idf.vector(near_dedup.word_hashes(" ".join(t).encode())) for t in (base, other))
        same.append((near_dedup.samples(*a) == near_dedup.samples(*b)).mean())
        sims.append(near_dedup.similarity(a, b))
    assert abs(np.mean(same) - np.mean(sims)) < 0.02


def test_long_words_are_one_word():
    word = b"ab" * 50_000
    assert len(near_dedup.word_hashes(b"x " + word + b" y " + word + b"z")) == 4
    assert near_dedup.word_hashes(b"x " + word)[1] == near_dedup.word_hashes(word + b" y")[0] != near_dedup.word_hashes(word + b"b")[0]


def test_word_hashes_do_not_depend_on_the_place():
    text = " ".join(WORDS * 8).encode()
    seen = {}
    for word, h in zip(decontamination.words_of(text), near_dedup.word_hashes(text).tolist(), strict=True):
        assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


# --- language


def test_language_of_held_out_rows(spark):
    rng = random.Random(6)
    parts = {"aa": ["tion", "the", "ing", "er"], "bb": ["eau", "oui", "ais", "le"], "cc": ["ung", "sch", "keit", "zu"], "dd": ["ция", "ого", "при", "не"]}
    rows = []
    for i in range(600):
        lang = rng.choice(sorted(parts))
        words = ["".join(rng.choices(parts[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(5, 60))]
        rows.append((i, " ".join(words), lang if i % 10 else None, "s", i))
    docs = spark.createDataFrame(rows, DOCS)
    from chronoloom.llm.common import fold

    profiles = language_id.learn(docs.filter(fold("doc_id") != 1))
    got = {r.doc_id: r for r in language_id.predict_language(docs.withColumnRenamed("n_chars", "score"), profiles).collect()}
    held = [(got[i].lang_pred, lang) for i, _, lang, *_ in rows if lang and zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 100 and np.mean([a == b for a, b in held]) > 0.98
    again = language_id.learn(docs.filter(fold("doc_id") != 1))
    assert again.names == profiles.names and np.allclose(again.own, profiles.own)


def test_languages_of_odd_rows(spark):
    docs = spark.createDataFrame([*ODD_DOCS, (20, "123 !!", "en", "s", 1), (21, LONG, "pt", "s", 1), (1, "a b c", "en", "s", 1)], DOCS)
    got = language_id.predict_language(docs, language_id.learn(docs)).collect()
    assert len(got) == 13 and all(0 <= r.score <= 1 for r in got)
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (3, 4, 5, 20))
    assert all(r.lang_pred != "und" for r in got if r.doc_id in (1, 6, 21))
    nothing = language_id.learn(docs.filter("lang IS NULL"))
    assert {r.lang_pred for r in language_id.predict_language(docs, nothing).collect()} == {"und"}
    assert language_id.predict_language(docs.limit(0), nothing).count() == 0


# --- quality


def test_quality_of_held_out_rows(spark):
    rng = random.Random(7)
    docs, labels = [], []
    for i in range(900):
        words = prose(rng.randint(20, 120), rng)
        good = rng.random() < 0.7
        if not good:
            words = [w.upper() + "!!" for w in words] if rng.random() < 0.5 else [words[0]] * len(words)
        docs.append((i, " ".join(words).capitalize() if good else " ".join(words), "en", "s", 0))
        if i % 2:
            labels.append((i, int(good), 0))
    frame, labelled = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    from chronoloom.llm.common import fold

    net, prior = quality.train(frame.filter(fold("doc_id") != 1), labelled.filter(fold("doc_id") != 1))
    assert abs(prior - 0.7) < 0.12
    score = {r.doc_id: r.score for r in quality.score_quality(frame, net).collect()}
    held = [(score[i], y) for i, y, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(s >= 0.5) == y for s, y in held]) > 0.95
    again, _ = quality.train(frame.filter(fold("doc_id") != 1), labelled.filter(fold("doc_id") != 1))
    assert {r.doc_id: r.score for r in quality.score_quality(frame, again).collect()} == score


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([*ODD_DOCS, (30, LONG, None, None, None), (1, "a b c", "en", "s1", 5)], DOCS).withColumnRenamed("n_chars", "score")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 1), (None, 1, 0), (6, 1, 0), (6, 0, 0), (7, 1, 1), (7, 1, 1)], "doc_id long, quality int, toxic int")
    net, _ = quality.train(docs, labels)
    got = quality.score_quality(docs, net).collect()
    assert len(got) == 12 and all(0 <= r.score <= 1 for r in got)
    none, _ = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score_quality(docs, none).collect()} == {0.5}
    assert quality.score_quality(docs.limit(0), net).count() == 0


def test_risk_is_never_negative_in_its_second_part():
    rng = np.random.default_rng(1)
    p, u = rng.normal(1, 1, (400, 3)), np.concatenate((rng.normal(1, 1, (300, 3)), rng.normal(-1, 1, (300, 3))))
    net, _ = quality.fit(p, u, prior=0.5)
    good, bad = net(rng.normal(1, 1, (500, 3))), net(rng.normal(-1, 1, (500, 3)))
    assert (good > 0).mean() > 0.8 and (bad < 0).mean() > 0.8


# --- WARC


PAGES = "page_id long, url string, html string, payload string"


def pages():
    rng = random.Random(9)
    rows = [(i, f"http://a.example/{i}", rng.choice(["", "x", "é" * 10, "<p>same</p>", f"<p>{i}</p>"]), "clash") for i in range(60)]
    return [*rows, (100, None, None, None), (101, "http://a b\r\nWARC-Type: evil", "WARC/1.0\r\n\r\n", "x"), (102, "u", "ü" * 700_000, "x"), (103, "u", "ü" * 700_000, "x"), (60, "u", "x", "x"), (60, "v", "x", "x"), (None, "n", "x", "x")]


def test_archives_against_sql(spark, tmp_path, duck):
    rows = [r for r in pages() if r[0] is not None]
    folder = save(spark, tmp_path, "pages", rows, PAGES)
    assert spark_rows(warc.op9_warc(spark, folder)) == duck(warc.OP9_SQL, folder)


def test_round_trip_through_chunks(spark):
    rows = [r for r in pages() if r[0] not in (60, None)]
    df = spark.createDataFrame(rows, PAGES)
    from chronoloom.llm.common import shared_dir

    folder = f"{shared_dir(spark)}/warc-test-{random.random()}"
    parts = warc.write_archives(warc.revisits(df, min_bytes=5), folder, chunk=1000, archive=3000, part=500)
    assert parts.count() > 1
    chunks = warc.read_archives(parts, folder, chunk=777).collect()
    assert all(len(c.data) <= 777 for c in chunks)
    whole = {}
    for c in sorted(chunks, key=lambda c: (c.page_id, c.chunk)):
        whole[c.page_id] = whole.get(c.page_id, b"") + c.data
        assert c.payload_bytes == len(whole[c.page_id]) and warc.base64.b32encode(hashlib.sha1(whole[c.page_id]).digest()).decode() == c.payload_digest
    kind = {c.page_id: c.record_type for c in chunks}
    html = {r[0]: (r[2] or "").encode() for r in rows}
    assert all(whole[i] == html[i] for i in html if kind[i] == "response")
    assert all(kind[i] == "response" for i in html if len(html[i]) < 5) and kind[102] == "revisit" and kind[103] == "response"
    by = {r.page_id: r for r in warc.archive_pages(df).collect()}
    assert by[102].refers_to == 103 and by[102].payload_bytes == 1_400_000 and all(r.intact for r in by.values())
    assert by[101].target_uri.startswith("http://a%20b%0D%0A")


def test_archives_of_odd_pages(spark):
    got = warc.archive_pages(spark.createDataFrame(pages(), PAGES)).collect()
    assert len(got) == 67 and next(r for r in got if r.page_id is None).record_type == "response"
    assert [r.record_type for r in got if r.page_id == 60] == ["response", "response"]
    assert warc.archive_pages(spark.createDataFrame([], PAGES)).count() == 0


# --- ids


TOP = (1 << 63) - 1


def test_large_ids_beside_nulls(spark, vocabulary):
    rows = [(TOP, "one two three"), (TOP - 1, "x " * 40_000), (None, "one two three"), (9007199254740993, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(str, (r[0] for r in rows)))
    bench = spark.createDataFrame([(1, "two three")], "item_id long, text string")
    for got in (token_counts.count_tokens(df, vocabulary), decontamination.find_contamination(df, bench)):
        assert sorted(str(r.doc_id) for r in got.collect()) == want


def test_large_page_ids(spark):
    rows = [(TOP, "u", "same"), (TOP - 2, None, "same"), (9007199254740993, "v", "other"), (None, "w", None)]
    got = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {(r.page_id, r.record_type, r.refers_to) for r in got} == {
        (TOP, "response", None), (TOP - 2, "revisit", TOP), (9007199254740993, "response", None), (None, "response", None)
    }
