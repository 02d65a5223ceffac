"""Token ids against the library, packing against its rules, reading level against held-out labels."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from almazara.llm.packing import OpenContainers, best_fit_decreasing, pack, packing_faults, packing_quality
from almazara.llm import reading
from almazara.llm.reading import reading_levels, words_and_sentences
from almazara.llm.tokenize import PairEncoder, token_counts, token_ids, tokenizer_file

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def encoder():
    with open(tokenizer_file(), "rb") as f:
        return PairEncoder(f.read())


@pytest.fixture(scope="module")
def library():
    t = pytest.importorskip("tokenizers").Tokenizer.from_file(tokenizer_file())
    t.encode_special_tokens = True
    return t


def test_every_token_is_reachable_and_encodes_to_itself(encoder):
    assert all(encoder.reachable(t) for t in range(50_256))


def test_random_texts_equal_the_library(encoder, library):
    rng = random.Random(7)
    for alphabet in ("ab", "the hllo ing", "aá ñ\n\t1 2.", "日本語 😀é'sll", "́a​ <|endoftext|>"):
        for _ in range(300):
            s = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50)))
            assert list(encoder.encode(s)) == library.encode(s, add_special_tokens=False).ids, s


def test_one_very_long_word(encoder, library):
    s = "ab" * 30_000
    assert list(encoder.encode(s)) == library.encode(s, add_special_tokens=False).ids


def test_ids_of_a_table(spark, library):
    rows = [(1, "Hola, món!", "ca"), (2, None, None), (3, "", "es"), (None, "x", "en"), (1, "Hola, món!", "ca"), (4, " <|endoftext|> ", "en")]
    got = token_ids(spark.createDataFrame(rows, DOCS)).collect()
    want = [(i, library.encode(t, add_special_tokens=False).ids if t else []) for i, t, _ in rows]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.ids) for r in got), key=key) == sorted(want, key=key)
    counts = Counter((r.doc_id, r.tokens) for r in token_counts(spark.createDataFrame(rows, DOCS)).collect())
    assert counts == Counter((i, len(ids)) for i, ids in want)
    assert token_ids(spark.createDataFrame([], DOCS)).collect() == []


def test_documents_equal_the_library(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in token_ids(docs).collect():
        assert r.ids == (library.encode(texts[r.doc_id], add_special_tokens=False).ids if texts[r.doc_id] else [])


def _plain_best_fit(sizes, capacity):
    left = []
    for s in sorted(sizes, reverse=True):
        fits = [(r, i) for i, r in enumerate(left) if r >= s]
        if fits:
            left[min(fits)[1]] -= s
        else:
            left.append(capacity - s)
    return sorted(left)


def test_best_fit_equals_plain_search():
    rng = np.random.default_rng(3)
    for capacity in (1, 7, 64, 100):
        for _ in range(40):
            sizes = rng.integers(0, capacity + 1, rng.integers(1, 60))
            item, piece, tokens, container = best_fit_decreasing(sizes, capacity)
            assert sorted(item) == list(range(len(sizes))) and not piece.any()
            used = np.bincount(container, tokens)
            assert sorted(int(capacity - u) for u in used) == _plain_best_fit(sizes.tolist(), capacity)


def test_tree_finds_the_tightest():
    t = OpenContainers(10)
    for left, c in ((3, 0), (7, 1), (10, 2)):
        t.add(left, c)
    assert t.take_tightest(4) == (7, 1) and t.take_tightest(4) == (10, 2) and t.take_tightest(4) is None and t.take_tightest(0) == (3, 0)


@pytest.mark.parametrize("group_items", [2, 5, 100])
def test_packing_keeps_every_token(spark, group_items):
    items = [(i, int(n)) for i, n in enumerate([0, 5, 5, 10, 11, 25, 3, 3, 3])] + [(None, 2), (3, 10), (9, None)]
    caps = spark.createDataFrame([(1, 10), (2, 4), (3, None), (4, 0)], "capacity_id long, capacity_tokens long")
    df = spark.createDataFrame(items, "doc_id long, tokens long")
    rows = pack(df, caps, group_items=group_items).collect()
    for cap, size in ((1, 10), (2, 4)):
        mine = [r for r in rows if r.capacity_id == cap]
        used, pieces = defaultdict(int), defaultdict(int)
        for r in mine:
            used[r.container_id] += r.tokens
            pieces[r.doc_id] += 1
        assert max(used.values()) <= size and sum(used.values()) == sum(n or 0 for _, n in items)
        assert sum(2 * u <= size for u in used.values()) <= 1  # half empty ones are packed again over all groups
        assert pieces[5] == math.ceil(25 / size) and pieces[6] == 1
    assert {r.capacity_id for r in rows} == {1, 2}
    assert pack(df.limit(0), caps).collect() == [] and pack(df, caps.limit(0)).collect() == []
    q = {r.capacity_id: r for r in packing_quality(pack(df, caps, group_items=group_items), caps).collect()}
    assert q[1].containers >= q[1].least_containers and 0 <= q[1].unused_share < 0.5


def test_a_huge_capacity_takes_little_memory():
    sizes = np.array([10**9, 3 * 10**8, 7 * 10**8, 5, 0, 10**10])
    item, piece, tokens, container = best_fit_decreasing(sizes, 10**9)
    used = np.bincount(container, tokens)
    assert used.max() <= 10**9 and tokens.sum() == sizes.sum() and len(used) == 13
    t = OpenContainers(10**9)
    t.add(5, 0)
    assert t.sparse and t.take_tightest(3) == (5, 0) and not t.count and t.take_tightest(3) is None


def test_faults_are_found(spark):
    caps = spark.createDataFrame([(1, 10)], "capacity_id long, capacity_tokens long")
    items = spark.createDataFrame([(1, 4), (2, 9), (3, 12)], "doc_id long, tokens long")
    assert [tuple(r) for r in packing_faults(items, pack(items, caps), caps).collect()] == [(1, 10, 3, 0, 0, 0)]
    bad = spark.createDataFrame([(1, 0, 1, 0, 2), (1, 0, 1, 1, 2), (1, 0, 2, 0, 8), (1, 1, 3, 0, 10)], "capacity_id long, container_id long, doc_id long, piece int, tokens long")
    assert [tuple(r) for r in packing_faults(items, bad, caps).collect()] == [(1, 10, 3, 1, 1, 3)]


def test_words_and_sentences():
    assert words_and_sentences(None) == ([], 0) and words_and_sentences(" \n ") == ([], 0) and words_and_sentences("123 ...") == ([], 0)
    assert words_and_sentences("El CAFÉ. Café abiert0s a1to?\n<p>sí</p>") == (["el", "cafe", "cafe", "abiertos", "alto", "si"], 3)


def test_level_on_held_out_labels(spark):
    """The operator itself, fitted on the labels of every second document, against the others' labels."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/niveles.parquet")
    even = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    got = reading_levels(docs, labels.where(even)).where("level is not null")
    held = labels.where(~even).groupBy("doc_id").agg(F.avg("reading_level").alias("truth"), F.count(F.lit(1)).alias("readers"))
    rows = got.join(held, "doc_id").collect()
    hard, found = {r.doc_id for r in rows if r.truth >= 3.5}, {r.doc_id for r in rows if r.level >= 3.5}
    assert len(hard) > 100 and len(found & hard) >= 0.9 * len(hard) and len(found & hard) >= 0.9 * len(found)
    sure = {r.doc_id for r in rows if r.readers >= 3}
    assert len(found & hard & sure) >= 0.93 * len(hard & sure)
    assert {r.language for r in rows} == {"es", "ca", "en"}


def test_sums_in_slices(monkeypatch):
    m = np.arange(40.0).reshape(10, 4)
    parts = [np.array(x, np.int64) for x in ([], [1], [2, 3, 3], range(10), [], [9] * 25, [0])]
    want = np.array([m[x].sum(0) for x in parts])
    for size in (3, 7, 1000):
        monkeypatch.setattr(reading, "_SLICE", size)
        assert np.allclose(reading._sums(m, parts), want)


def test_words_are_counted_by_document_and_language(spark):
    rows = [(1, "La casa. La mesa", "es"), (2, "la casa", " ES"), (3, "the house", "en"), (4, "la", "ca"), (5, "la", None), (6, "la", "und"), (None, "la", "es"), (7, None, "es")]
    counts = reading.count_words(spark.createDataFrame(rows, DOCS), ["1", "5", "7"])
    top = {(r.language, r.word): (r.place, r.documents) for r in reading.familiar_words(counts).collect()}
    assert top == {("es", "la"): (0, 3), ("es", "casa"): (1, 2), ("es", "mesa"): (2, 1), ("en", "house"): (0, 1), ("en", "the"): (1, 1), ("ca", "la"): (0, 1), ("", "la"): (0, 2)}
    own = {r.id: (r.word, r.n, r.sentences) for r in counts.where("id is not null").collect()}
    assert own == {"1": ("la casa la mesa", 4, 2), "5": ("la", 1, 1)}


def test_long_tags_are_markup():
    assert words_and_sentences("a <b " + "x" * 5000 + "> c")[0] == ["a", "c"] and words_and_sentences("2 < b and c > d")[0] == ["b", "and", "c", "d"]


def test_levels_of_odd_tables(spark):
    docs = [(1, "La sopa es buena. El pan es bueno.", "es"), (2, None, None), (3, "  ", "es"), (4, "--- 12", None), (1, "La sopa es buena. El pan es bueno.", "es"), (5, "palabra " * 20_000, "es")]
    df = spark.createDataFrame(docs, DOCS).withColumnRenamed("lang", "level")
    labels = spark.createDataFrame([(1, 1), (1, 2), (9, 5), (2, 3), (1, 77), (None, 2)], "doc_id long, reading_level int")
    got = {r.doc_id: r for r in reading_levels(df, labels).collect()}
    assert got[1].level is not None and got[2].level is None and got[3].level is None and got[4].sentence_words is None and got[5].level is not None
    assert reading_levels(df, labels).count() == 6
    assert all(r.level is None for r in reading_levels(df, labels.limit(0)).collect())
    assert reading_levels(df.limit(0), labels).collect() == []
