"""Problem 10: how demanding a text is to read, by familiar words and sentence length."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almazara.session import shared_path

#: Labelled documents the weights are fitted on at most, chosen by hash of their id. A bound on driver memory.
MAX_LABELLED = 6_000
#: Languages with a familiar-word list of their own, as their labels are written in lower case.
LANGUAGES = ("es", "ca", "en")
#: Lengths of the nested familiar-word lists of a language: its words of highest document frequency in the corpus.
FAMILIAR = (25, 50, 75, 100, 150, 200, 250, 300, 350, 400, 500, 600, 800, 1200)
#: The list whose share of words outside is reported.
SHOWN = 300
#: Levels from this on count as demanding: a document most readers put at 4 or 5.
DEMANDING = 3.5
#: Ridge penalty per labelled document, on features of unit variance.
PENALTY = 1e-5
#: A worker passes on its document counts when it holds so many words.
_FLUSH_WORDS = 500_000
#: Words whose values are added up at once. A bound on a worker's memory.
_SLICE = 200_000

#: Characters that folding drops: the combining marks of Latin, Greek and Cyrillic, soft hyphen, zero-width characters.
_DROPPED = re.compile("[\u0300-\u036f\u00ad\u200b-\u200d\ufeff]+")
_MARKUP = re.compile(r"</?[a-z][^<>]*>|https?://\S+|&[a-z]+;")
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE_END = re.compile(r"[.!?…]+|\n\s*\n")
#: A 0 or 1 between letters. The digit comes first, so that a search skips to digits.
_SCANNED = re.compile(r"[01](?<=[^\W\d_].)(?=[^\W\d_])")


def words_and_sentences(text: str | None) -> tuple[list[str], int]:
    """The folded words of a text and its number of sentences (1 at least, if it has words).

    Folding: compatibility forms, no accents, no soft hyphens or zero-width characters, lower case; markup
    and addresses are dropped; 0 and 1 between letters are scanning errors for o and l.
    """
    if not text:
        return [], 0
    flat = text.lower()
    if not flat.isascii():
        flat = _DROPPED.sub("", unicodedata.normalize("NFKD", flat))
    if "<" in flat or "&" in flat or "://" in flat:
        flat = _MARKUP.sub(" ", flat)
    flat = _SCANNED.sub(lambda m: "o" if m[0] == "0" else "l", flat)
    words = _WORD.findall(flat)
    sentences = sum(1 for s in _SENTENCE_END.split(flat) if _WORD.search(s)) if words else 0
    return words, sentences


_COUNTED = "language string, word string, n bigint, id string, sentences int"


def _counts(seen: Mapping[str, Counter]) -> pa.RecordBatch:
    keys = [(language, w, n) for language, c in seen.items() for w, n in c.items()]
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.int64()), pa.nulls(len(keys), pa.string()), pa.nulls(len(keys), pa.int32())],
        names=["language", "word", "n", "id", "sentences"],
    )


def count_words(df: DataFrame, wanted: Sequence[str], id_column: str = "doc_id", text_column: str = "text", language_column: str = "lang", languages: Sequence[str] = LANGUAGES) -> DataFrame:
    """One pass over all rows and whole texts: document counts of words, and the words of the wanted documents.

    Rows with a null ``id`` say in how many documents of ``language`` (by their label) a folded word occurs,
    counted by workers in memory bounded by _FLUSH_WORDS words; documents with another label or none count under
    an empty one. A row with an ``id`` (as text, one of ``wanted``) has all words of that document, divided by
    blanks, in ``word``, and their number in ``n``.
    """
    shared = df.sparkSession.sparkContext.broadcast(frozenset(wanted))  # at most max_labelled ids
    known = frozenset(languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: defaultdict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            own: list[tuple] = []
            for i, text, label in zip(*(batch.column(k).to_pylist() for k in range(3))):
                language = (label or "").strip().lower()
                words, sentences = words_and_sentences(text)
                seen[language if language in known else ""].update(set(words))
                if words and i in shared.value:
                    own.append((None, " ".join(words), len(words), i, sentences))
                if sum(map(len, seen.values())) >= _FLUSH_WORDS:
                    yield _counts(seen)
                    seen.clear()
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*own), (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32()))], names=["language", "word", "n", "id", "sentences"])
        yield _counts(seen)

    rows = df.select(F.col(id_column).cast("string").alias("id"), text_column, (F.col(language_column).cast("string") if language_column in df.columns else F.lit(None).cast("string")).alias("label"))
    return rows.mapInArrow(run, _COUNTED)


def familiar_words(counts: DataFrame, length: int = max(FAMILIAR)) -> DataFrame:
    """(language, word, documents, place): per language the ``length`` words of highest document frequency, ties by word."""
    sums = counts.where("id is null").groupBy("language", "word").agg(F.sum("n").alias("documents"))
    place = F.row_number().over(Window.partitionBy("language").orderBy(F.desc("documents"), "word")) - 1
    return sums.withColumn("place", place).where(F.col("place") < length)


class WordLists:
    """The familiar words of each language as rows of one matrix, by which whole batches are scored."""

    def __init__(self, lists: Mapping[str, Mapping[str, tuple[int, int]]]):
        """``lists``: per language word -> (place, documents)."""
        self.languages = sorted(lists)
        words = sorted({w for t in lists.values() for w in t})
        self.number = {w: i for i, w in enumerate(words)}
        far = 1 << 30
        self.place = np.full((len(words) + 1, len(self.languages)), far, np.int64)  # the last row: words on no list
        likely = np.zeros_like(self.place, float)
        for j, name in enumerate(self.languages):
            total = sum(n for _, n in lists[name].values()) or 1
            likely[:, j] = math.log(0.5 / total)
            for w, (p, n) in lists[name].items():
                self.place[self.number[w], j] = p
                likely[self.number[w], j] = math.log(n / total)
        likely[-1] = 0.0  # a word on no list speaks for no language
        #: Per word: log likelihood by language, and for every length of list whether the word lies outside.
        self.values = np.hstack([likely, *[(self.place >= k).astype(float) for k in FAMILIAR]])

    def numbers(self, words: Sequence[str]) -> np.ndarray:
        get, none = self.number.get, len(self.number)
        return np.fromiter((get(w, none) for w in words), np.int64, len(words))

    def language(self, totals: np.ndarray) -> np.ndarray:
        """The most likely language of each row of summed values; the first by name on a tie."""
        return np.argmax(totals[:, : len(self.languages)], axis=1)

    def outside(self, means: np.ndarray, language: np.ndarray) -> np.ndarray:
        """The shares of words outside each list of the row's language."""
        n = len(self.languages)
        return means[np.arange(len(means))[:, None], n * (1 + np.arange(len(FAMILIAR)))[None, :] + language[:, None]]


def _sums(matrix: np.ndarray, numbers: Sequence[np.ndarray]) -> np.ndarray:
    """The summed rows of ``matrix`` for each array of row numbers, in slices of bounded size."""
    out = np.zeros((len(numbers), matrix.shape[1]))
    group: list[int] = []
    size = 0

    def flush() -> None:
        if group:
            ends = np.cumsum([len(numbers[i]) for i in group])
            out[group] = np.add.reduceat(matrix[np.concatenate([numbers[i] for i in group])], np.concatenate([[0], ends[:-1]]), axis=0)

    for i, x in enumerate(numbers):
        if len(x) > _SLICE:
            for k in range(0, len(x), _SLICE):
                out[i] += matrix[x[k : k + _SLICE]].sum(0)
        elif len(x):
            if size + len(x) > _SLICE:
                flush()
                group, size = [], 0
            group.append(i)
            size += len(x)
    flush()
    return out


@dataclass
class LevelModel:
    """The formula, per language: intercept + weighted shares of words outside its lists + weighted sentence length."""

    lists: WordLists
    share_weight: np.ndarray  # language x list
    length_weight: np.ndarray  # language x (words a sentence, its logarithm)
    intercept: np.ndarray  # language

    def __post_init__(self) -> None:
        n, k = len(self.lists.languages), len(FAMILIAR)
        outside = self.lists.values[:, n:].reshape(-1, k, n)
        shown = outside[:, FAMILIAR.index(SHOWN), :]
        #: Per word and language: likelihood, the formula's term, and whether the word lies outside the list shown.
        self.matrix = np.hstack([self.lists.values[:, :n], np.einsum("wkl,lk->wl", outside, self.share_weight), shown])

    def score(self, texts: Sequence[str | None]) -> tuple[list, list, list, list]:
        """(level, share of words outside the list shown, words a sentence, language) of each text; None without words."""
        parsed = [words_and_sentences(t) for t in texts]
        counts = np.array([len(w) for w, _ in parsed], float)
        sums = _sums(self.matrix, [self.lists.numbers(w) for w, _ in parsed])
        n, rows = len(self.lists.languages), np.arange(len(parsed))
        means = sums / np.maximum(counts, 1)[:, None]
        language = self.lists.language(sums)
        length = counts / np.maximum(1, np.array([s for _, s in parsed]))
        terms = np.stack([length, np.log(np.maximum(length, 1e-9))], 1)
        level = np.clip(self.intercept[language] + means[rows, n + language] + (terms * self.length_weight[language]).sum(1), 1.0, 5.0)
        some = counts > 0
        pick = lambda x: [float(v) if ok else None for v, ok in zip(x, some)]
        return pick(level), pick(means[rows, 2 * n + language]), pick(length), [self.lists.languages[i] if ok else None for i, ok in zip(language, some)]


def fit(documents: Sequence[tuple[Mapping[str, int], int]], levels: Sequence[float], weights: Sequence[float], lists: WordLists) -> LevelModel:
    """The formula's weights from labelled documents (words with their number, sentences), by weighted ridge regression.

    Every language has its own weights; what they have in common is shared, so a language with few labels
    leans on the others.
    """
    totals = np.array([(lists.values[lists.numbers(list(w))] * np.array(list(w.values()), float)[:, None]).sum(0) for w, _ in documents])
    counts = np.array([sum(w.values()) for w, _ in documents], float)
    length = counts / np.maximum(1, np.array([s for _, s in documents]))
    language = lists.language(totals)
    x = np.hstack([lists.outside(totals / counts[:, None], language), length[:, None], np.log(length)[:, None]])
    mean, spread = x.mean(0), x.std(0)
    spread[spread < 1e-9] = 1.0
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / spread])
    n, k = len(lists.languages), z.shape[1]
    design = np.hstack([z, *[z * (language == j)[:, None] for j in range(n)]])
    y, w = np.asarray(levels, float), np.asarray(weights, float)
    penalty = np.full(design.shape[1], PENALTY * len(x))
    penalty[0] = 1e-9
    c = np.linalg.solve(design.T @ (design * w[:, None]) + np.diag(penalty), design.T @ (w * y))
    each = c[:k] + c[k:].reshape(n, k)
    scaled = each[:, 1:] / spread
    return LevelModel(lists, scaled[:, : len(FAMILIAR)], scaled[:, len(FAMILIAR) :], each[:, 0] - scaled @ mean)


def train(df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "reading_level", max_labelled: int = MAX_LABELLED) -> LevelModel | None:
    """The model from the corpus's document frequencies and at most ``max_labelled`` labelled documents.

    One pass over the corpus counts the words of all documents and gives those of the labelled ones; its small
    result is written to the checkpoint folder. Only the familiar-word lists, of fixed length, and the labelled
    documents' words come to the driver. None without a usable label or list.
    """
    per_document = labels.where(F.col(label_column).between(1, 5) & F.col(id_column).isNotNull()).groupBy(F.col(id_column).cast("string").alias("id")).agg(F.avg(label_column).alias("level"), F.count(F.lit(1)).alias("readers"))
    told = {r["id"]: (r["level"], r["readers"]) for r in per_document.orderBy(F.xxhash64("id"), "id").limit(max_labelled).collect()}
    if not told:
        return None
    counts = count_words(df, list(told), id_column, text_column)
    path = shared_path(df.sparkSession, "words")
    counts.write.parquet(path)
    counts = df.sparkSession.read.schema(_COUNTED).parquet(path)
    lists: dict[str, dict[str, tuple[int, int]]] = {}
    for r in familiar_words(counts).collect():
        lists.setdefault(r["language"], {})[r["word"]] = (r["place"], r["documents"])
    if len(lists) > 1:
        lists.pop("", None)  # one list for all only where no document has a known language
    words: dict[str, Counter] = {}
    sentences: dict[str, int] = {}
    for r in counts.where("id is not null").groupBy("id").agg(F.min(F.struct("word", "sentences")).alias("d")).collect():  # at most max_labelled
        words[r["id"]], sentences[r["id"]] = Counter(r["d"]["word"].split(" ")), r["d"]["sentences"]
    ids = sorted(words)
    if not ids or not lists:
        return None
    return fit([(words[i], sentences[i]) for i in ids], [told[i][0] for i in ids], [math.sqrt(told[i][1]) for i in ids], WordLists(lists))


def reading_levels(df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(id, level, unfamiliar_share, sentence_words, language) of every row.

    level: estimate on the scale of the labels, 1 to 5; unfamiliar_share: share of words outside the language's
    list of SHOWN words; sentence_words: average words a sentence; language: the one whose familiar words fit
    best, empty where no document's label names a known one. Two passes over the corpus (words, scores), neither of
    which moves texts between executors.

    Defined edge cases: a null or blank text, or one without letters, has null in all; without any label of a
    document with words all are null; labels outside 1 to 5 and labels of unknown
    documents are ignored; of repeated rows of a labelled id the first by its folded text enters the fit;
    repeated rows are scored each.
    """
    model = train(df, labels, id_column, text_column, max_labelled=max_labelled)
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by LANGUAGES and FAMILIAR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: LevelModel | None = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            level, share, length, language = m.score(texts) if m else ([None] * len(texts),) * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.float64()) for x in (level, share, length)], pa.array(language, pa.string())], names=[id_column, "level", "unfamiliar_share", "sentence_words", "language"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, level double, unfamiliar_share double, sentence_words double, language string")
