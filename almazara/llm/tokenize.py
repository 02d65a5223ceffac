"""Problem 8: exact byte-pair ids of every text by dynamic programming over prefixes."""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed value: how the tokenizer family splits text before any merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Words kept in a worker's memory before it starts afresh; bounds memory, changes no result.
CACHED_WORDS = 200_000


def tokenizer_file(path: str | None = None) -> str:
    """The vocabulary file: ``path``, or byte_bpe_50k.json of the installed public tokenizers; an error without either."""
    if path:
        return path
    try:
        import public_tokenizers
    except ImportError as e:
        raise ValueError("name the vocabulary file: the package of public tokenizers is not installed") from e
    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files: itself where printable, else from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PairEncoder:
    """Byte-pair encoding without simulating merges.

    For every prefix of a word exactly one token can be the last of the prefix's encoding. It is found among
    the vocabulary's tokens that end there (suffix matches of an automaton) as the one compatible with the
    last token of the prefix before it; the ids are read off by following these back-pointers.
    """

    def __init__(self, content: bytes | str):
        import ahocorasick
        import regex

        model = json.loads(content)["model"]
        letters = _byte_letters()
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        size = max(vocab.values()) + 1
        #: Order in which merges are made; -1 for single bytes.
        self.rank = [-1] * size
        self.left, self.right = list(range(size)), list(range(size))
        self.pair: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(merges):
            whole, a, b = vocab[a + b], vocab[a], vocab[b]
            if (a, b) not in self.pair:
                self.pair[a, b] = whole
            if self.rank[whole] < 0:
                self.rank[whole], self.left[whole], self.right[whole] = rank, a, b
        self.length = [0] * size
        self.automaton = ahocorasick.Automaton()
        for text, token in vocab.items():
            if all(c in letters for c in text):
                raw = bytes(letters[c] for c in text)
                self.length[token] = len(raw)
                if len(raw) == 1 or self.rank[token] >= 0:
                    self.automaton.add_word(raw.decode("latin-1"), token)
        self.automaton.make_automaton()
        self.valid: dict[int, bool] = {}
        self.split: Callable[[str], list[str]] = regex.compile(PATTERN).findall
        self.known: dict[str, array] = {}

    def compatible(self, a: int, b: int, limit: int = 1 << 60) -> bool:
        """Whether no merge crosses the boundary between two adjacent tokens before merge number ``limit``.

        The younger of the two tokens is undone step by step; a crossing merge made earlier than the one undone
        would have come first. Of equal merges the left one is made first.
        """
        rank, pair = self.rank, self.pair
        while True:
            whole = pair.get((a, b))
            if whole is not None and rank[whole] < limit:
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:
                limit, a = rank[a], self.right[a]
            else:
                limit, b = rank[b] + 1, self.left[b]

    def reachable(self, token: int) -> bool:
        """Whether the bytes of a token are encoded as that token."""
        if self.rank[token] < 0:
            return True
        if token not in self.valid:
            a, b = self.left[token], self.right[token]
            self.valid[token] = self.reachable(a) and self.reachable(b) and self.compatible(a, b, self.rank[token])
        return self.valid[token]

    def encode_word(self, word: str) -> array:
        raw = word.encode("utf-8")
        last = [-1] * (len(raw) + 1)
        length, compatible = self.length, self.compatible
        for end, token in self.automaton.iter(raw.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            start = end - length[token]
            if self.reachable(token) and (start == 0 or compatible(last[start], token)):
                last[end] = token
        ids, at = array("i"), len(raw)
        while at:
            ids.append(last[at])
            at -= length[last[at]]
        ids.reverse()
        return ids

    def encode(self, text: str | None) -> array:
        """The ids of a text; none for a null or empty one."""
        out = array("i")
        if not text:
            return out
        known, extend = self.known, out.extend
        for word in self.split(text):
            ids = known.get(word)
            if ids is None:
                ids = self.encode_word(word)
                if len(word) <= 64:
                    if len(known) >= CACHED_WORDS:
                        known.clear()
                    known[word] = ids
            extend(ids)
        return out


_ENCODERS: dict[int, PairEncoder] = {}


def _encoder(content: bytes) -> PairEncoder:
    """One encoder per worker and vocabulary."""
    key = hash(content)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = PairEncoder(content)
    return _ENCODERS[key]


def _mapped(df: DataFrame, id_column: str, text_column: str, tokenizer: str | None, schema: str, result: Callable[[PairEncoder, list], pa.Array], name: str) -> DataFrame:
    with open(tokenizer_file(tokenizer), "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())  # the vocabulary: a file of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = result(_encoder(shared.value), batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), out], names=[id_column, name])

    return df.select(id_column, text_column).mapInArrow(run, schema)


def token_ids(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(id, ids) of every row: the token ids of its whole text, without special tokens.

    No shuffle: rows are encoded where they are read, in Arrow batches. Null and empty texts have an empty
    list; a null id is kept; repeated rows come out as often as they went in; other columns are not read.
    The strings of special tokens are ordinary text.
    """

    def result(enc: PairEncoder, texts: list) -> pa.Array:
        values, ends = array("i"), array("i", [0])
        for t in texts:
            values.extend(enc.encode(t))
            ends.append(len(values))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))

    kind = df.schema[id_column].dataType.simpleString()
    return _mapped(df, id_column, text_column, tokenizer, f"`{id_column}` {kind}, ids array<int>", result, "ids")


def token_counts(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(id, tokens) of every row: how many token ids its whole text has; 0 for null and empty texts."""
    kind = df.schema[id_column].dataType.simpleString()
    count = lambda enc, texts: pa.array([len(enc.encode(t)) for t in texts], pa.int64())
    return _mapped(df, id_column, text_column, tokenizer, f"`{id_column}` {kind}, tokens bigint", count, "tokens")
