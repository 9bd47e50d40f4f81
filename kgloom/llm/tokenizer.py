"""Problem 7: encoding of the whole corpus with a public byte-level tokenizer.

The corpus is cut into words by the tokenizer's own pattern, and words further at byte pairs that stand in
no vocabulary entry: no merge can span them, so the parts encode on their own. The distinct words of
a batch go into a trie; a depth-first walk keeps, for every prefix, the last token of its encoding. A
prefix's last token is the one entry that ends there and is compatible with the last token of the
prefix before it, so each shared prefix is worked out once and a word's ids are read back along the
chain of last tokens. Batches are Arrow arrays; only distinct words reach Python code.

Nothing is shuffled. Null and empty texts have an empty list of ids.
"""
from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pattern that parts text before merging
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_WORDS, CACHE_PAIRS = 400_000, 1_000_000  # memory bounds of a worker's memos; a full memo is emptied, results stay the same
DOCS_AT_ONCE = 256


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class TrieEncoder:
    """Encodes distinct words with shared work on shared prefixes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.tails = {t[i:] for t in ranks for i in range(len(t))}
        self.spanned = np.zeros((256, 256), bool)
        for t in ranks:
            for a, b in zip(t, t[1:]):
                self.spanned[a, b] = True
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[bytes, np.ndarray] = {}
        self.cut = regex.compile(PATTERN)

    def merge(self, word: bytes) -> list[int]:
        """Plain pair merging, lowest rank first; only pairs of tokens come here."""
        parts = [word[i:i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the two tokens stay as they are when their bytes meet."""
        ok = self.pairs.get((a, b))
        if ok is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            ok = self.pairs[(a, b)] = self.merge(self.tokens[a] + self.tokens[b]) == [a, b]
        return ok

    def walk(self, words: list[bytes]) -> None:
        """Depth-first over the trie of ``words`` (in sorted order the path to the common prefix is kept)."""
        path, last = b"", [(-1, 0)]  # last[d]: last token of the prefix of length d, and its length
        for word in sorted(words):
            d = 0
            for a, b in zip(path, word):
                if a != b:
                    break
                d += 1
            del last[d + 1:]
            path = word
            while d < len(word):
                d += 1
                ends, n = [], 1
                while n <= d and (tail := word[d - n:d]) in self.tails:
                    t = self.ranks.get(tail)
                    if t is not None:
                        ends.append((t, n))
                    n += 1
                for t, n in reversed(ends):
                    if n == d or self.compatible(last[d - n][0], t):
                        last.append((t, n))
                        break
            ids, at = [], len(word)
            while at:
                t, n = last[at]
                ids.append(t)
                at -= n
            self.known[word] = np.array(ids[::-1], np.int32)

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, end offset of each text's ids)."""
        pieces: list[str] = []
        ends = np.empty(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                pieces += self.cut.findall(t)
            ends[i] = len(pieces)
        if not pieces:
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        arr = pa.array(pieces, pa.large_string())
        starts = np.frombuffer(arr.buffers()[1], np.int64)[:len(arr) + 1]
        data = np.frombuffer(arr.buffers()[2], np.uint8)[:starts[-1]]
        edge = np.zeros(len(data) + 1, bool)
        edge[starts] = True
        edge[1:-1] |= ~self.spanned[data[:-1], data[1:]]
        at = np.flatnonzero(edge)
        units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), arr.buffers()[2]]).dictionary_encode()
        distinct = units.dictionary.to_pylist()
        if len(self.known) + len(distinct) > CACHE_WORDS:
            self.known.clear()
        self.walk([u for u in distinct if u not in self.known])
        lists = [self.known[u] for u in distinct]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat, first = np.concatenate(lists), np.concatenate(([0], np.cumsum(sizes)))
        idx = units.indices.to_numpy(zero_copy_only=False)
        n = sizes[idx]
        stops = np.cumsum(n)
        ids = flat[np.repeat(first[idx] - (stops - n), n) + np.arange(stops[-1])]
        unit_ends = np.searchsorted(at, starts[ends])  # pieces up to a text's end -> units up to there
        return ids, np.concatenate(([0], stops))[unit_ends]


def _encoder(box: list, ranks) -> TrieEncoder:
    if not box:
        box.append(TrieEncoder(ranks.value))
    return box[0]


def _mapped(df: DataFrame, key: list[str], col: str, vocabulary: str, counts: bool) -> DataFrame:
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))  # the vocabulary: under 2 MB whatever the corpus
    names = key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box: list = []
        for whole in batches:
            for lo in range(0, max(1, whole.num_rows), DOCS_AT_ONCE):
                b = whole.slice(lo, DOCS_AT_ONCE)
                ids, ends = _encoder(box, ranks).encode_batch(b.column(len(names)).to_pylist())
                offsets = np.concatenate(([0], ends))
                out = pa.array(np.diff(offsets)) if counts else pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(names))] + [out], names=[*names, "n_tokens" if counts else "ids"])

    picked = df.select(*key, col)
    types = {f.name: f.dataType.simpleString() for f in picked.schema}
    schema = ", ".join(f"`{k}` {types[k]}" for k in key) + (", n_tokens BIGINT" if counts else ", ids ARRAY<INT>")
    return picked.mapInArrow(run, schema)


def encode_corpus(df: DataFrame, key: str = "doc_id", col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids): one row per row of ``df``, without special tokens; null and empty texts give an empty list."""
    return _mapped(df, [key], col, vocabulary, False)


def count_tokens(df: DataFrame, key: list[str], col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key..., n_tokens BIGINT) without handing the ids on."""
    return _mapped(df, key, col, vocabulary, True)
