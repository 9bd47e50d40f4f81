"""Places of dictionary names in texts: a sketch of fixed size tells which places may hold a name; only those are joined with the names."""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 26  # of each of the two bit arrays (beginnings, whole names): 8 MB each, whatever the number of names
CHARS = 1 << 20  # places looked at together; bounds a task's memory and changes no result
_MASK, _M, _C1, _C2 = (np.uint64(x) for x in ((1 << BITS) - 1, 0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))
_BITMAP = 1 << 15  # bits of one bitmap of bitmap_construct_agg


def _step(n: int) -> bool:
    """Whether beginnings of ``n`` characters are in the sketch: 2, 3, 4, 6, 8, 12, 16, 24, ..., so a name of any length has few of them."""
    return n >= 2 and (n & (n - 1) == 0 or n % 3 == 0 and (n // 3) & (n // 3 - 1) == 0)


def _slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = (h ^ (h >> np.uint64(33))) * _C1
    x = (x ^ (x >> np.uint64(33))) * _C2
    x ^= x >> np.uint64(33)
    return x >> np.uint64(64 - BITS), x & _MASK


def _holds(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    a, b = _slots(h)
    one = lambda s: (bits[s >> np.uint64(3)] >> (s & np.uint64(7)).astype(np.uint8)) & 1
    return (one(a) & one(b)).astype(bool)


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all texts in a row, where each text starts, and its length."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    n = np.array([len(t) for t in texts], dtype=np.int64)
    return codes, np.cumsum(n) - n, n


def _name_slots(names: list[str]) -> np.ndarray:
    """Slots of the names' beginnings, and, behind them, of the whole names."""
    codes, at, room = _joined(names)
    h, n, out = np.zeros(len(at), dtype=np.uint64), 0, []
    while len(at):
        n += 1
        h = h * _M + codes[at + (n - 1)]
        if _step(n):
            out += _slots(h)
        out += [s + np.uint64(1 << BITS) for s in _slots(h[room == n])]
        more = room > n
        at, h, room = at[more], h[more], room[more]
    return np.unique(np.concatenate(out)) if out else np.array([], dtype=np.uint64)


def _places(codes: np.ndarray, at: np.ndarray, room: np.ndarray, opening: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, length) of what may be names; ``room`` is what each place has up to its text's end."""
    h, n, found = np.zeros(len(at), dtype=np.uint64), 0, []
    while len(at):
        n += 1
        h = h * _M + codes[at + (n - 1)]
        keep = room > n
        if n >= 2:
            hit = at[_holds(whole, h)]
            found.append((hit, np.full(len(hit), n, dtype=np.int64)))
        if _step(n):
            keep &= _holds(opening, h)
        at, h, room = at[keep], h[keep], room[keep]
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.array([], dtype=np.int64),) * 2


def sketch(names: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bit arrays of the beginnings and of the whole names (one column) of a lexicon, built from 4 KB bitmaps; 16 MB on the driver at any size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_name_slots(b.column(0).to_pylist()).astype(np.int64) + 1)], names=["slot"])  # bitmaps count from 1
    b = names.mapInArrow(run, "slot long").groupBy(F.bitmap_bucket_number("slot").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("v"))
    out = np.zeros(2 << BITS >> 3, dtype=np.uint8)
    for r in b.toLocalIterator():
        at = (r.k - 1) * _BITMAP >> 3
        out[at:at + (_BITMAP >> 3)] = np.frombuffer(r.v, dtype=np.uint8)
    return out[:len(out) // 2], out[len(out) // 2:]


def places(texts: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """(key, start, text): every stretch of (key, text) that may be one of the names (one column); all that are one are among them, and few others."""
    sc = texts.sparkSession.sparkContext
    held = sc.broadcast([zlib.compress(x.tobytes(), 1) for x in sketch(names)])  # each machine keeps a file of it; most bits are not set

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opening, whole = (np.frombuffer(zlib.decompress(x), dtype=np.uint8) for x in held.value)
        for b in batches:
            lengths = np.cumsum(b.column(1).to_numpy(zero_copy_only=False).astype(np.int64))
            lo = 0
            while lo < len(lengths):  # as many texts as make up a million characters, one at least
                hi = max(lo + 1, int(np.searchsorted(lengths, (lengths[lo - 1] if lo else 0) + CHARS)))
                part = b.column(2).slice(lo, hi - lo).to_pylist()
                codes, first, n = _joined(part)
                ends = first + n
                for w in range(0, len(codes), CHARS):
                    at = np.arange(w, min(w + CHARS, len(codes)), dtype=np.int64)
                    own = np.searchsorted(ends, at, side="right")
                    pos, size = _places(codes, at, ends[own] - at, opening, whole)
                    who = np.searchsorted(ends, pos, side="right")
                    start = pos - first[who]
                    text = [part[i][s:s + z] for i, s, z in zip(who.tolist(), start.tolist(), size.tolist())]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(who + lo)), pa.array(start.astype(np.int32)), pa.array(text, pa.string())], names=[key, "start", "text"])
                lo = hi

    schema = T.StructType([texts.schema[key], T.StructField("start", T.IntegerType()), T.StructField("text", T.StringType())])
    return texts.select(key, F.length("text").alias("n"), "text").mapInArrow(run, schema)
