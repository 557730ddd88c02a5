"""Helpers for operators that work on Arrow batches of text inside tasks.

A word is a maximal run of ASCII letters (case folded), ASCII digits and characters from U+0080 on.
Word hashes are 64-bit polynomials over random byte values, so equal words have equal hashes and
different ones collide with a chance of about 2^-64 a pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

PIECE = 1 << 20          # bytes that are tokenised at a time
BATCH_BYTES = 8 << 20    # most bytes of an Arrow batch (or one longer row)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_BASE = 0x5851F42D4C957F2D   # odd, so it has an inverse modulo 2^64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(31))
    x = x * _MIX
    x ^= x >> np.uint64(29)
    x *= _ODD
    x ^= x >> np.uint64(32)
    return x


def _tables():
    is_word = np.zeros(256, bool)
    for lo, hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
        is_word[lo:hi] = True
    value = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
    value[65:91] = value[97:123]
    return is_word, value


IS_WORD, VALUE = _tables()
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base`` to the powers 0 … n-1 modulo 2^64 (kept and grown per Python worker)."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps)
    return have[:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and the n+1 offsets of the texts (null counts as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start byte, end byte, hash and text number of every word; a word never crosses two texts."""
    out, lo, n = [], 0, len(data)
    inverse = pow(_BASE, -1, 1 << 64)
    edge = offsets[1:-1]
    while lo < n:
        hi = min(n, lo + PIECE)
        while hi < n and IS_WORD[data[hi]]:  # a piece ends where no word goes on
            gaps = np.flatnonzero(~IS_WORD[data[hi:hi + PIECE]])
            hi = hi + int(gaps[0]) if len(gaps) else min(n, hi + PIECE)
        part = data[lo:hi]
        inside = IS_WORD[part]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cut = edge[(edge > lo) & (edge < hi)] - lo
        first[cut] = inside[cut]
        last[cut - 1] = inside[cut - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        if len(s):
            sums = np.empty(len(part) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(VALUE[part] * powers(_BASE, len(part)), out=sums[1:])
            h = (sums[e] - sums[s]) * powers(inverse, len(part))[s]
            out.append((s + lo, e + lo, mix(h + (e - s).astype(np.uint64) * _ODD)))
        lo = hi
    if not out:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, np.uint64), none
    s, e, h = (np.concatenate(x) for x in zip(*out))
    return s, e, h, np.searchsorted(offsets[1:], s, side="right")


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words of each text, and the n+1 offsets of the texts in them.

    ``first``: the n+1 offsets of the texts in ``hashes``. A text of fewer words, but not none, has one
    shingle of all of them.
    """
    counts = np.diff(first)
    made = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    at = np.concatenate([[0], np.cumsum(made)])
    start = np.repeat(first[:-1], made) + np.arange(at[-1]) - np.repeat(at[:-1], made)
    length = np.minimum(np.repeat(counts, made), size)
    h = np.zeros(at[-1], np.uint64)
    for j in range(size):
        here = length > j
        h[here] = mix(h[here] * _ODD + hashes[start[here] + j] + np.uint64(j))
    return h, at


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose texts have about ``most`` bytes; a longer text is a run of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        run = (np.cumsum(size) - size) // most
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1, [batch.num_rows]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(int(a), int(b - a))


def bounded_batches(df: DataFrame) -> DataFrame:
    """Lower the session's limit on bytes of an Arrow batch to ``BATCH_BYTES``: the default of 64 MB, held several times
    by the executor and its Python worker, is much for small executors. A lower setting stays."""
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    size = conf.get(key).lower().removesuffix("b")
    if not size.isdigit() or not 0 < int(size) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def add_columns(df: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, dict]]],
                added: dict[str, T.DataType], keep: list[str]) -> DataFrame:
    """``df`` through ``mapInArrow``: its columns ``keep``, and those that ``make`` gives with each batch."""
    kept = [f for f in df.schema.fields if f.name in keep]
    names = [f.name for f in kept] + list(added)

    def run(batches):
        for batch, new in make(batches):
            columns = [batch.column(f.name) for f in kept] + [new[n] for n in added]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return bounded_batches(df).mapInArrow(run, T.StructType(kept + [T.StructField(n, t) for n, t in added.items()]))
