"""Benchmark decontamination by an FM-index over each training shard.

A shard is a run of rows of about ``shard_bytes`` bytes of text inside one task (a longer text is a shard of its
own), so nothing is shuffled. The shard's word sequence, with a separator after every text, is indexed: suffix array
by prefix doubling, Burrows-Wheeler transform in a wavelet matrix, sampled suffix positions. All test phrases are
searched backwards at the same time through the wavelet ranks, and their occurrences located by walking to the next
sampled position. The spans found are merged to removal spans.

Words that no test phrase has become separators, and runs of words shorter than the shortest phrase are left out:
neither can hold a phrase, so the result is that over all words.

The test phrases are a query set. They go to the tasks in blocks of items of at most ``block_bytes`` bytes of text
(or one longer item), so what is broadcast at once is bounded however large the benchmark is.

Defined cases: null text has no words; texts without words have no hits; an empty benchmark or an item without words
hits nothing; equal windows of several items count for each item; repeated rows give repeated results; rows with equal
item ids are one item; a null item id is left out of the item list but its words still count as hit.
Extra columns are ignored, in either table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from breachlens.llm.arrow_text import add_columns, pieces, utf8, words
from breachlens.llm.rows import Tables

WINDOW = 10
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 16 << 20
SAMPLE_RATE = 16
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
ADDED = {"n_words": T.LongType(), "n_hit": T.LongType(), "items": T.ArrayType(T.StringType()), "spans": SPANS}


def suffix_array(s: np.ndarray, bits: int) -> np.ndarray:
    """Suffix array of ``s`` (int64 < 2^bits, last element 0). Each 0 is a separator of its own, in order of place.

    The first sort takes as many symbols as fit into 63 bits; then only groups of still equal suffixes are sorted
    again, by twice the length each time.
    """
    n, k = len(s), 63 // bits
    key, open_ = s.copy(), s > 0           # open_: no separator among the first k symbols
    for j in range(1, k):
        ahead = np.zeros(n, np.int64)
        ahead[:max(n - j, 0)] = s[j:]
        open_, key = open_ & (ahead > 0), (key << bits) | np.where(open_, ahead, 0)
    sa = np.argsort(key)
    ordered = key[sa]
    head = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    single = head & np.concatenate([head[1:], [True]])
    at = np.flatnonzero(~single)
    while len(at):
        i = sa[at]
        group = rank[i]
        second = np.where(open_[i], rank[np.minimum(i + k, n - 1)], i)
        order = np.lexsort((second, group))
        i, group, second = i[order], group[order], second[order]
        sa[at] = i
        head = np.concatenate([[True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])])
        rank[i] = at[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]
        single = head & np.concatenate([head[1:], [True]])
        open_[:max(n - k, 0)] &= open_[k:]
        open_[max(n - k, 0):] = False
        at, k = at[~single], 2 * k
    return sa


class WaveletMatrix:
    """Ranks over a sequence of symbols below 2^bits: one bit vector with prefix counts for each bit."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        for level in range(bits - 1, -1, -1):
            bit = ((symbols >> level) & 1).astype(bool)
            ones = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((level, bit, ones, len(symbols) - int(ones[-1])))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before place i."""
        start = np.zeros_like(i)
        for level, _, ones, zeros in self.levels:
            one = ((symbol >> level) & 1).astype(bool)
            i = np.where(one, zeros + ones[i], i - ones[i])
            start = np.where(one, zeros + ones[start], start - ones[start])
        return i - start

    def symbol_and_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at place i, and how often it occurs before."""
        symbol, start = np.zeros_like(i), np.zeros_like(i)
        for level, bit, ones, zeros in self.levels:
            one = bit[i]
            symbol |= one.astype(i.dtype) << level
            i = np.where(one, zeros + ones[i], i - ones[i])
            start = np.where(one, zeros + ones[start], start - ones[start])
        return symbol, i - start


class FMIndex:
    """Full-text index of a sequence of symbols > 0 with separators 0 (the last element is one)."""

    def __init__(self, s: np.ndarray, bits: int):
        sa = suffix_array(s, bits)
        self.wavelet = WaveletMatrix(s[sa - 1], bits)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=1 << bits))])
        run_start = np.concatenate([[True], s[:-1] == 0])
        marked = (sa % SAMPLE_RATE == 0) | run_start[sa]   # a walk back never passes a separator
        self.marked = marked
        self.samples_before = np.concatenate([[0], np.cumsum(marked)])
        self.samples = sa[marked]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and end row of the suffixes that begin with each phrase (rows of equal length)."""
        n = len(phrases)
        lo, hi = np.zeros(n, np.int64), np.full(n, len(self.marked), np.int64)
        live = np.arange(n)
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, j]
            lo[live] = self.before[c] + self.wavelet.rank(c, lo[live])
            hi[live] = self.before[c] + self.wavelet.rank(c, hi[live])
            live = live[hi[live] > lo[live]]
        hi = np.maximum(lo, hi)
        dead = np.ones(n, bool)
        dead[live] = False
        hi[dead] = lo[dead]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Place in the sequence of each row's suffix."""
        place, steps, left = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        rows = rows.copy()
        while len(left):
            done = self.marked[rows[left]]
            at = left[done]
            place[at] = self.samples[self.samples_before[rows[at]]] + steps[at]
            left = left[~done]
            symbol, rank = self.wavelet.symbol_and_rank(rows[left])
            rows[left] = self.before[symbol] + rank
            steps[left] += 1
        return place


class Phrases:
    """Test phrases: the windows of items, by length, and the items of each (a plain, picklable record of arrays)."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        texts = pa.array([t for _, t in items], pa.large_string())
        _, _, h, owner = words(*utf8(texts))
        self.vocabulary = np.unique(h)
        self.bits = max(2, int(len(self.vocabulary)).bit_length())
        ids = np.searchsorted(self.vocabulary, h).astype(np.int64) + 1
        self.names = [i for i, _ in items]
        first = np.searchsorted(owner, np.arange(len(items) + 1))
        by_length: dict[int, dict[tuple, set]] = {}
        for k in range(len(items)):
            own = ids[first[k]:first[k + 1]]
            length = min(window, len(own))
            for j in range(len(own) - length + 1 if length else 0):
                by_length.setdefault(length, {}).setdefault(tuple(own[j:j + length].tolist()), set()).add(k)
        self.lengths = sorted(by_length)
        self.phrases = {n: np.array(list(by_length[n]), np.int64) for n in self.lengths}
        self.owners = {n: [np.array(sorted(x), np.int64) for x in by_length[n].values()] for n in self.lengths}


def shard_hits(h: np.ndarray, text: np.ndarray, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Of a shard's words (hash, text number): which are hit, and the (text, item) pairs."""
    hit, none = np.zeros(len(h), bool), np.empty((0, 2), np.int64)
    if not p.lengths or not len(h):
        return hit, none
    place = np.minimum(np.searchsorted(p.vocabulary, h), len(p.vocabulary) - 1)
    ids = np.where(p.vocabulary[place] == h, place + 1, 0)
    # runs of known words inside one text, at least as long as the shortest phrase
    known = np.flatnonzero(ids)
    if not len(known):
        return hit, none
    new = np.concatenate([[True], (np.diff(known) > 1) | (np.diff(text[known]) > 0)])
    run = np.cumsum(new) - 1
    long_enough = np.bincount(run) >= p.lengths[0]
    known, run = known[long_enough[run]], run[long_enough[run]]
    if not len(known):
        return hit, none
    at = np.arange(len(known)) + np.cumsum(np.concatenate([[0], np.diff(run) > 0]))
    s = np.zeros(at[-1] + 2, np.int64)
    s[at] = ids[known]
    word_of = np.zeros(len(s), np.int64)
    word_of[at] = known
    index = FMIndex(s, p.bits)
    cover = np.zeros(len(h) + 1, np.int64)
    pairs = []
    for length in p.lengths:
        lo, hi = index.search(p.phrases[length])
        found = np.flatnonzero(hi > lo)
        if not len(found):
            continue
        counts = (hi - lo)[found]
        which = np.repeat(found, counts)
        rows = np.repeat(lo[found], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        w = word_of[index.locate(rows)]
        np.add.at(cover, w, 1)
        np.add.at(cover, w + length, -1)
        seen = np.unique(np.stack([text[w], which], 1), axis=0)
        owners = [p.owners[length][k] for k in seen[:, 1]]
        pairs.append(np.stack([np.repeat(seen[:, 0], [len(o) for o in owners]), np.concatenate(owners)], 1))
    return np.cumsum(cover[:-1]) > 0, np.unique(np.concatenate(pairs), axis=0) if pairs else none


def _spans(own: np.ndarray, start: np.ndarray, end: np.ndarray, hit: np.ndarray) -> list[dict]:
    """Removal spans of one text in code points: neighbouring hit words and what lies between become one span."""
    points = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
    first = np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1]]))
    last = np.flatnonzero(hit & ~np.concatenate([hit[1:], [False]]))
    return [{"start": int(points[start[x]]), "end": int(points[end[y]])} for x, y in zip(first, last)]


def _in_spans(own: np.ndarray, start: np.ndarray, spans: list[dict]) -> np.ndarray:
    """Which words of one text begin inside the spans."""
    points = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])[start]
    k = np.searchsorted([x["start"] for x in spans], points, side="right") - 1
    return (k >= 0) & (points < np.array([x["end"] for x in spans])[np.maximum(k, 0)])


def _scan(docs: DataFrame, text: str, block, keep: list[str], shard_bytes: int) -> DataFrame:
    """One pass over the documents with one block of items; adds to the result columns of a pass before."""
    def make(batches):
        p = block.value
        for batch in pieces(batches, text, shard_bytes):
            n = batch.num_rows
            data, offsets = utf8(batch.column(text))
            start, end, h, owner = words(data, offsets)
            hit, pairs = shard_hits(h, owner, p)
            first, first_pair = (np.searchsorted(x, np.arange(n + 1)) for x in (owner, pairs[:, 0]))
            items = [{p.names[k] for k in pairs[first_pair[i]:first_pair[i + 1], 1]} - {None} for i in range(n)]
            if "spans" in batch.schema.names:
                for i, (old, more) in enumerate(zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist())):
                    items[i].update(more)
                    if old:
                        own = slice(first[i], first[i + 1])
                        hit[own] |= _in_spans(data[offsets[i]:offsets[i + 1]], start[own] - offsets[i], old)
            n_hit = np.bincount(owner[hit], minlength=n)
            spans = [[]] * n
            for i in np.flatnonzero(n_hit):
                own = slice(first[i], first[i + 1])
                spans[i] = _spans(data[offsets[i]:offsets[i + 1]], start[own] - offsets[i], end[own] - offsets[i], hit[own])
            yield batch, {"n_words": pa.array(np.diff(first), pa.int64()), "n_hit": pa.array(n_hit, pa.int64()),
                          "items": pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                          "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))}

    return add_columns(docs, make, ADDED, keep)


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int):
    """The items with text, in lists of about ``block_bytes`` bytes; equal rows count once."""
    own = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).distinct()
    own = own.where(F.octet_length("text") > 0)
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-2 * total // block_bytes))
    for k in range(n):
        yield [tuple(r) for r in own.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).collect()]


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
                       item_text: str = "text", keep: list[str] | None = None, window: int = WINDOW,
                       shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Columns ``keep`` of the documents (default: all) with ``n_words``, ``n_hit``, ``items`` (sorted distinct ids of
    items with an occurring window) and ``spans`` (code points to remove, merged, end exclusive).

    A word is a run of letters, digits and characters from U+0080 on, A-Z lower-cased; a window is ``window``
    consecutive item words, or all words of a shorter item. Each block of items is one pass over the documents; it is
    written before the next one begins, so only one block is held and broadcast at a time.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ADDED]
    out = docs.select(*dict.fromkeys([*keep, text]))
    tables, sent = Tables(docs.sparkSession, "decontaminate"), None
    for block in _blocks(benchmark, item, item_text, block_bytes):
        if sent is not None:
            out = tables.put(out)
            sent.destroy()
        sent = docs.sparkSession.sparkContext.broadcast(Phrases(block, window))
        out = _scan(out, text, sent, list(dict.fromkeys([*keep, text])), shard_bytes)
    return out.select(*keep, *ADDED)


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents without any hit word, with their columns as they are."""
    held = {c: f"own_{c}_{i}" for i, c in enumerate(docs.columns) if c in ADDED}   # columns that clash go aside
    found = contaminated_spans(docs.withColumnsRenamed(held), benchmark, text)
    return found.where("n_hit = 0").drop(*ADDED).withColumnsRenamed({v: k for k, v in held.items()}).select(*docs.columns)


__all__ = ["contaminated_spans", "decontaminated", "FMIndex", "WINDOW"]
