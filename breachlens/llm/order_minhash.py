"""Near-duplicate documents by order MinHash, verified by banded alignment.

Two documents are alike when the longest common subsequence L of their n and m words has L / (n + m - L) >= 0.8: the
Jaccard similarity of words that keep their order, an edit similarity. An edited word costs one word of it.

Candidates: a document's five-word shingles are labelled with their occurrence number in it, so all its symbols differ.
For each of ``SKETCHES`` hash functions the ``ELL`` symbols of least hash, in text order, make one sketch. Documents that
share a sketch share a bucket. Equal word sequences are one class from the start, so buckets hold different texts only.
Two texts whose labelled shingles have the Jaccard similarity J and keep their order share one with a chance of about
1 - (1 - J^ELL)^SKETCHES: 0.99 at J = 0.5, 0.93 at J = 0.39, to which words edited here and there take a pair of
similarity 0.8 (edits that lie together leave J at 0.8). Texts of a few words have few shingles, and fewer chances.

No bucket is expanded into all pairs. First each member is aligned with a few leaders: the least and greatest class
number of its bucket, and the least of its neighbours that also share the next one or two sketches, so the number of
pairs is linear. The links found are joined to components. In a bucket that then still holds several components, the
members outside the largest one are strays. In buckets of at most ``PAIRED`` members each stray is aligned with the members
of other components: at most ``PAIRED`` pairs a stray and bucket, so the work grows with the strays. The strays of larger
buckets are a query set against all members of such buckets: blocks of at most ``BLOCK_BYTES`` of stray sequences go to the tasks, which look up each member's symbols in a block at once and
align only pairs with enough symbols in common. So each pair in a bucket is either aligned, or both are in the largest
component of their bucket already, and of strays only links become rows, at most one for each two components in a task.

Alignment: equal words at both ends match; between them a row of the table of common subsequences is one long integer,
one bit a word, and a word's matches are counted only inside the band that an alignment of 0.8 can reach.

Defined cases: words are runs of letters, digits and characters from U+0080 on, case folded; a text of fewer than five
words, but not none, has one shingle of all of them; texts without words (null counts as empty) are alike only if they
are equal; the representative of a class is its row of least id (null first, ties by a hash of the row); rows that agree
in every column share the flag, and ``deduplicated`` keeps one of them. Class numbers are 64-bit hashes of word sequences.
Extra columns pass through ``deduplicated`` unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from breachlens.llm.arrow_text import add_columns, bounded_batches, mix, pieces, powers, shingles, utf8, words
from breachlens.llm.rows import KEY, Tables, row_key, with_documents

SHINGLE = 5
ELL = 2
SKETCHES = 16
SIMILARITY = 0.8
PAIRED = 64
BLOCK_BYTES = 3 << 20
PIECE_BYTES = 2 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * _ODD)


# ── inside tasks ─────────────────────────────────────────────────────────────

def labelled(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Shingle hashes in which the occurrence number within the text has been mixed."""
    if not len(h):
        return h
    key = mix(h + np.repeat(np.arange(len(at) - 1, dtype=np.uint64), np.diff(at)) * _ODD)
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    occurrence = np.empty(len(h), np.uint64)
    place = np.arange(len(h))
    occurrence[order] = (place - np.maximum.accumulate(np.where(new, place, 0))).astype(np.uint64)
    return np.where(occurrence > 0, mix(h + occurrence * _ODD), h)


def order_sketches(symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sketches (texts × SKETCHES): hashes of the ELL least symbols under each hash function, in text order."""
    n = len(at) - 1
    chosen = np.zeros((n, SKETCHES, ELL), np.uint64)
    for k in range(n):
        own = symbols[at[k]:at[k + 1]]
        if not len(own):
            continue
        step = max(1, 100_000 // len(own))        # hash functions at a time: bounded memory for long texts
        for lo in range(0, SKETCHES, step):
            ranks = mix(own[None, :] ^ _SEEDS[lo:lo + step, None])
            if len(own) > ELL:
                least = np.argpartition(ranks, ELL - 1, axis=1)[:, :ELL]
                least.sort(axis=1)
            else:
                least = np.broadcast_to(np.arange(len(own)), (len(ranks), len(own)))
            chosen[k, lo:lo + step, :least.shape[1]] = own[least]
    out = np.broadcast_to(_SEEDS, (n, SKETCHES))
    for j in range(ELL):
        out = mix(out * _ODD + chosen[:, :, j])
    return out


def sequence_hash(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One hash of each text's word sequence."""
    n = np.diff(at)
    place = np.arange(len(h)) - np.repeat(at[:-1], n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h) * powers(0x2545F4914F6CDD1D, int(n.max(initial=0)))[place])])
    return mix(sums[at[1:]] - sums[at[:-1]] + n.astype(np.uint64) * _ODD)


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and the offsets of the texts in them."""
    data, offsets = utf8(column)
    _, _, h, owner = words(data, offsets)
    return h, np.searchsorted(owner, np.arange(len(offsets)))


def _symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labelled shingles and their offsets, and the hashes of the word sequences."""
    h, at = _words(column)
    made, made_at = shingles(h, at, SHINGLE)
    return labelled(made, made_at), made_at, sequence_hash(h, at)


def _lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values.view(np.int64), pa.int64()))


def needed(n: int, m: int, similarity: float) -> int:
    """The least common length of n and m words at the similarity."""
    return int(np.ceil(similarity * (n + m) / (1 + similarity) - 1e-9))


def common_length(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> int:
    """Longest common subsequence of word hashes inside the band, or 0 where it can't reach the similarity."""
    n, m = len(a), len(b)
    need = needed(n, m, similarity)
    if min(n, m) < need:
        return 0
    short = min(n, m)
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    differ = np.flatnonzero(a[::-1][:short - head] != b[::-1][:short - head])
    tail = int(differ[0]) if len(differ) else short - head
    x, y = a[head:n - tail].tolist(), b[head:m - tail].tolist()
    most = head + tail + min(len(x), len(y))
    if most < need or not x or not y:
        return most if most >= need and min(len(x), len(y)) == 0 else 0
    places: dict[int, int] = {}
    for j, w in enumerate(y):
        places[w] = places.get(w, 0) | 1 << j
    back, band, full = n - need, (1 << n + m - 2 * need + 1) - 1, (1 << len(y)) - 1
    row = full                                # a zero bit for every word of y that adds one to the common length
    for i, w in enumerate(x):
        own = places.get(w)
        if own:
            hit = row & own & (band << i - back if i >= back else band >> back - i)
            row = ((row + hit) | (row - hit)) & full
    found = head + tail + len(y) - row.bit_count()
    return found if found >= need else 0


# ── on Spark ─────────────────────────────────────────────────────────────────

def _sketched(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, row key, c (class number), n (symbols) and the sketches of every row."""
    def make(batches):
        for batch in pieces(batches, "text", PIECE_BYTES):
            symbols, at, seq = _symbols(batch.column("text"))
            yield batch, {"words_hash": pa.array(seq.view(np.int64)), "n": pa.array(np.diff(at), pa.int64()),
                          "sketches": _lists(order_sketches(symbols, at).ravel(),
                                             np.arange(len(at), dtype=np.int32) * SKETCHES)}

    added = {"words_hash": T.LongType(), "n": T.LongType(), "sketches": T.ArrayType(T.LongType())}
    rows = add_columns(_keyed(docs, id_col, text), make, added, ["id", *KEY, "text_hash"])
    number = F.when(F.col("n") > 0, F.col("words_hash")).otherwise(F.xxhash64(F.lit("no words"), F.col("text_hash")))
    return rows.select("id", *KEY, number.alias("c"), "n", "sketches")


def _keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), *row_key(docs),
                       F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"))


def _sequences(docs: DataFrame, rows: DataFrame, wanted: DataFrame, id_col: str, text: str) -> DataFrame:
    """The word hashes of each wanted class, from one of its rows."""
    one = (rows.join(wanted, "c", "left_semi").groupBy("c").agg(F.min(F.struct(*KEY)).alias("row"))
           .select("c", "row.*"))
    texts = _keyed(docs, id_col, text).select("text", *KEY).join(one, list(KEY))

    def make(batches):
        for batch in pieces(batches, "text", PIECE_BYTES):
            yield batch, {"seq": _lists(*_words(batch.column("text")))}

    made = add_columns(texts.select("c", "text"), make, {"seq": T.ArrayType(T.LongType())}, ["c"])
    return made.groupBy("c").agg(F.first("seq").alias("seq"))


def _alike(pairs: DataFrame, sequences: DataFrame, similarity: float) -> DataFrame:
    """Of the pairs (a, b) of classes, those whose alignment reaches the similarity. Only sequences in pairs are shuffled."""
    def run(batches):
        for batch in batches:
            a, b = (batch.column(batch.schema.get_field_index(x)) for x in ("seq_a", "seq_b"))
            (va, oa), (vb, ob) = ((np.asarray(x.flatten()), np.concatenate([[0], np.cumsum(x.value_lengths())])) for x in (a, b))
            ok = [common_length(va[oa[i]:oa[i + 1]], vb[ob[i]:ob[i + 1]], similarity) > 0 for i in range(batch.num_rows)]
            kept = batch.filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(kept.schema.get_field_index(x)) for x in "ab"], names=["a", "b"])

    needed = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    sequences = sequences.join(needed, "c", "left_semi")
    both = (pairs.join(sequences.select(F.col("c").alias("a"), F.col("seq").alias("seq_a")), "a")
            .join(sequences.select(F.col("c").alias("b"), F.col("seq").alias("seq_b")), "b"))
    return bounded_batches(both.select("a", "b", "seq_a", "seq_b")).mapInArrow(run, "a long, b long")


class Block:
    """Word sequences of strays with an index of their words, labelled with the occurrence in their sequence: two
    sequences have as many labelled words in common as words, repeats counted."""

    def __init__(self, rows: list[tuple[int, int, list[int]]]):
        self.c, self.root = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
        self.sequences = [np.asarray(r[2], np.int64) for r in rows]
        self.length = np.array([len(x) for x in self.sequences])
        symbols = labelled(np.concatenate(self.sequences).view(np.uint64), np.concatenate([[0], np.cumsum(self.length)]))
        order = np.argsort(symbols, kind="stable")
        self.symbols, self.owner = symbols[order], np.repeat(np.arange(len(rows)), self.length)[order]

    def links(self, root: int, sequence: np.ndarray, similarity: float, linked: dict[int, np.ndarray]) -> list[int]:
        """Class numbers of the strays that are like a sequence, for components that aren't ``linked`` to its own."""
        n = len(sequence)
        done = linked.setdefault(root, self.root == root)
        if done.all():
            return []
        own = labelled(sequence.view(np.uint64), np.array([0, n]))
        lo, hi = (np.searchsorted(self.symbols, own, side=x) for x in ("left", "right"))
        found = hi > lo
        count = (hi - lo)[found]
        at = np.repeat(lo[found], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        common = np.bincount(self.owner[at], minlength=len(self.c))
        need = np.ceil(similarity * (n + self.length) / (1 + similarity) - 1e-9)
        out = []
        for k in np.flatnonzero(common >= need):
            if not done[k] and common_length(sequence, self.sequences[k], similarity):
                out.append(int(self.c[k]))
                done |= self.root == self.root[k]
        return out


def _stray_links(members: DataFrame, similarity: float, tables: Tables) -> DataFrame:
    """Links (a, b) between members (c, root, stray, seq) and strays, a block of strays at a time. A task gives at most
    one link for each two components."""
    def run(batches):
        block, linked, names = sent.value, {}, ("c", "root", "seq")
        for batch in batches:
            c, root, seq = (batch.column(batch.schema.get_field_index(x)) for x in names)
            values, at = np.asarray(seq.flatten()), np.concatenate([[0], np.cumsum(seq.value_lengths())])
            links = [(k, x) for i, (k, r) in enumerate(zip(c.to_pylist(), root.to_pylist()))
                     for x in block.links(r, values[at[i]:at[i + 1]], similarity, linked)]
            yield pa.RecordBatch.from_arrays([pa.array([min(x) for x in links], pa.int64()),
                                              pa.array([max(x) for x in links], pa.int64())], names=["a", "b"])

    strays, out = members.where("stray"), None
    blocks = -(-strays.agg(F.sum(F.size("seq") * 8)).first()[0] // BLOCK_BYTES)
    for k in range(blocks):
        rows = strays.where(F.pmod(F.xxhash64("c"), F.lit(blocks)) == k).select("c", "root", "seq").collect()
        if rows:
            sent = members.sparkSession.sparkContext.broadcast(Block([tuple(r) for r in rows]))
            found = tables.put(bounded_batches(members.select("c", "root", "seq")).mapInArrow(run, "a long, b long"))
            sent.destroy()     # its links are written
            out = found if out is None else out.union(found)
    return out


def _stray_pairs(mixed: DataFrame) -> DataFrame:
    """Pairs (a, b) of strays and members of other components in their bucket, from rows (h, c, root, stray)."""
    strays = mixed.where("stray").select("h", F.col("c").alias("x"), F.col("root").alias("root_x"))
    both = strays.join(mixed.select("h", F.col("c").alias("y"), F.col("root").alias("root_y")), "h").where("root_x <> root_y")
    return both.select(*_ordered("x", "y")).distinct()


def _ordered(x: str, y: str) -> tuple:
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def components(links: DataFrame, tables: Tables) -> DataFrame:
    """c, root (least class number connected with it) of every class that has a link."""
    edges = tables.put(links.select("a", "b").union(links.select("b", "a")).distinct())
    roots = tables.put(edges.groupBy(F.col("a").alias("c")).agg(F.least(F.col("a"), F.min("b")).alias("root")))
    while True:
        near = (edges.join(roots.select(F.col("c").alias("b"), "root"), "b")
                .groupBy(F.col("a").alias("c")).agg(F.min("root").alias("near")))
        step = roots.join(near, "c").select("c", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = roots.select(F.col("c").alias("root"), F.col("root").alias("next"))
        new = tables.put(step.join(jump, "root").select("c", "old", F.least("root", "next").alias("root")))
        if new.where("root <> old").isEmpty():
            return roots
        roots = new.select("c", "root")


def joined_components(roots: DataFrame, links: DataFrame, tables: Tables) -> DataFrame:
    """c, root after further links: only the components that they join are connected, not all links again."""
    linked = links.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    own = tables.put(roots.union(linked.join(roots, "c", "left_anti").select("c", F.col("c").alias("root"))))
    lifted = (links.join(own.select(F.col("c").alias("a"), F.col("root").alias("root_a")), "a")
              .join(own.select(F.col("c").alias("b"), F.col("root").alias("root_b")), "b")
              .where("root_a <> root_b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct())
    joined = components(tables.put(lifted), tables).select(F.col("c").alias("root"), F.col("root").alias("joined"))
    return tables.put(own.join(joined, "root", "left").select("c", F.coalesce("joined", "root").alias("root")))


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: ``id``, its row key, ``class_id`` (least id of its class), ``class_size`` (rows) and
    ``representative``."""
    tables = Tables(docs.sparkSession, "order-minhash")
    rows = tables.put(_sketched(docs, id_col, text))
    following = lambda k: F.concat(F.slice("sketches", k + 1, SKETCHES - k), F.slice("sketches", 1, k))
    bands = tables.put(rows.where("n > 0").select("c", F.inline(F.arrays_zip(
        F.col("sketches").alias("h"), following(1).alias("h1"), following(2).alias("h2")))).toDF("c", "h", "h1", "h2").distinct())
    shared = bands.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("low"), F.max("c").alias("high"))
    members = tables.put(bands.join(shared.where("m > 1"), "h"))
    sequences = tables.put(_sequences(docs, rows, members.select("c").distinct(), id_col, text))
    # in buckets of three, the two leaders and the third are all the pairs there are
    near = members.where("m > 3").groupBy("h", "h1").agg(F.min("c").alias("leader"))
    nearer = members.where("m > 3").groupBy("h", "h1", "h2").agg(F.min("c").alias("leader"))
    leaders = (members.select("c", F.explode(F.array("low", "high")).alias("leader"))
               .union(members.join(near, ["h", "h1"]).select("c", "leader"))
               .union(members.join(nearer, ["h", "h1", "h2"]).select("c", "leader")))
    pairs = tables.put(leaders.where("c <> leader").select(*_ordered("c", "leader")).distinct())
    links = tables.put(_alike(pairs, sequences, similarity))
    roots = components(links, tables)
    own = members.where("m > 3").select("h", "c", "m").join(roots, "c", "left").select("h", "c", "m", F.coalesce("root", "c").alias("root"))
    sizes = own.groupBy("h", "root").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy("h").agg(F.count(F.lit(1)).alias("roots"), F.max_by("root", F.struct("size", "root")).alias("main"))
    mixed = tables.put(own.join(main.where("roots > 1"), "h").select("h", "m", "c", "root", F.expr("root <> main").alias("stray")))
    if not mixed.isEmpty():
        found = tables.put(_alike(_stray_pairs(mixed.where(F.col("m") <= PAIRED)), sequences, similarity))
        wide = tables.put(mixed.where(F.col("m") > PAIRED).groupBy("c", "root").agg(F.max("stray").alias("stray")))
        if not wide.isEmpty():
            found = found.union(_stray_links(tables.put(sequences.join(wide, "c")), similarity, tables))
        roots = joined_components(roots, found, tables)
    own = rows.groupBy("c").agg(F.min(F.struct("id", *KEY)).alias("least"), F.count(F.lit(1)).alias("rows"))
    own = tables.put(own.join(roots, "c", "left").select("c", "least", "rows", F.coalesce("root", "c").alias("root")))
    groups = own.groupBy("root").agg(F.min("least").alias("rep"), F.sum("rows").alias("class_size"))
    numbered = own.join(groups, "root").select("c", "rep", "class_size")
    is_rep = F.struct("id", *KEY).eqNullSafe(F.col("rep"))
    return (rows.select("id", *KEY, "c").join(numbered, "c")
            .select("id", *KEY, F.col("rep.id").alias("class_id"), "class_size", is_rep.alias("representative")))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The documents with one row of each class, columns as they are."""
    kept = classes(docs, id_col, text, similarity).where("representative").select(*KEY).distinct()
    return with_documents(docs, kept)


__all__ = ["classes", "deduplicated", "components", "joined_components", "common_length", "order_sketches", "SIMILARITY"]
