"""Vector codes by product quantisation, trained with dual-tree Lloyd rounds in exact integers.

Vectors become integers floor(1024 · x) and are cut into ``PARTS`` equal parts; each part has a codebook of at most
``ENTRIES`` entries, which start as that part of the vectors of least id. A round assigns every part to its nearest
entry (squared distance, ties to the lower index) and moves each entry to the floor of its parts' mean; entries without
parts stay. After ``ROUNDS`` rounds parts are assigned once more.

Assignment is a walk over pairs of nodes of two trees, one over the parts of a block of vectors, one over the entries.
Nodes have bounding boxes; a pair whose least distance exceeds the greatest distance of the part node to another of its
entry nodes can hold no nearest entry and is pruned. A part node with one entry left is assigned whole, and adds its
cached sum and count; leaves with several entries left compare integers. Doubles hold these integers exactly as long as
squared distances stay under 2^53, which is checked beforehand; beyond, Python's integers take their place.

On Spark: blocks of a task's rows are assigned in Arrow batches, tasks give sums and counts per (part, entry), and Spark
adds them up; the codebooks, ``ENTRIES`` rows of a vector's width, are all that the driver holds and broadcasts. Every
round reads the written table of integers, so a lost executor costs its tasks only.

Defined cases: rows whose vector is null or holds a null, NaN or infinite component are left out; shorter vectors are
filled with zeros to the longest, and that to a multiple of four; null ids come last in the choice of first entries,
equal ids are ordered by vector; with fewer vectors than entries the codebooks are smaller; repeated rows count as often
as they occur; null labels are one label; errors that no long can hold are null; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breachlens.llm.arrow_text import bounded_batches
from breachlens.llm.rows import Tables

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
BLOCK = 4096               # vectors of a part tree
LEAF = 64                  # parts of a leaf
EXACT = 1 << 53            # integers below are exact doubles
LONG = 1 << 62


# ── inside tasks ─────────────────────────────────────────────────────────────

class Tree:
    """A binary tree over points by halves along the widest side. Node i has the points ``order[start[i]:end[i]]``, the
    box ``low[i]`` to ``high[i]`` and, unless it is a ``leaf``, the children 2i+1 and 2i+2; numbers in between stay unused."""

    def __init__(self, points: np.ndarray, most: int):
        n = len(points)
        depth = max(0, int(np.ceil(np.log2(n / most)))) if n else 0
        size = (2 << depth) - 1
        self.order = np.arange(n)
        self.start, self.end = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.low = np.zeros((size, points.shape[1]), points.dtype)
        self.high = np.zeros_like(self.low)
        self.end[0] = n
        self.leaf = np.zeros(size, bool)
        for i in range(size):
            a, b = self.start[i], self.end[i]
            if a == b:
                continue
            self.leaf[i] = b - a <= most
            own = points[self.order[a:b]]
            self.low[i], self.high[i] = own.min(axis=0), own.max(axis=0)
            if not self.leaf[i]:
                half = (b - a) // 2
                side = int(np.argmax(self.high[i] - self.low[i]))
                self.order[a:b] = self.order[a:b][np.argpartition(own[:, side], half)]
                for child, lo, hi in ((2 * i + 1, a, a + half), (2 * i + 2, a + half, b)):
                    self.start[child], self.end[child] = lo, hi

    def width(self) -> np.ndarray:
        return (self.high - self.low).max(axis=1)


def distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances, exact: see ``EXACT``."""
    return (points * points).sum(axis=1)[:, None] - 2 * (points @ entries.T) + (entries * entries).sum(axis=1)[None, :]


def _children(i: np.ndarray) -> np.ndarray:
    return np.stack([2 * i + 1, 2 * i + 2], axis=1)


class Codebook:
    """Entries of one part and their tree, of which every leaf is one entry."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.tree = entries, Tree(entries, 1)
        self.wide = self.tree.width()

    def assign(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes, sums, counts): nearest entry of every point, sum and number of the points of every entry."""
        parts, book = Tree(points, LEAF), self.tree
        part_wide = parts.width()
        codes = np.empty(len(points), np.int64)
        sums, counts = np.zeros_like(self.entries), np.zeros(len(self.entries), np.int64)
        before = np.concatenate([np.zeros((1, points.shape[1]), points.dtype), np.cumsum(points[parts.order], axis=0)])
        single = book.end - book.start == 1
        q, e = np.zeros(1, np.int64), np.zeros(1, np.int64)
        while len(q):                                     # pairs of nodes; those of one part node stay together
            first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
            node = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(q))))
            apart = np.maximum(book.low[e] - parts.high[q], parts.low[q] - book.high[e])
            apart = np.maximum(apart, 0 * apart)
            far = np.maximum(book.high[e] - parts.low[q], parts.high[q] - book.low[e])
            least, most = (apart * apart).sum(axis=1), (far * far).sum(axis=1)
            keep = least <= np.minimum.reduceat(most, first)[node]
            q, e = q[keep], e[keep]
            first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
            left = np.diff(np.append(first, len(q)))
            node = np.repeat(np.arange(len(first)), left)
            all_single = np.logical_and.reduceat(single[e], first)
            for k in np.flatnonzero((left == 1) & all_single):          # whole nodes
                i, j = q[first[k]], book.order[book.start[e[first[k]]]]
                a, b = parts.start[i], parts.end[i]
                codes[parts.order[a:b]] = j
                sums[j] += before[b] - before[a]
                counts[j] += b - a
            leaf = parts.leaf[q[first]] & ((left > 1) | ~all_single)
            for k in np.flatnonzero(leaf):                # uncertain leaves: integers
                i, nodes = q[first[k]], e[first[k]:first[k] + left[k]]
                near = np.sort(np.concatenate([book.order[book.start[x]:book.end[x]] for x in nodes]))
                own = parts.order[parts.start[i]:parts.end[i]]
                found = near[np.argmin(distances(points[own], self.entries[near]), axis=1)]
                codes[own] = found
                by = np.argsort(found, kind="stable")
                at = np.flatnonzero(np.concatenate([[True], found[by][1:] != found[by][:-1]]))
                sums[found[by][at]] += np.add.reduceat(points[own[by]], at, axis=0)
                counts[found[by][at]] += np.diff(np.append(at, len(own)))
            open_ = ~leaf & ~((left == 1) & all_single)
            # the wider of the two goes on to its children
            split_entry = open_ & ~all_single & (np.maximum.reduceat(self.wide[e], first) >= part_wide[q[first]])
            both = (split_entry[node] & ~single[e])[:, None]
            halves = (open_ & ~split_entry)[node]
            eq = np.repeat(q[:, None], 2, axis=1)
            grown = np.where(both, _children(e), np.stack([e, np.full_like(e, -1)], axis=1))
            grown[~split_entry[node]] = -1
            rows = grown.ravel() >= 0
            new_q, new_e = eq.ravel()[rows], grown.ravel()[rows]
            hq, he = q[halves], e[halves]
            new_q = np.concatenate([new_q, _children(hq).T.ravel()])
            new_e = np.concatenate([new_e, he, he])
            by = np.argsort(new_q, kind="stable")
            q, e = new_q[by], new_e[by]
        return codes, sums, counts


def _blocks(batch: pa.RecordBatch, width: int, kind):
    """The vectors of a batch, ``BLOCK`` at a time, as (first row, matrix of integers)."""
    column = batch.column(batch.schema.get_field_index("v"))
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    for a in range(0, len(values), BLOCK):
        own = values[a:a + BLOCK]
        yield a, own if kind is float else np.array([[int(x) for x in row] for row in own.tolist()], object).reshape(own.shape)


# ── on Spark ─────────────────────────────────────────────────────────────────

def integers(vectors: DataFrame, tables: Tables, vec_id: str = "vec_id", embedding: str = "embedding",
             label: str = "label") -> tuple[DataFrame, int, int, int]:
    """(table of vec_id, label and v; width, greatest magnitude and rows): v are the scaled components as doubles."""
    own = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("x"))
    scaled = lambda x: x * SCALE
    # a product beyond 2^62 has no fraction, and floor() would not fit a long
    whole = lambda y: F.when(F.abs(y) < float(LONG), F.floor(y).cast("double")).otherwise(y)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(scaled(x)) == float("inf"))
    good = own.where(F.col("x").isNotNull() & ~F.exists("x", bad)).select(
        "vec_id", "label", F.transform("x", lambda x: whole(scaled(x))).alias("v"))
    good = tables.put(good)
    top = lambda v: F.greatest(F.abs(F.array_max(v)), F.abs(F.array_min(v)))
    r = good.agg(F.max(F.size("v")), F.min(F.size("v")), F.max(top(F.col("v"))), F.count(F.lit(1))).first()
    width = -(-(r[0] or 0) // PARTS) * PARTS
    if r[3] and r[1] != width:
        good = tables.put(good.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("v")))))
    return good, width, int(r[2] or 0), r[3]


def _first_entries(table: DataFrame, width: int, kind) -> list[np.ndarray]:
    """The codebooks that the vectors of least id start with."""
    rows = table.select("vec_id", "v").orderBy(F.col("vec_id").isNull(), "vec_id", "v").limit(ENTRIES).collect()
    whole = np.array([[kind(x) for x in r["v"]] for r in rows], kind if kind is float else object).reshape(len(rows), width)
    return np.split(whole, PARTS, axis=1)


def _moved(table: DataFrame, books: list[np.ndarray], width: int, kind, long: bool) -> list[np.ndarray]:
    """The codebooks after one round."""
    number = pa.int64() if long else pa.decimal128(38, 0)
    sent = table.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        own = [Codebook(b) for b in sent.value]
        sums = [np.zeros(b.entries.shape, np.int64 if long else object) for b in own]
        counts = [np.zeros(len(b.entries), np.int64) for b in own]
        for batch in batches:
            for _, rows in _blocks(batch, width, kind):
                for p, (book, part) in enumerate(zip(own, np.split(rows, PARTS, axis=1))):
                    _, s, n = book.assign(part)
                    sums[p] += s.astype(np.int64) if long else np.array([[int(x) for x in row] for row in s.tolist()], object).reshape(s.shape)
                    counts[p] += n
        for p in range(PARTS):
            used = np.flatnonzero(counts[p])
            if len(used):
                flat = sums[p][used].ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * (width // PARTS), pa.int32()),
                                                 pa.array(flat if long else flat.tolist(), number))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), p), pa.int32()), pa.array(used, pa.int32()),
                                                  pa.array(counts[p][used], pa.int64()), lists], names=["part", "entry", "n", "s"])

    kind_name = "bigint" if long else "decimal(38,0)"
    found = bounded_batches(table.select("v")).mapInArrow(run, f"part int, entry int, n bigint, s array<{kind_name}>")
    each = found.select("part", "entry", "n", F.posexplode("s").alias("at", "s")).groupBy("part", "entry", "at").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"))
    out = [b.copy() for b in books]
    for r in each.collect():                               # at most ENTRIES rows of a vector's width
        out[r["part"]][r["entry"], r["at"]] = kind(int(r["s"]) // r["n"])
    sent.destroy()
    return out


def codes(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
          rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(rows, codebooks): vec_id, label, code (two hexadecimal digits a part), error and label_error of every kept
    vector, and the final entries of each part."""
    spark = vectors.sparkSession
    tables = Tables(spark, "vector-codes")
    table, width, top, n = integers(vectors, tables, vec_id, embedding, label)
    exact = width // PARTS * (2 * top + 1) ** 2 < EXACT and top * BLOCK < EXACT
    kind = float if exact else int
    books = _first_entries(table, width, kind)
    for _ in range(rounds if n and width else 0):
        books = _moved(table, books, width, kind, exact and top * n < LONG)
    sent = spark.sparkContext.broadcast(books)

    def run(batches):
        own = [Codebook(b) for b in sent.value] if width else []
        for batch in batches:
            names, error = np.zeros((batch.num_rows, PARTS), np.uint8), [0] * batch.num_rows
            for a, rows in _blocks(batch, width, kind) if width else ():
                total = np.zeros(len(rows), rows.dtype)
                for p, (book, part) in enumerate(zip(own, np.split(rows, PARTS, axis=1))):
                    chosen, _, _ = book.assign(part)
                    apart = part - book.entries[chosen]
                    total = total + (apart * apart).sum(axis=1)
                    names[a:a + len(rows), p] = chosen
                error[a:a + len(rows)] = [int(x) for x in total.tolist()]
            error = [x if x < 1 << 63 else None for x in error]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("vec_id", "label")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([bytes(x).hex() for x in names], pa.string()),
                                              pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    types = {f.name: f.dataType.simpleString() for f in table.schema.fields}
    made = tables.put(bounded_batches(table).mapInArrow(
        run, f"vec_id {types['vec_id']}, label {types['label']}, code string, error bigint"))
    sent.destroy()     # the rows that it made are written
    sums = made.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("bigint").alias("label_error"))
    sums = sums.withColumnRenamed("label", "_label")
    return made.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label"), books


def books_sha256(books: list[np.ndarray]) -> str:
    """Digest of all entries' components by part, entry and position."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


__all__ = ["codes", "integers", "books_sha256", "Codebook", "Tree", "distances"]
