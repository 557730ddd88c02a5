"""Conversation structure repair by weighted CYK interval parsing.

Rows of a conversation, ordered by turn, become role initials that have to form ``(s?(ua)+)?``: nothing, or user and
assistant in turns after at most one system row. Edits and their cells: Keep 0, Rerole to user or assistant 3, Delete 4
(the only choice for blank and duplicate rows), Insert an empty user or assistant row 3; a truncated row that stays
adds 3. The cheapest edits win, ties go to the ASCII-least audit (the edits' initials in order).

The grammar is in Chomsky normal form: the non-terminal (p, q) derives the spans that lead from state p to state q of the
target language, with rules (p, q) -> (p, r) (r, q), terminal rules for the edits of one row, and the closure over
insertions in front of a row folded into its terminal cells. A cell holds the minimum (cost, audit) of a span. Spans are
combined bottom-up by length: 1, 2, 4, … rows. Every derivation of a span can be bracketed at any split, so one split
a span gives the same cells as all splits do (the tests compare with a table over all spans and splits). Of two audits
of one span and equal cost neither begins the other, as an audit fixes its cost; so the least of joined audits comes from
least parts, and cells never need a second candidate.

On Spark: the rows without their texts are sorted by range, so a conversation of any length lies over many tasks; runs of
at most ``RUN`` rows are parsed to cells in Arrow batches, and the runs of a longer conversation are combined ``FAN`` at
a time, level by level. Texts are shuffled once, to be read in order by a task that keeps one row at a time, since
a digest over a whole conversation can only be taken in order.

Defined cases: null role or text is one space, so such rows are no legal role, and blank; null turns come first, rows of
one turn are ordered by a digest of role and text (equal rows are neighbours); an empty role has no legal initial; a null
id is a conversation of its own; an empty table gives no rows; extra columns are ignored. An audit is one string, so a
conversation has less than 2^31 edits.
"""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from breachlens.llm.arrow_text import bounded_batches
from breachlens.llm.rows import Tables

RUN_BITS = 12
RUN = 1 << RUN_BITS        # most rows that are parsed together
FAN = 64                   # runs that are combined together
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
SPACE = " \t\n\x0b\f\r"
CLASSES = "sua?"           # classes of role initials; "?" is any other
LEGAL = {"su", "ua", "au"}

# States: 0 nothing yet, 1 after the system row, 2 after a user row, 3 after an assistant row. Ends: 0 and 3.
STEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
CELLS = [(p, q) for p in range(4) for q in range(4) if p == q or p < q and q > 1 or (p, q) in ((0, 1), (3, 2))]
_PLACE = {c: k for k, c in enumerate(CELLS)}
_RULES = [[(_PLACE[p, r], _PLACE[r, q]) for r in range(4) if (p, r) in _PLACE and (r, q) in _PLACE] for p, q in CELLS]


# ── cells ────────────────────────────────────────────────────────────────────

def combine(left: list, right: list) -> list:
    """The cells of two neighbouring spans as one: the minimum over the states between them."""
    out = []
    for rules in _RULES:
        best = None
        for i, j in rules:
            x, y = left[i], right[j]
            if x is not None and y is not None and (best is None or x[0] + y[0] <= best[0]):
                made = (x[0] + y[0], x[1] + y[1])
                best = made if best is None else min(best, made)
        out.append(best)
    return out


def _closure() -> list:
    """Cells of the empty span: the fewest insertions that lead from one state to another."""
    cells = [(0, "") if p == q else None for p, q in CELLS]
    for a in "ua":
        for p, q in STEPS[a].items():
            cells[_PLACE[p, q]] = (INSERT, "I")
    return combine(cells, cells)        # two insertions reach every state that can be reached


CLOSURE = _closure()


def leaf(code: str) -> list:
    """Cells of one row with the insertions in front of it. ``code``: see ``_code``."""
    kind, fault = divmod(ord(code) - 97, 3)
    cells = [(DELETE, "D") if p == q else None for p, q in CELLS]
    if fault < 2:
        extra = CUT_OFF * fault
        for role in "ua":
            for p, q in STEPS[role].items():
                cells[_PLACE[p, q]] = (REROLE + extra, "R")
        for p, q in STEPS.get(CLASSES[kind], {}).items():
            cells[_PLACE[p, q]] = (extra, "K")
    return combine(CLOSURE, cells)


def span(codes: str) -> list:
    """Cells of a run of rows."""
    return _short(codes) if len(codes) <= 16 else _joined(codes)


def _joined(codes: str) -> list:
    if len(codes) == 1:
        return leaf(codes)
    half = 1 << (len(codes) - 1).bit_length() - 1
    return combine(span(codes[:half]), span(codes[half:]))


_short = functools.lru_cache(1 << 14)(_joined)


def best(cells: list) -> tuple[int, str]:
    """(cost, audit) of the whole: the cheapest way from nothing to an end, insertions after the last row included."""
    closed = combine(cells, CLOSURE)
    return min(c for c in (closed[_PLACE[0, 0]], closed[_PLACE[0, 3]]) if c is not None)


# ── rows ─────────────────────────────────────────────────────────────────────

def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that crc32(``conv_id:turn``) % 20 chooses."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    df = conversations.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"),
                              (F.crc32(F.concat_ws(":", filled("conv_id"), filled("turn"))) % 20).alias("fault"))
    text = (F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text")))
    times = F.when(F.col("fault") == 3, 2).otherwise(1)
    return df.where("fault <> 0").select(
        "conv_id", "turn", F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("_")).drop("_")


def _ordered(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and the digest that orders rows of one turn."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    df = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    return df.withColumn("digest", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))


def _code(fault: Column) -> Column:
    """One letter for a row: class of its initial and what its fault allows (0 all, 1 truncated, 2 delete)."""
    kind = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in "sua"]), F.substring("role", 1, 1)), F.lit(0))
    kind = F.when(kind == 0, 3).otherwise(kind - 1)
    way = F.when(fault.isin(BLANK, DUPLICATE), 2).when(fault == TRUNCATED, 1).otherwise(0)
    return F.char(97 + kind * 3 + way)


def flagged(rows: DataFrame, tables: Tables) -> DataFrame:
    """conv_id, turn, at (place in the order of all rows), fault (0 none, else the row's first fault) and code."""
    bare = F.rtrim("text", F.lit(SPACE))
    own = F.when(bare == "", BLANK).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    narrow = tables.put(_ordered(rows).select("conv_id", "turn", "digest", F.substring("role", 1, 1).alias("role"),
                                              own.alias("own"), F.monotonically_increasing_id().alias("r")))
    by = ["conv_id", "turn", "digest", "r"]      # r parts even rows that agree in all else
    laid = tables.put(narrow.repartitionByRange(*by).sortWithinPartitions(*by).drop("r")
                      .withColumn("at", F.monotonically_increasing_id()))
    repeated = (laid.groupBy("conv_id", "digest").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
                .where("n > 1").select(F.col("conv_id").alias("_id"), F.col("digest").alias("_digest"), "first"))
    both = laid.join(repeated, laid["conv_id"].eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    fault = (F.when(F.col("own") == BLANK, BLANK).when(F.col("at") > F.col("first"), DUPLICATE)
             .otherwise(F.col("own")))
    return both.select("conv_id", "turn", "at", fault.alias("fault"), _code(fault).alias("code"))


_SUMS = ("blank", "duplicate", "truncated", "illegal")


def _parts_schema(rows: DataFrame) -> T.StructType:
    return T.StructType([
        T.StructField("conv_id", rows.schema["conv_id"].dataType), T.StructField("no", T.LongType()),
        T.StructField("first", T.StringType()), T.StructField("last", T.StringType()),
        T.StructField("low", rows.schema["turn"].dataType), T.StructField("high", rows.schema["turn"].dataType),
        T.StructField("turns", T.LongType()), *[T.StructField(c, T.LongType()) for c in _SUMS],
        T.StructField("cost", T.ArrayType(T.LongType())), T.StructField("audit", T.ArrayType(T.StringType()))])


def _initial(code: str) -> str:
    return CLASSES[(ord(code) - 97) // 3]


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _with_cells(row: dict, cells: list) -> dict:
    return {**row, "cost": [c and c[0] for c in cells], "audit": [c and c[1] for c in cells]}


def _cells(row: dict) -> list:
    return [None if a is None else (c, a) for c, a in zip(row["cost"], row["audit"])]


def _merged(parts: list[dict]) -> dict:
    """Neighbouring parts of one conversation as one, pairs of neighbours first."""
    while len(parts) > 1:
        paired = []
        for k in range(0, len(parts) - 1, 2):
            a, b = parts[k], parts[k + 1]
            one = {**a, "last": b["last"], "low": b["low"] if a["low"] is None else a["low"],
                   "high": a["high"] if b["high"] is None else b["high"],
                   "turns": a["turns"] + b["turns"] - (a["high"] is not None and a["high"] == b["low"]),
                   **{c: a[c] + b[c] for c in _SUMS}}
            one["illegal"] += _initial(a["last"]) + _initial(b["first"]) not in LEGAL
            paired.append(_with_cells(one, combine(_cells(a), _cells(b))))
        parts = paired + parts[len(paired) * 2:]
    return parts[0]


def parsed(rows: DataFrame, tables: Tables) -> DataFrame:
    """One row per conversation: conv_id, low, high, turns, blank, duplicate, truncated, illegal, cost and audit."""
    marked = flagged(rows, tables)
    schema = _parts_schema(rows)
    arrow = _arrow_schema(schema)

    def parse(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                codes = r.pop("codes")
                initials = [_initial(c) for c in codes]
                illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
                out.append(_with_cells({**r, "first": codes[0], "last": codes[-1], "illegal": illegal}, span(codes)))
            yield _batch(out, arrow)

    def merge(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                parts = sorted(r["parts"], key=lambda p: p["no"])
                out.append({**_merged([{"conv_id": r["conv_id"], **p} for p in parts]), "no": r["no"]})
            yield _batch(out, arrow)

    in_order = F.sort_array(F.collect_list(F.struct("at", "code")))
    runs = marked.groupBy("conv_id", F.expr(f"shiftright(at, {RUN_BITS})").alias("no")).agg(
        F.array_join(F.transform(in_order, lambda x: x["code"]), "").alias("codes"),
        F.min("turn").alias("low"), F.max("turn").alias("high"), F.size(F.collect_set("turn")).cast("long").alias("turns"),
        *[F.count_if(F.col("fault") == f).alias(c) for f, c in ((BLANK, "blank"), (DUPLICATE, "duplicate"),
                                                                (TRUNCATED, "truncated"))])
    parts = tables.put(bounded_batches(runs).mapInArrow(parse, schema))
    done = []
    while True:
        counts = parts.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
        held = parts.join(counts.withColumnRenamed("conv_id", "_id"), F.col("conv_id").eqNullSafe(F.col("_id"))).drop("_id")
        done.append(held.where("n = 1").drop("n"))
        # one row per run of RUN rows, fewer on every level
        numbered = held.where("n > 1").withColumn("no", F.row_number().over(
            Window.partitionBy("conv_id").orderBy("no")).cast("long") - 1)
        longer = numbered.groupBy("conv_id", F.expr(f"no div {FAN}").alias("group")).agg(F.collect_list(F.struct(
            *[f.name for f in schema.fields if f.name != "conv_id"])).alias("parts"))
        longer = tables.put(bounded_batches(longer.withColumnRenamed("group", "no")).mapInArrow(merge, schema))
        if longer.isEmpty():
            break
        parts = longer
    whole = functools.reduce(DataFrame.union, done)

    def finish(batches):
        for batch in batches:
            found = [best(_cells(r)) for r in batch.select(["cost", "audit"]).to_pylist()]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in kept_names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([f[0] for f in found], pa.int64()),
                                              pa.array([f[1] for f in found], pa.string())],
                                             names=[*kept_names, "cost", "audit"])

    kept_names = ["conv_id", "low", "high", "turns", *_SUMS]
    final = T.StructType([*[schema[c] for c in kept_names], T.StructField("cost", T.LongType()),
                          T.StructField("audit", T.StringType())])
    return bounded_batches(whole.select(*schema.names)).mapInArrow(finish, final)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


# ── repaired texts ───────────────────────────────────────────────────────────

class Walk:
    """Follows an audit along the rows of one conversation, as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.user = audit, 0, True

    def _next_role(self) -> str:
        role = "user" if self.user else "assistant"
        self.user = not self.user
        return role

    def inserted(self):
        """The rows inserted here (role, text)."""
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._next_role(), ""

    def row(self, role: str, text: str):
        """The rows that the insertions before a row, and the row itself, become."""
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            yield self._next_role(), text
        elif edit == "K":
            if not role.startswith("s"):
                self._next_role()
            yield role, text


def _streamed(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Each conversation's head (conv_id, audit, …) and after it its rows in order, conversations end to end."""
    head = heads.select("conv_id", F.lit(0).alias("tag"), F.struct(*[c for c in heads.columns if c != "conv_id"]).alias("head"),
                        F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit(None).cast("string").alias("digest"),
                        F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    body = _ordered(rows).select("conv_id", F.lit(1).alias("tag"), F.lit(None).cast(head.schema["head"].dataType).alias("head"),
                                 "turn", "digest", "role", "text")
    return bounded_batches(head.union(body).repartition("conv_id").sortWithinPartitions("conv_id", "tag", "turn", "digest")
                           .select("conv_id", "tag", "head", "role", "text"))


def repaired(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """The repaired rows (conv_id, place, role, text) of rows and their heads (conv_id, audit)."""
    schema = T.StructType([rows.schema["conv_id"], T.StructField("place", T.LongType()), T.StructField("role", T.StringType()),
                           T.StructField("text", T.StringType())])
    arrow = _arrow_schema(schema)

    def run(batches):
        walk, conv, place, out = None, None, 0, []

        def put(made):
            nonlocal place
            for role, text in made:
                out.append({"conv_id": conv, "place": place, "role": role, "text": text})
                place += 1

        for batch in batches:
            for r in batch.to_pylist():
                if r["tag"] == 0:
                    if walk is not None:
                        put(walk.inserted())
                    walk, conv, place = Walk(r["head"]["audit"]), r["conv_id"], 0
                else:
                    put(walk.row(r["role"], r["text"]))
            yield _batch(out, arrow)
            out = []
        if walk is not None:
            put(walk.inserted())
            yield _batch(out, arrow)

    return _streamed(rows, heads.select("conv_id", "audit")).mapInArrow(run, schema)


def _with_digests(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """The heads with ``repaired_sha256``, of the repaired ``role:text`` joined by line breaks."""
    names = [c for c in heads.columns if c != "conv_id"]
    schema = T.StructType([*heads.schema.fields, T.StructField("repaired_sha256", T.StringType())])
    schema = T.StructType([schema["conv_id"], *[schema[c] for c in names], schema["repaired_sha256"]])
    arrow = _arrow_schema(schema)

    def run(batches):
        walk, head, digest, out = None, None, None, []

        def put(made):
            nonlocal first
            for role, text in made:
                digest.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
                first = False

        first = True
        for batch in batches:
            for r in batch.to_pylist():
                if r["tag"] == 0:
                    if walk is not None:
                        put(walk.inserted())
                        out.append({**head, "repaired_sha256": digest.hexdigest()})
                    head = {"conv_id": r["conv_id"], **r["head"]}
                    walk, digest, first = Walk(head["audit"]), hashlib.sha256(), True
                else:
                    put(walk.row(r["role"], r["text"]))
            yield _batch(out, arrow)
            out = []
        if walk is not None:
            put(walk.inserted())
            yield _batch([{**head, "repaired_sha256": digest.hexdigest()}], arrow)

    return _streamed(rows, heads).mapInArrow(run, schema)


def heads(conv_ids: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each of ``conv_ids``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    tables = Tables(rows.sparkSession, "conversations")
    found = parsed(rows, tables)
    gaps = F.col("high") - F.col("low") + 1 - F.col("turns")
    found = found.select(F.col("conv_id").alias("_id"), gaps.alias("gaps"), *_SUMS, "cost", "audit")
    ids = conv_ids.select("conv_id").distinct()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return tables.put(ids.join(found, F.col("conv_id").eqNullSafe(F.col("_id")), "left").select(
        "conv_id", zero("gaps"), *[zero(c) for c in _SUMS], zero("cost"), F.coalesce("audit", F.lit("")).alias("audit")))


def audited(conv_ids: DataFrame, rows: DataFrame) -> DataFrame:
    """``heads`` with the digest of each repaired conversation."""
    return _with_digests(rows, heads(conv_ids, rows))


__all__ = ["damaged", "flagged", "parsed", "heads", "repaired", "audited", "combine", "leaf", "span", "best", "Walk"]
