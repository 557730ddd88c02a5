"""Conversation repair against exhaustive search, against a table over all spans and splits, and on odd tables."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from breachlens.llm import conversations as cv
from breachlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
GOAL = re.compile(r"(s?(ua)+)?")


# ── a plain version: damage, faults, and the cheapest edits by search over whole output strings ──────────────────────

def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        sp = lambda x: " " if x is None else str(x)
        fault = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
        role, text = sp(role), sp(text)
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        out += [(conv, turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def md5(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.strip(" \t\n\x0b\f\r")
        out.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def cheapest(initials, fault):
    """(cost, audit) by trying every edit of every row and up to two insertions a gap."""
    found = []
    gaps = [list(itertools.chain([()], itertools.product("ua"), itertools.product("ua", "ua")))] * (len(initials) + 1)

    def rows(k):
        delete = [(4, "D", "")]
        if fault[k] in (1, 2):
            return delete
        more = 3 * (fault[k] == 3)
        return delete + [(more, "K", initials[k])] + [(3 + more, "R", r) for r in "ua"]

    def go(k, cost, audit, out):
        for ins in gaps[k]:
            c, a, o = cost + 3 * len(ins), audit + "I" * len(ins), out + "".join(ins)
            if k == len(initials):
                if GOAL.fullmatch(o):
                    found.append((c, a))
                continue
            if not re.match(r"(s?(ua)*u?)?$", o):
                continue
            for dc, da, do in rows(k):
                go(k + 1, c + dc, a + da, o + do)

    go(0, 0, "", "")
    return min(found)


def repaired(rows, audit):
    out, rest, user = [], iter(rows), True
    for edit in audit:
        if edit == "I":
            role, text = ("user", "assistant")[not user], ""
        else:
            _, _, role, text = next(rest)
            if edit == "D":
                continue
            if edit == "R":
                role = ("user", "assistant")[not user]
        if not role.startswith("s"):
            user = not user
        out.append((role, text))
    return out


def expected(conv, rows):
    rows = sorted((r for r in damage(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, md5(r[2], r[3])))
    fault = faults(rows)
    initials = [r[2][:1] for r in rows]
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit = best_by_rows(initials, fault)
    text = "\n".join(f"{r}:{t}" for r, t in repaired(rows, audit))
    return (conv, gaps, fault.count(1), fault.count(2), fault.count(3), illegal, cost, audit,
            hashlib.sha256(text.encode()).hexdigest())


def best_by_rows(initials, fault):
    """(cost, audit), row by row over the roles of the whole output so far (kept short by its last role)."""
    start = {"": (0, "")}

    def put(states, key, value):
        if key not in states or value < states[key]:
            states[key] = value

    def inserted(states):
        for _ in range(2):
            for out, (c, a) in list(states.items()):
                put(states, "a" if out == "u" else "u", (c + 3, a + "I"))
        return states

    states = inserted(dict(start))
    for i, f in zip(initials, fault):
        new = {}
        for out, (c, a) in states.items():
            put(new, out, (c + 4, a + "D"))
            if f in (1, 2):
                continue
            more = 3 * (f == 3)
            follows = "a" if out == "u" else "u"
            put(new, follows, (c + 3 + more, a + "R"))
            if i == follows or (i == "s" and out == ""):
                put(new, i, (c + more, a + "K"))
        states = inserted(new)
    return min(states[k] for k in ("", "a") if k in states)


# ── cells ────────────────────────────────────────────────────────────────────

def code(initial, fault):
    return chr(97 + 3 * (cv.CLASSES.index(initial) if initial in "sua" else 3) + {0: 0, 1: 2, 2: 2, 3: 1}[fault])


def test_cells_against_exhaustive_search():
    rng = random.Random(5)
    assert cv.best(cv.CLOSURE) == (0, "")
    for _ in range(150):
        n = rng.randint(1, 4)
        initials, fault = rng.choices("suax", k=n), rng.choices([0, 0, 0, 1, 2, 3], k=n)
        want = cheapest(initials, fault)
        assert cv.best(cv.span("".join(map(code, initials, fault)))) == want == best_by_rows(initials, fault)


def test_one_split_is_all_splits():
    rng = random.Random(6)
    for _ in range(40):
        n = rng.randint(2, 9)
        codes = "".join(rng.choice("abcdefghijkl") for _ in range(n))
        table = {(i, i + 1): cv.leaf(codes[i]) for i in range(n)}
        for length in range(2, n + 1):                       # bottom-up by span length, every split
            for i in range(n - length + 1):
                made = [cv.combine(table[i, k], table[k, i + length]) for k in range(i + 1, i + length)]
                table[i, i + length] = [min(filter(None, cells), default=None) for cells in zip(*made)]
        assert table[0, n] == cv.span(codes)


# ── tables ───────────────────────────────────────────────────────────────────

COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def check(spark, rows, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema)
    rows = [r[:4] for r in rows]
    want = sorted((expected(c, rows) for c in {r[0] for r in rows}), key=str)
    assert got(cv.audited(df, cv.damaged(df))) == want


def test_op11(spark):
    rows = duckdb.connect().sql(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet'").fetchall()
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    assert got(QUERIES["op11_conversations"](spark, SF)) == sorted((expected(c, own) for c, own in by.items()), key=str)


def odd_rows():
    rng = random.Random(8)
    texts = ["Yes.", "No", " ", "", None, "So? ", "Ends\n", "é!", "dot. ", "\x85"]
    rows = [(c, rng.choice([None, 0, 1, 2, 3, 9]), rng.choice(["user", "assistant", "system", "User", "tool", "", None, "u2"]),
             rng.choice(texts)) for c in [None, 1, 2, 3, 4, 5] for _ in range(12)]
    return rows + rows[:9] + [(7, None, None, None)] + [(100 + i, 0, "user", "Hi.") for i in range(40)]


def test_odd_rows(spark):
    check(spark, odd_rows())
    check(spark, [r + ("x", "y") for r in odd_rows()[:30]], SCHEMA + ", head string, code string")
    check(spark, [])


@pytest.fixture
def short_runs(monkeypatch):
    monkeypatch.setattr(cv, "RUN_BITS", 2)
    monkeypatch.setattr(cv, "FAN", 3)


def test_long_conversation_over_many_runs(spark, short_runs):
    rng = random.Random(9)
    long = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["A.", "B", "a long one. " * 30, f"{t}."])) for t in range(400)]
    check(spark, long + odd_rows()[:20])


def test_repeated_row_fills_a_conversation(spark, short_runs):
    check(spark, [(1, 5, "user", "Same.")] * 150 + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Ho.")])


def test_repaired_rows(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    damaged = cv.damaged(df).cache()
    heads = cv.heads(df, damaged)
    made = {}
    for r in cv.repaired(damaged, heads).orderBy("conv_id", "place").collect():
        made.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    for conv, *_, audit, digest in (expected(c, rows) for c in {r[0] for r in rows}):
        own = made.get(conv, [])
        assert hashlib.sha256("\n".join(f"{a}:{b}" for a, b in own).encode()).hexdigest() == digest
        assert GOAL.fullmatch("".join(a[0] for a, _ in own))
