"""Brute-force versions of the operators, in plain Python, for small tables."""

from __future__ import annotations

import collections
import hashlib
import re

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile("[^\x20\x09-\x0D]+")


def lower(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))


def words(text: str | None) -> list[str]:
    return WORD.findall(lower(text))


def contaminated(docs, items, window: int = 10):
    """doc_id → (n_words, n_hit, item ids, sorted as strings)."""
    windows = collections.defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[j:j + n])].add(str(item))
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                own = windows.get(tuple(w[j:j + n]))
                if own:
                    hit.update(range(j, j + n))
                    found |= own
        out[doc] = (len(w), len(hit), sorted(found))
    return out


def shingles(w: list[str], size: int = 5) -> list[tuple]:
    return [tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))] if w else []


def common(a: list, b: list) -> int:
    """Length of the longest common subsequence, by the table."""
    row = [0] * (len(b) + 1)
    for x in a:
        corner = 0
        for j, y in enumerate(b):
            corner, row[j + 1] = row[j + 1], corner + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def similarity(a: list, b: list) -> float:
    """L / (n + m - L) with the longest common subsequence L."""
    length = common(a, b)
    return length / (len(a) + len(b) - length)


def alike(docs, least: float = 0.8) -> list[tuple]:
    """All pairs of documents that are alike, texts without words by equality. Pairs whose words, in any order, can't
    reach the similarity are not aligned."""
    made = sorted(((d, t or "", words(t)) for d, t in docs), key=lambda x: len(x[2]))
    bags, out = [collections.Counter(w) for _, _, w in made], []
    for i, (a, ta, wa) in enumerate(made):
        for j in range(i + 1, len(made)):
            b, tb, wb = made[j]
            if not wa or not wb:
                if not wb and ta == tb:
                    out.append((a, b))
                if wb:
                    break
                continue
            if len(wa) < least * len(wb):
                break
            shared = (bags[i] & bags[j]).total()
            if shared >= least * (len(wa) + len(wb) - shared) - 1e-9 and (wa == wb or similarity(wa, wb) >= least - 1e-12):
                out.append((a, b))
    return out


def classes(docs, least: float = 0.8) -> set[frozenset]:
    """Connected components of all pairs that are alike."""
    parent = {d: d for d, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in alike(docs, least):
        parent[find(a)] = find(b)
    groups = collections.defaultdict(set)
    for d, _ in docs:
        groups[find(d)].add(d)
    return {frozenset(g) for g in groups.values()}


def check_classes(groups, docs, recall: float = 0.9, least: float = 0.8) -> float:
    """Every group lies within a class, and at least this share of all alike pairs are in one group; returns it."""
    number = {d: k for k, g in enumerate(groups) for d in g}
    whole = {d: k for k, g in enumerate(classes(docs, least)) for d in g}
    for g in groups:
        assert len({whole[d] for d in g}) == 1, g
    pairs = alike(docs, least)
    found = sum(number[a] == number[b] for a, b in pairs)
    assert found >= recall * len(pairs), (found, len(pairs))
    return found / max(1, len(pairs))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


PERSONAL = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(_digits(m[0])) <= 19 and luhn(_digits(m[0]))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(_digits(m[0])) <= 15),
)
SECRETS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
     lambda m: len(m[2]) >= 12),
    ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 16),
)


def base_spans(text: str | None, kinds) -> str:
    spans = [(m.start(), k, name, m.end()) for k, (name, pattern, good) in enumerate(kinds)
             for m in re.finditer(pattern, text or "", re.ASCII) if good(m)]
    return ",".join(f"{name}:{start}:{end}" for start, _, name, end in sorted(spans))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
