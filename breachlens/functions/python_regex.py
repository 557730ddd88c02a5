"""Searches written for Python's ``re`` as patterns of the JVM's regex engine.

Python's own parser reads the query, once, on the driver; every node is written out so that the JVM means the same:
Unicode digits, word characters and spaces, case folding beyond ASCII, ``$`` before a last line break, ``\\Z`` as the very
end, named groups by number, ``.`` as all but a line feed. What the JVM has no counterpart for is an error, as is what
Python itself refuses.
"""

from __future__ import annotations

import _sre
import functools
import re
from re import _constants as C
from re import _parser as parser
from re._casefix import _EXTRA_CASES

UNSUPPORTED = "This search can't be run: {what}."

_ANY = r"[\s\S]"
_DIGIT, _ASCII_DIGIT = r"\p{Nd}", "0-9"
_WORD, _ASCII_WORD = r"\p{L}\p{N}_", "A-Za-z0-9_"
_SPACE, _ASCII_SPACE = r"\t-\r\x1C-\x20\x85\p{Z}", r"\t-\r\x20"
_CLASSES = {C.CATEGORY_DIGIT: (_DIGIT, _ASCII_DIGIT), C.CATEGORY_WORD: (_WORD, _ASCII_WORD), C.CATEGORY_SPACE: (_SPACE, _ASCII_SPACE)}
_NEGATED = {C.CATEGORY_NOT_DIGIT: C.CATEGORY_DIGIT, C.CATEGORY_NOT_WORD: C.CATEGORY_WORD, C.CATEGORY_NOT_SPACE: C.CATEGORY_SPACE}


def _char(code: int) -> str:
    return f"\\x{{{code:X}}}"


@functools.cache
def _lowered() -> dict[int, list[int]]:
    """Characters by their simple lower-case form, where one has others."""
    groups: dict[int, list[int]] = {}
    for code in range(0x110000):
        low = _sre.unicode_tolower(code)
        if low != code:
            groups.setdefault(low, []).append(code)
    return groups


def _variants(code: int, flags: int) -> str:
    """The characters that match one regardless of case; the JVM misses those whose capital is another script's letter."""
    if not flags & re.IGNORECASE or flags & re.ASCII or code < 0x80:
        return _char(code)
    low = _sre.unicode_tolower(code)
    same = {code, low, *_lowered().get(low, ())}
    return "".join(map(_char, sorted(same | set(_EXTRA_CASES.get(low, ())))))


def _category(kind, flags: int) -> str:
    """A character class for one of Python's categories; those never fold case."""
    negated, kind = ("^", _NEGATED[kind]) if kind in _NEGATED else ("", kind)
    if flags & re.ASCII:
        return f"(?-iu:[{negated}{_CLASSES[kind][1]}])"
    return f"[{negated}{_CLASSES[kind][0]}]"


def _set(items, flags: int) -> str:
    negated, chars, classes = False, [], []
    for op, value in items:
        if op is C.NEGATE:
            negated = True
        elif op is C.LITERAL:
            chars.append(_variants(value, flags))
        elif op is C.RANGE:
            chars.append(f"{_char(value[0])}-{_char(value[1])}")
        elif op is C.CATEGORY:
            classes.append(_category(value, flags))
        else:
            raise ValueError(UNSUPPORTED.format(what=op))
    one = "|".join([*([f"[{''.join(chars)}]"] if chars else []), *classes])
    return f"(?:(?!{one}){_ANY})" if negated else f"(?:{one})"


def _place(kind, flags: int) -> str:
    word = f"[{(_WORD, _ASCII_WORD)[bool(flags & re.ASCII)]}]"
    lines = bool(flags & re.MULTILINE)
    return {
        C.AT_BEGINNING: r"(?:\A|(?<=\n))" if lines else r"\A",
        C.AT_BEGINNING_STRING: r"\A",
        C.AT_END: r"(?=\n|\z)" if lines else r"(?=\n?\z)",
        C.AT_END_STRING: r"\z",
        C.AT_BOUNDARY: f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))",
        C.AT_NON_BOUNDARY: f"(?:(?!\\A\\z)(?:(?<={word})(?={word})|(?<!{word})(?!{word})))",
    }[kind]


def _repeat(low: int, high: int, inner: str, way: str) -> str:
    most = "" if high is C.MAXREPEAT else str(high)
    return f"(?:{inner}){{{low},{most}}}{way}"


def _node(op, value, flags: int) -> str:
    if op is C.LITERAL:
        return f"[{_variants(value, flags)}]" if value >= 0x80 else _char(value)
    if op is C.NOT_LITERAL:
        return f"(?:(?![{_variants(value, flags)}]){_ANY})"
    if op is C.ANY:
        return _ANY if flags & re.DOTALL else r"[^\n]"
    if op is C.IN:
        return _set(value, flags)
    if op is C.AT:
        return _place(value, flags)
    if op is C.BRANCH:
        return f"(?:{'|'.join(_all(p, flags) for p in value[1])})"
    if op is C.SUBPATTERN:
        group, on, off, inner = value
        own = (flags | on) & ~off
        written = _all(inner, own)
        for flag, letter, set_by in ((re.IGNORECASE, "i", True), (re.ASCII, "u", False)):
            if (own ^ flags) & flag:
                written = f"(?{'' if bool(own & flag) == set_by else '-'}{letter}:{written})"
        return f"(?:{written})" if group is None else f"({written})"
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        way = {C.MAX_REPEAT: "", C.MIN_REPEAT: "?", C.POSSESSIVE_REPEAT: "+"}[op]
        return _repeat(value[0], value[1], _all(value[2], flags), way)
    if op is C.ATOMIC_GROUP:
        return f"(?>{_all(value, flags)})"
    if op is C.GROUPREF:
        return f"\\{value}(?:)"
    if op in (C.ASSERT, C.ASSERT_NOT):
        sign = ("" if value[0] > 0 else "<") + ("=" if op is C.ASSERT else "!")
        return f"(?{sign}{_all(value[1], flags)})"
    raise ValueError(UNSUPPORTED.format(what=f"{op} has no counterpart"))


def _all(nodes, flags: int) -> str:
    return "".join(_node(op, value, flags) for op, value in nodes)


def java_pattern(query: str, ignore_case: bool = True) -> str:
    """The JVM's pattern for a query that Python would search with ``re.search``."""
    try:
        flags = re.IGNORECASE if ignore_case else re.NOFLAG
        re.compile(query, flags)         # refuses more than the parser alone does
        tree = parser.parse(query, flags)
    except (re.error, OverflowError, ValueError) as e:
        raise ValueError(UNSUPPORTED.format(what=e)) from e
    flags = tree.state.flags
    on = ("i" if flags & re.IGNORECASE else "") + ("" if flags & re.ASCII else "u")
    return (f"(?{on})" if on else "") + _all(tree, flags)


__all__ = ["java_pattern", "UNSUPPORTED"]
