"""Compatibility forms of Unicode as far as words of ASCII letters and digits go, as column expressions.

Spark has no function for normal forms. What they do to such words is little: some characters stand for letters, digits, apostrophes or dashes (full
width, ligatures, fractions, circled numbers), and a letter that a mark follows becomes one character with it, which is no ASCII letter any
more. Both follow from the character database by rule, once a process.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_MATTERS = re.compile("[A-Za-z0-9'’‘‐-—-]")
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: What a letter that composes with a mark becomes: some character of no word.
GONE = "\ufffd"


def _ranges(points: set[int], joined: int = 1) -> str:
    """A character class of code points; gaps of under so many are closed."""
    out: list[list[int]] = []
    for p in sorted(points):
        if out and p - out[-1][1] <= joined:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out) + "]"


@cache
def tables() -> tuple[dict[str, str], dict[str, str]]:
    """Characters that stand for one character that matters to words (or for a mark), and those that stand for several."""
    one, many = {}, {}
    for point in range(0x80, 0x110000):
        if 0xD800 <= point < 0xE000:
            continue
        form = unicodedata.normalize("NFKC", chr(point))
        if form != chr(point) and (_MATTERS.search(form) or any(map(unicodedata.combining, form))):
            (one if len(form) == 1 else many)[chr(point)] = form
    return one, many


@cache
def compositions() -> list[tuple[int, dict[str, str]]]:
    """(combining class, mark -> ASCII letters that it composes with), classes ascending, as marks are put in order."""
    found: dict[int, dict[str, str]] = {}
    for point in range(0x300, 0x370):
        letters = "".join(c for c in _LETTERS if len(unicodedata.normalize("NFC", c + chr(point))) == 1)
        if letters and unicodedata.normalize("NFC", chr(point)) == chr(point):
            found.setdefault(unicodedata.combining(chr(point)), {})[chr(point)] = letters
    return sorted(found.items())


@cache
def patterns() -> tuple[str, str, str, list[tuple[str, str]]]:
    """Classes of what may need a change and of what stands for several, letters that marks follow, and (pattern, substitute) of compositions."""
    one, many = tables()
    marks = {p for p in range(0x80, 0x110000) if not 0xD800 <= p < 0xE000 and unicodedata.combining(chr(p))}
    steps = [("\u0130", "I\u0307")]
    for kind, letters in compositions():
        between = _ranges({p for p in marks if unicodedata.combining(chr(p)) != kind})
        if "\u0307" in letters:
            steps.append((f"I(?={between}*\\x{{307}})", "İ"))  # the one whose lower case begins with an ASCII letter
        steps.append(("|".join(f"[{ls}](?={between}*\\x{{{ord(m):x}}})" for m, ls in letters.items()), GONE))
    changed = {ord(c) for c in (*one, *many)} | {ord(m) for _, letters in compositions() for m in letters}
    return _ranges(changed, 16), _ranges({ord(c) for c in many}), f"[A-Za-zİ]{_ranges(marks, 2)}", steps


def held(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that the expression holds once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def compatible(text: Column) -> Column:
    """The text with the compatibility forms of what matters to words; other characters may stay as they are, and composed ones are only told apart from letters."""
    one, many = tables()
    maybe, several, marked, steps = patterns()
    table = F.from_json(F.lit(json.dumps(many)), "map<string,string>")

    def spread(t: Column) -> Column:
        return F.when(t.rlike(several), F.array_join(F.transform(F.split(t, ""), lambda c: F.coalesce(F.element_at(table, c), c)), "")).otherwise(t)

    def composed(t: Column) -> Column:
        out = t
        for pattern, to in steps:
            out = F.regexp_replace(out, pattern, to)
        return F.when(t.rlike(marked), out).otherwise(t)

    changed = held(held(F.translate(text, "".join(one), "".join(one.values())), spread), composed)
    ascii_alone = F.octet_length(text) == F.length(text)
    return F.when(ascii_alone, text).when(text.rlike(f"(?=[^\\x00-\\x7F]){maybe}"), changed).otherwise(text)

