"""Texts by their shape: histories repeat few forms of statements with other names and numbers in them, and each form is worked out once.

A shape is a text with its words that hold a digit and its whole numbers taken out. What a function makes of one text of a
shape, it makes of all, with their own words in it: it may fold, cut, move and compare words, but must not ask what they are.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

#: Words in lower case that hold a digit, and whole numbers; names of types are no words of this kind, nor is anything beside a $ or a dot of a number.
PIECE = re.compile(r"(?<![\w$])((?!(?:int[248]|float[48])(?![\w$]))[a-z_]+[0-9][a-z0-9_]*(?![\w$])|(?<!\.)[0-9]+(?![\w$.]))")
#: What stands for the n-th of them while a shape is worked out.
MARK = re.compile(r"qz([0-9]+)qz|731([0-9]{4})731")
#: Longer words, and texts with quoted names, comments or escapes, are no shape's. Names are cut at 63 bytes, so a shape is tried with words of the full length, too.
LONGEST, WHOLE = 20, re.compile(r'["\\]|--|/\*')


def shaped(fn: Callable, most: int = 4096, length: int = 2000) -> Callable:
    """``fn`` of a text -> strings, numbers, None, and tuples, lists and dicts of them, worked out once for each shape, of which ``most`` are kept.

    Where a shape does not give what ``fn`` itself gives of its first text and of one with long words, ``fn`` is asked for every text of it.
    """
    known: dict = {}

    @functools.wraps(fn)
    def of(text: str):
        if len(text) > length or WHOLE.search(text):
            return fn(text)
        pieces = PIECE.split(text)
        words = pieces[1::2]
        same = None
        if len(set(words)) < len(words):
            first: dict = {}
            same = tuple([first.setdefault(w, k) for k, w in enumerate(words)])
        key = (*pieces[::2], same, *map(str.isdigit, words))
        build = known.get(key)
        if build is None:
            if any(len(w) > LONGEST for w in words):
                return fn(text)
            out = fn(text)
            if len(known) < most:
                known[key] = _builder(fn, pieces, same, words, out)
            return out
        if build is fn:
            return fn(text)
        for w in words:
            if len(w) > LONGEST:
                return fn(text)
        return build(words)

    return of


def _builder(fn: Callable, pieces: list[str], same: tuple | None, words: list[str], out: object) -> Callable:
    """What makes ``fn``'s result of a shape's words; ``fn`` itself where the shape does not tell."""
    at = same or range(len(words))

    def filled(word: Callable[[int], str], number: Callable[[int], str]) -> tuple[list[str], str]:
        new = [number(k) if w.isdigit() else word(k) for k, w in zip(at, words, strict=True)]
        return new, "".join(x for pair in zip(pieces[::2], [*new, ""], strict=True) for x in pair)

    _, marked = filled(lambda k: f"qz{k}qz", lambda k: f"731{k:04}731")
    long_words, long = filled(lambda k: f"w{k}".ljust(LONGEST, "w"), lambda k: f"{8000 + k}".ljust(LONGEST, "9"))
    try:
        build = eval(f"lambda w: {_source(fn(marked))}", {})  # noqa: S307: made of literals and of places in w alone
        return build if build(words) == out and build(long_words) == fn(long) else fn
    except (ValueError, IndexError, TypeError):
        return fn


def _source(value: object) -> str:
    """The Python text of a value, with w[n] in place of the marks."""
    if isinstance(value, str):
        places = [f"w[{int(a or b)}]" for a, b in MARK.findall(value)]
        if not places:
            return repr(value)
        fixed = MARK.sub("\0", value.replace("%", "%%")).replace("\0", "%s")
        return places[0] if fixed == "%s" else f"({fixed!r} % ({', '.join(places)},))"
    if isinstance(value, tuple):
        return f"({''.join(_source(x) + ', ' for x in value)})"
    if isinstance(value, list):
        return f"[{', '.join(map(_source, value))}]"
    if isinstance(value, dict):
        return f"{{{', '.join(f'{_source(k)}: {_source(v)}' for k, v in value.items())}}}"
    if value is None or isinstance(value, (bool, int)):
        return repr(value)
    raise ValueError(f"no value of a shape: {type(value)}")
