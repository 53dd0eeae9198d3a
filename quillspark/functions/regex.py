"""Python regular expressions as Java ones, for Catalyst's regex functions.

The standard library's parser gives the pattern's tree; each node is written out in Java syntax with
Python's meaning: Unicode classes, flags by group, anchors that know "\\n" alone as a line's end.
"""

from __future__ import annotations

import re
from re import _constants as c  # type: ignore[attr-defined]
from re import _parser as parser  # type: ignore[attr-defined]

#: Bodies of Java character classes with the members of Python's \\w, \\s, \\d and [^\\W\\d_].
WORD = r"\p{L}\p{N}_"
SPACE = r"\s\x1c-\x1f\x{85}\p{Z}"
DIGIT = r"\p{Nd}"
LETTER = r"\p{L}\p{Nl}\p{No}"
#: White space but for "\\n".
BLANK = r"\t\x0b\f\r\x1c-\x1f\x{85}\p{Zs}\x{2028}\x{2029}"

_CLASS = {c.CATEGORY_WORD: WORD, c.CATEGORY_SPACE: SPACE, c.CATEGORY_DIGIT: DIGIT}
_NOT = {c.CATEGORY_NOT_WORD: WORD, c.CATEGORY_NOT_SPACE: SPACE, c.CATEGORY_NOT_DIGIT: DIGIT}
_BOUNDARY = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
_NO_BOUNDARY = f"(?:(?<=[{WORD}])(?=[{WORD}])|(?<![{WORD}])(?![{WORD}]))"


class Untranslatable(ValueError):
    """A pattern that Java has no equal of."""


def quote(text: str) -> str:
    """A Java pattern that matches this text."""
    return "".join(_char(ord(x)) for x in text)


def _char(code: int) -> str:
    char = chr(code)
    return char if char.isascii() and char.isalnum() else f"\\x{{{code:x}}}"


def _item(kind, value) -> str:
    """A member of a character class."""
    if kind is c.LITERAL:
        return _char(value)
    if kind is c.RANGE:
        return f"{_char(value[0])}-{_char(value[1])}"
    if kind is c.CATEGORY:
        return _CLASS[value] if value in _CLASS else f"[^{_NOT[value]}]"
    raise Untranslatable(f"class member {kind}")


def _at(where, flags: int) -> str:
    many = flags & re.MULTILINE
    if where is c.AT_BEGINNING:
        return r"(?:(?<=\n)|(?<![\s\S]))" if many else r"(?<![\s\S])"
    if where is c.AT_BEGINNING_STRING:
        return r"(?<![\s\S])"
    if where is c.AT_END:
        return r"(?=\n|(?![\s\S]))" if many else r"(?=\n?(?![\s\S]))"
    if where is c.AT_END_STRING:
        return r"(?![\s\S])"
    if where is c.AT_BOUNDARY:
        return _BOUNDARY
    if where is c.AT_NON_BOUNDARY:
        return _NO_BOUNDARY
    raise Untranslatable(f"position {where}")


def _repeat(value, flags: int, suffix: str) -> str:
    low, high, body = value
    top = "" if high is c.MAXREPEAT else str(high)
    count = {(0, ""): "*", (1, ""): "+", (0, "1"): "?"}.get((low, top)) or (f"{{{low}}}" if top == str(low) else f"{{{low},{top}}}")
    return f"(?:{_sequence(body, flags)}){count}{suffix}"


def _node(kind, value, flags: int) -> str:
    if kind is c.LITERAL:
        return _char(value)
    if kind is c.NOT_LITERAL:
        return f"[^{_char(value)}]"
    if kind is c.ANY:
        return r"[\s\S]" if flags & re.DOTALL else r"[^\n]"
    if kind is c.IN:
        negated = value[0][0] is c.NEGATE
        return f"[{'^' if negated else ''}{''.join(_item(*x) for x in value[negated:])}]"
    if kind is c.BRANCH:
        return "(?:" + "|".join(_sequence(x, flags) for x in value[1]) + ")"
    if kind is c.SUBPATTERN:
        group, add, remove, body = value
        inner = (flags | add) & ~remove
        text = _sequence(body, inner)
        if (inner ^ flags) & re.IGNORECASE:
            text = f"(?{'' if inner & re.IGNORECASE else '-'}iu:{text})"
        return f"({text})" if group is not None else f"(?:{text})"
    if kind in (c.ASSERT, c.ASSERT_NOT):
        way, body = value
        return f"(?{'<' if way < 0 else ''}{'=' if kind is c.ASSERT else '!'}{_sequence(body, flags)})"
    if kind is c.AT:
        return _at(value, flags)
    if kind is c.GROUPREF:
        return f"(?:\\{value})"
    if kind is c.ATOMIC_GROUP:
        return f"(?>{_sequence(value, flags)})"
    suffix = {c.MAX_REPEAT: "", c.MIN_REPEAT: "?", c.POSSESSIVE_REPEAT: "+"}.get(kind)
    if suffix is None:
        raise Untranslatable(f"construct {kind}")
    return _repeat(value, flags, suffix)


def _word_edge(kind, value, last: bool) -> bool:
    """Whether what this node matches surely begins (or ends) with a word character."""
    if kind is c.LITERAL:
        return chr(value).isalnum() or chr(value) == "_"
    if kind is c.IN:
        return all((k is c.LITERAL and (chr(v).isalnum() or chr(v) == "_")) or (k is c.RANGE and v in _WORD_RANGES) or (k is c.CATEGORY and v in (c.CATEGORY_WORD, c.CATEGORY_DIGIT)) for k, v in value)
    if kind is c.BRANCH:
        return all(x and _word_edge(*x[-1 if last else 0], last) for x in value[1])
    if kind is c.SUBPATTERN:
        return bool(value[3]) and _word_edge(*value[3][-1 if last else 0], last)
    if kind in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT):
        return value[0] > 0 and bool(value[2]) and _word_edge(*value[2][-1 if last else 0], last)
    return False


_WORD_RANGES = ((97, 122), (65, 90), (48, 57))


def _sequence(body, flags: int) -> str:
    out, nodes = [], list(body)
    for n, (kind, value) in enumerate(nodes):
        if kind is c.AT and value is c.AT_BOUNDARY:
            # One side is known to be a word character, so one look at the other side will do.
            if n + 1 < len(nodes) and _word_edge(*nodes[n + 1], False):
                out.append(f"(?<![{WORD}])")
                continue
            if n and _word_edge(*nodes[n - 1], True):
                out.append(f"(?![{WORD}])")
                continue
        out.append(_node(kind, value, flags))
    return "".join(out)


def to_java(pattern: str) -> str:
    """The Java pattern; raises re.error for a pattern that Python rejects too, Untranslatable for one that Java cannot express or that can match nothing at all."""
    compiled = re.compile(pattern)
    if compiled.match("") or parser.parse(pattern).getwidth()[0] == 0:
        raise Untranslatable("a detector must not match the empty string")
    text = _sequence(parser.parse(pattern), compiled.flags)
    return f"(?iu){text}" if compiled.flags & re.IGNORECASE else text


def _anchors(body, flags: int) -> list[frozenset[str]]:
    out, run = [], ""
    for kind, value in [*body, (None, None)]:
        if kind is c.LITERAL and (value < 128 or not (flags & re.IGNORECASE or chr(value).isalpha())):
            run += chr(value).lower()
            continue
        if run:
            out.append(frozenset({run}))
            run = ""
        if kind is c.SUBPATTERN:
            out += _anchors(value[3], (flags | value[1]) & ~value[2])
        elif kind is c.ATOMIC_GROUP:
            out += _anchors(value, flags)
        elif kind in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT) and value[0] > 0:
            out += _anchors(value[2], flags)
        elif kind is c.BRANCH:
            each = [max(_anchors(x, flags), key=_rarity, default=frozenset()) for x in value[1]]
            if all(each):
                out.append(frozenset().union(*each))
    return out


def _rarity(texts: frozenset[str]) -> tuple[int, int]:
    return min(map(len, texts)), -len(texts)


#: What is no ASCII character but the same as one for a pattern that ignores case.
LIKE_ASCII = "\u0130\u0131\u017f\u212a"


def anchors(pattern: str, most: int = 3) -> list[list[str]]:
    """Sets of texts, the rarest looking first: each match of a Python pattern holds one text of every set, in lower case. Where a text holds characters of LIKE_ASCII, a match may hold these instead."""
    found = sorted(set(_anchors(parser.parse(pattern), re.compile(pattern).flags)), key=lambda x: (_rarity(x), sorted(x)), reverse=True)
    return [sorted(x) for x in found[:most]]
