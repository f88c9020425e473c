"""Python regular expressions as Spark (Java) patterns.

A pattern is parsed by Python itself, and its syntax tree is written out in Java's terms: ``re.match``
begins at the start, ``$`` and ``\\Z`` differ in what they accept at the end, ``.`` in the line ends it
leaves out, ``\\s``, ``\\d``, ``\\w`` and ``\\b`` in the characters they know, classes in brackets and ``&&``,
groups and references in their spelling. What has no equal in Java (conditionals, ignoring case, locale
rules) is refused at once, so no pattern that is accepted fails in a job.

Two limits are Java's own: it knows the characters of an older Unicode version, and it recurses for each
turn of a repeated group (not of a repeated class), which very long values can exhaust.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable
from functools import lru_cache
from re import _constants as c
from re import _parser

from pyspark.sql import Column

# Every code point that Python's \s matches, for use inside a character class.
_SPACE = (
    r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
_WORD = r"\p{L}\p{N}_"
_ANY = r"[\x{0}-\x{10ffff}]"
_CLASSES = {c.CATEGORY_SPACE: _SPACE, c.CATEGORY_DIGIT: r"\p{Nd}", c.CATEGORY_WORD: _WORD}
_ASCII_CLASSES = {c.CATEGORY_SPACE: r" \x{9}-\x{d}", c.CATEGORY_DIGIT: "0-9", c.CATEGORY_WORD: "A-Za-z0-9_"}
_NEGATED = {
    c.CATEGORY_NOT_SPACE: c.CATEGORY_SPACE,
    c.CATEGORY_NOT_DIGIT: c.CATEGORY_DIGIT,
    c.CATEGORY_NOT_WORD: c.CATEGORY_WORD,
}
_REPEATS = {c.MAX_REPEAT: "", c.MIN_REPEAT: "?", c.POSSESSIVE_REPEAT: "+"}
_MOST_REPEATS = 2**31 - 1
_FLAGS = re.UNICODE | re.ASCII | re.DOTALL | re.MULTILINE | re.VERBOSE


@lru_cache(maxsize=1024)
def spark_pattern(python_pattern: str) -> str:
    """Pattern for ``rlike`` that accepts what ``re.match(python_pattern, text)`` accepts."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", FutureWarning)
        re.compile(python_pattern)
        tree = _parser.parse(python_pattern)
    return r"\A(?:" + _Writer(python_pattern).sequence(tree, tree.state.flags, last=True) + ")"


class _Writer:
    def __init__(self, pattern: str) -> None:
        self.pattern = pattern

    def refuse(self, what: object) -> ValueError:
        return ValueError(f"Spark has no equal of {str(what).lower()} in {self.pattern}")

    def sequence(self, items: Iterable, flags: int, last: bool = False) -> str:
        if flags & ~_FLAGS:
            raise self.refuse(re.RegexFlag(flags & ~_FLAGS))
        items = list(items)
        return "".join(self.one(op, av, flags, last and i == len(items) - 1) for i, (op, av) in enumerate(items))

    def one(self, op: object, av: object, flags: int, last: bool) -> str:
        if op is c.LITERAL:
            return _literal(av)
        if op is c.NOT_LITERAL:
            return f"[^{_member(av)}]"
        if op is c.ANY:
            return _ANY if flags & re.DOTALL else r"[^\n]"
        if op is c.IN:
            return self.members(av, flags)
        if op is c.AT:
            return self.place(av, flags, last)
        if op is c.BRANCH:
            return "(?:" + "|".join(self.sequence(part, flags) for part in av[1]) + ")"
        if op is c.SUBPATTERN:
            group, add, remove, part = av
            inner = self.sequence(part, (flags | add) & ~remove)
            return f"({inner})" if group is not None else f"(?:{inner})"
        if op is c.ATOMIC_GROUP:
            return f"(?>{self.sequence(av, flags)})"
        if op in _REPEATS:
            return self.repeat(op, av, flags)
        if op in (c.ASSERT, c.ASSERT_NOT):
            direction, part = av
            sign = ("<" if direction < 0 else "") + ("=" if op is c.ASSERT else "!")
            return f"(?{sign}{self.sequence(part, flags)})"
        if op is c.GROUPREF:
            return rf"(?:\{av})"
        if op is c.FAILURE:
            return "(?!)"
        raise self.refuse(op)

    def repeat(self, op: object, av: tuple, flags: int) -> str:
        least, most, part = av
        if least > _MOST_REPEATS or (most is not c.MAXREPEAT and most > _MOST_REPEATS):
            raise self.refuse("so many repeats")
        inner = self.sequence(part, flags)
        single = len(part) == 1 and part[0][0] in (c.LITERAL, c.NOT_LITERAL, c.ANY, c.IN)
        known = {(0, c.MAXREPEAT): "*", (1, c.MAXREPEAT): "+", (0, 1): "?"}
        count = known.get((least, most)) or (f"{{{least},}}" if most is c.MAXREPEAT else f"{{{least},{most}}}")
        return (inner if single else f"(?:{inner})") + count + _REPEATS[op]

    def place(self, at: object, flags: int, last: bool) -> str:
        if at in (c.AT_BEGINNING, c.AT_BEGINNING_STRING):
            lines = flags & re.MULTILINE and at is c.AT_BEGINNING
            return r"(?:\A|(?<=\n))" if lines else r"\A"
        if at is c.AT_END_STRING:
            return r"\z"
        if at is c.AT_END:
            if flags & re.MULTILINE:
                return r"(?=\n|\z)"
            return r"\n?\z" if last else r"(?=\n?\z)"
        word = f"[{_ASCII_CLASSES[c.CATEGORY_WORD] if flags & re.ASCII else _WORD}]"
        if at is c.AT_BOUNDARY:
            return f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"
        if at is c.AT_NON_BOUNDARY:  # not in an empty text
            return rf"(?:(?<={word})(?={word})|(?<!{word})(?!{word})(?!\A\z))"
        raise self.refuse(at)

    def members(self, items: list, flags: int) -> str:
        classes = _ASCII_CLASSES if flags & re.ASCII else _CLASSES
        plain, without = [], []
        negated = items[0][0] is c.NEGATE
        for op, av in items[negated:]:
            if op is c.LITERAL:
                plain.append(_member(av))
            elif op is c.RANGE:
                plain.append(f"{_member(av[0])}-{_member(av[1])}")
            elif op is c.CATEGORY and av in classes:
                plain.append(classes[av])
            elif op is c.CATEGORY and av in _NEGATED:
                without.append(classes[_NEGATED[av]])
            else:
                raise self.refuse(av)
        inside = "".join(plain)
        if not without:
            return f"[{'^' if negated else ''}{inside}]"
        if negated:  # none of the plain ones, and inside of all classes
            parts = [f"[{part}]" for part in without] + ([f"[^{inside}]"] if inside else [])
            return f"[{'&&'.join(parts)}]" if len(parts) > 1 else parts[0]
        parts = [f"[^{part}]" for part in without]
        return f"[{inside}{''.join(parts)}]" if inside or len(parts) > 1 else parts[0]


def _literal(code: int) -> str:
    char = chr(code)
    if char in "\\.[]{}()*+?^$|":
        return "\\" + char
    return _member(code)


def _member(code: int) -> str:
    """One character as a member of a class."""
    char = chr(code)
    if char.isascii() and (char.isalnum() or char in "$@_ ,.;:/=+*()?!%'\"<>{}|"):
        return char
    return rf"\x{{{code:x}}}"


def matches(column: Column, python_pattern: str) -> Column:
    """``re.match(python_pattern, column) is not None``; NULL stays NULL.

    The pattern is a literal, so it is compiled once per task rather than per row.
    """
    return column.rlike(spark_pattern(python_pattern))
