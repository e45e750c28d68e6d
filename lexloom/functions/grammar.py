"""Split grammars: how a text is cut to pieces before merging.

Each grammar is one regular expression whose matches tile the text. It is kept in
three spellings: Java's, for Catalyst's regexp_extract_all; that of the `regex`
module, for functions that split and merge in one pass; and one of Python's `re`
over a Latin alphabet, several times as fast, for texts that hold no other letter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, functions as F

# The code points of Unicode white space, without brackets.
SPACES = r"\u0009-\u000D\u0020\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
# Letters and digits of the Latin alphabet of the fast spelling, and
# the other characters it may meet, whose classes no Unicode version changes.
LATIN = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
LATIN_UPPER, LATIN_LOWER, LATIN_BOTH = "A-Z\xc0-\xd6\xd8-\xde", "a-z\xb5\xdf-\xf6\xf8-\xff", "\xaa\xba"
LATIN_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
NOT_LATIN = re.compile(r"[^\x00-\x1b\x20-\xff]")

# The grammars, with L, N, S, U, W for the classes of letters, numbers,
# white space, letters that may be upper case and letters that may be lower case.
_GRAMMARS = {
    "cl100k": r"'(?i:[sdmt]|ll|ve|re)|[^\r\n{L}{N}]?+[{L}]++|[{N}]{{1,3}}+| ?[^{S}{L}{N}]++[\r\n]*+|[{S}]++\z|[{S}]*[\r\n]|[{S}]+(?![^{S}])|[{S}]",
    "o200k": r"[^\r\n{L}{N}]?[{U}]*[{W}]+(?i:'s|'t|'re|'ve|'m|'ll|'d)?|[^\r\n{L}{N}]?[{U}]+[{W}]*(?i:'s|'t|'re|'ve|'m|'ll|'d)?|[{N}]{{1,3}}| ?[^{S}{L}{N}]+[\r\n/]*|[{S}]*[\r\n]+|[{S}]+(?![^{S}])|[{S}]+",
    "qwen": r"'(?i:[sdmt]|ll|ve|re)|[^\r\n{L}{N}]?+[{L}]++|[{N}]| ?[^{S}{L}{N}]++[\r\n]*+|[{S}]*[\r\n]+|[{S}]+(?![^{S}])|[{S}]+",
    "r50k": r"'(?:[sdmt]|ll|ve|re)| ?[{L}]++| ?[{N}]++| ?[^{S}{L}{N}]++|[{S}]++\z|[{S}]+(?![^{S}])|[{S}]",
}


@dataclass(frozen=True)
class Grammar:
    """A named pattern; marks: whether combining marks count as letters."""

    name: str
    pattern: str
    marks: bool = False

    def _fill(self, letters: str, numbers: str, spaces: str, upper: str, lower: str) -> str:
        return self.pattern.format(L=letters, N=numbers, S=spaces, U=upper, W=lower)

    @cached_property
    def java(self) -> str:
        letters = r"\p{L}\p{M}" if self.marks else r"\p{L}"
        return self._fill(letters, r"\p{N}", SPACES, r"\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}", r"\p{Ll}\p{Lm}\p{Lo}\p{M}")

    @cached_property
    def compiled(self):
        import regex

        # The module folds case over all of Unicode; contractions fold ASCII only.
        return regex.compile(_python(self.java))

    @cached_property
    def latin(self):
        upper, lower = LATIN_UPPER + LATIN_BOTH, LATIN_LOWER + LATIN_BOTH
        pattern = self._fill(LATIN, LATIN_NUMBERS, r"\x09-\x0d\x20\x85\xa0", upper, lower)
        return re.compile(_python(pattern))

    def split(self, text: str) -> list[str]:
        """Pieces of one text; they tile it."""
        # No spelling has a capturing group, so findall gives whole matches.
        return (self.compiled if NOT_LATIN.search(text) else self.latin).findall(text)

    def pieces(self, text: Column) -> Column:
        """Pieces as a Catalyst array; a null text gives null."""
        return F.regexp_extract_all(text, F.lit(self.java), F.lit(0))


def _python(pattern: str) -> str:
    """Java's spelling as Python's: the end anchor, and ASCII-only case folding."""
    for plain in ("[sdmt]|ll|ve|re", "'s|'t|'re|'ve|'m|'ll|'d"):
        pattern = pattern.replace(f"(?i:{plain})", f"(?:{ascii_folded(plain)})")
    return pattern.replace(r"\z", r"\Z")


def ascii_folded(pattern: str) -> str:
    """A pattern of lower-case ASCII letters that matches either case."""
    out, inside = [], False
    for c in pattern:
        inside = (inside or c == "[") and c != "]"
        out.append(c + c.upper() if c.isalpha() and inside else f"[{c}{c.upper()}]" if c.isalpha() else c)
    return "".join(out)


@dataclass(frozen=True)
class WholeText:
    """No split at all: the text is one piece."""

    name: str = "whole"

    def split(self, text: str) -> list[str]:
        return [text] if text else []

    def pieces(self, text: Column) -> Column:
        return F.when(text == "", F.array().cast("array<string>")).otherwise(F.array(text))


GRAMMARS = {name: Grammar(name, pattern) for name, pattern in _GRAMMARS.items()}
GRAMMARS["qwen_marks"] = Grammar("qwen_marks", _GRAMMARS["qwen"], marks=True)
GRAMMARS["whole"] = WholeText()


def grammar(name: str) -> Grammar | WholeText:
    if name not in GRAMMARS:
        raise KeyError(f"unknown grammar {name!r}; available: {', '.join(GRAMMARS)}")
    return GRAMMARS[name]


def pieces(text: Column, name: str) -> Column:
    return grammar(name).pieces(text)


def fold_marker(text: Column) -> Column:
    """U+2581, which stands for a space in some vocabularies, as a space."""
    return F.translate(text, "▁", " ")
