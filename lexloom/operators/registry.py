"""Encodings: a vocabulary, a split grammar and special tokens under one name.

Vocabularies are inputs. The names below fix how a vocabulary of that name is used;
its files are given when it is loaded. An encoding is loaded once in a process
and travels to executors as a broadcast (at most MAX_TOKENS tokens).
"""

from __future__ import annotations

import hashlib
import os
import pickle
import re
import unicodedata
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from itertools import accumulate, chain

from lexloom.functions.grammar import grammar
from lexloom.operators import kernel
from lexloom.sources import formats

MEMO_PIECES = 600_000
MEMO_CHARS = 48

# The encodings known by name, with grammar, NFC and space-marker folding.
KNOWN = {
    "cl100k_base": ("cl100k", False, False),
    "o200k_base": ("o200k", False, False),
    "o200k_harmony": ("o200k", False, False),
    "qwen3.5": ("qwen", True, False),
    "qwen-marks": ("qwen_marks", True, False),
    "embeddinggemma-2": ("whole", False, True),
}
EOT = "<|endoftext|>"
#: Name in the estimate's place where an encoding is asked for; it has no ids.
ESTIMATE = "estimate"
_CACHE: dict[tuple[str, str, str | None], Encoding] = {}
# One character of any bytes: what a lead byte promises, or a byte by itself.
_LENIENT = re.compile(rb"[\xc0-\xdf].|[\xe0-\xef]..|[\xf0-\xf7]...|.", re.DOTALL)
_UNSAFE: re.Pattern | None = None


@dataclass
class Truncation:
    """A kept prefix: its text and bytes, tokens before and after."""

    text: str
    bytes: int
    total_tokens: int
    kept_tokens: int


@dataclass
class Encoding:
    """Everything needed to encode and decode; plain data, so it pickles."""

    name: str
    vocabulary: formats.Vocabulary
    grammar_name: str
    nfc: bool = False
    fold: bool = False
    memo: dict = field(default_factory=dict, repr=False, compare=False)
    sizes: dict = field(default_factory=dict, repr=False, compare=False)
    splits_of: dict = field(default_factory=dict, repr=False, compare=False)

    def __post_init__(self) -> None:
        v = self.vocabulary
        self.tokens = v.tokens
        self.specials = v.specials
        self.grammar = grammar(self.grammar_name)
        self.by_character = bool(v.splits) and formats.START_SYMBOL in v.splits.values() and self.fold
        splits = v.splits or {}
        # Of two ids with the same bytes the one that merging can make stands.
        self.ids = {}
        for i, t in sorted(v.tokens.items(), reverse=True):
            if t not in self.ids or splits.get(i, formats.NO_MERGE) != formats.NO_MERGE:
                self.ids[t] = i
        self.ranks = None if v.splits else {t: i for i, t in v.tokens.items()}
        self.pairs, self.singles = {}, {}
        if v.splits:
            self._list_pairs()

    def _list_pairs(self) -> None:
        v = self.vocabulary
        # Without a merge list the single bytes are what merging starts from.
        marked = formats.START_SYMBOL in v.splits.values()
        start = {t: i for i, t in v.tokens.items() if (v.splits.get(i) == formats.START_SYMBOL if marked else len(t) == 1)}
        self.singles = start
        made = v.merges
        if made is None:
            made = [
                (i, left) for i, left in sorted(v.splits.items()) if left not in (formats.NO_MERGE, formats.START_SYMBOL)
            ]
        makes = {i for i, _ in made}
        producible = start | {v.tokens[i]: i for i in makes}
        for order, (i, left) in enumerate(made):
            token = v.tokens[i]
            a, b = producible.get(token[:left]), producible.get(token[left:])
            if a is not None and b is not None:
                self.pairs.setdefault((a, b), (order, i))

    def __reduce__(self):
        return Encoding, (self.name, self.vocabulary, self.grammar_name, self.nfc, self.fold)

    @cached_property
    def fingerprint(self) -> str:
        """Of the content, so that equal encodings share a worker's memo and others don't."""
        plain = (self.grammar_name, self.nfc, self.fold, sorted(self.tokens.items()), self.vocabulary.splits)
        return hashlib.sha256(pickle.dumps((plain, self.vocabulary.merges, self.specials))).hexdigest()

    # encoding

    @cached_property
    def _rank_merger(self):
        return kernel.rank_merger(self.ranks)

    def merge(self, piece: bytes) -> list[int]:
        if self.ranks is not None:
            return self._rank_merger(piece)
        return kernel.merge_pairs(kernel.start_symbols(piece, self.singles, self.by_character), self.pairs)

    def _learn(self, pieces: list[str]) -> tuple[dict, dict]:
        """Ids and numbers of ids for these pieces at least; short ones are kept."""
        if len(self.memo) >= MEMO_PIECES:
            self.memo.clear()
            self.sizes.clear()
        new = {p: tuple(self.merge(p.encode("utf-8", "replace"))) for p in set(pieces).difference(self.memo)}
        self.memo.update((p, ids) for p, ids in new.items() if len(p) <= MEMO_CHARS)
        self.sizes.update((p, len(ids)) for p, ids in new.items() if len(p) <= MEMO_CHARS)
        if all(len(p) <= MEMO_CHARS for p in new):
            return self.memo, self.sizes
        ids = {p: new.get(p) or self.memo[p] for p in pieces}
        return ids, {p: len(i) for p, i in ids.items()}

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece, without any split."""
        piece = repair(piece)
        return list(self._learn([piece])[0][piece])

    def prepare(self, text: str) -> str:
        """NFC and marker folding, as this encoding asks; lone surrogates become U+FFFD."""
        text = repair(text)
        if self.nfc and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.replace("▁", " ") if self.fold else text

    def encode_ordinary(self, text: str) -> list[int]:
        """Ids with special strings as plain text. No NFC: see prepare()."""
        text = repair(text)
        if self.fold:
            text = text.replace("▁", " ")
        pieces = self.grammar.split(text)
        try:
            return list(chain.from_iterable(map(self.memo.__getitem__, pieces)))
        except KeyError:
            return list(chain.from_iterable(map(self._learn(pieces)[0].__getitem__, pieces)))

    def count(self, text: str) -> int:
        """Number of ids; none is listed."""
        text = repair(text)
        if self.fold:
            text = text.replace("▁", " ")
        pieces = self.grammar.split(text)
        try:
            return sum(map(self.sizes.__getitem__, pieces))
        except KeyError:
            return sum(map(self._learn(pieces)[1].__getitem__, pieces))

    def encode_bytes(self, data: bytes) -> list[int]:
        """Ids of any bytes, without loss: a lead byte takes the bytes it promises, valid or
        not, and any other byte above 0x7F is the character of its number."""
        try:
            return self.encode_ordinary(data.decode())
        except UnicodeDecodeError:
            pass
        units = _LENIENT.findall(data)
        ends = [0, *accumulate(map(len, units))]
        out, at = [], 0
        for piece in self.grammar.split("".join(map(_lenient, units))):
            out += self.merge(data[ends[at] : ends[at + len(piece)]])
            at += len(piece)
        return out

    def _special_split(self, allowed: frozenset[str]) -> tuple[dict[str, int], re.Pattern]:
        """Ids of the allowed specials, and a pattern that cuts texts at them."""
        found = self.splits_of.get(allowed)
        if found is None:
            listed = [s for s, _ in self.specials if s in allowed]
            pattern = re.compile("(" + "|".join(map(re.escape, listed)) + ")")
            found = self.splits_of[allowed] = ({s: i for s, i in reversed(self.specials) if s in allowed}, pattern)
        return found

    def encode_allowed(self, text: str, allowed: set[str]) -> list[int]:
        """Allowed specials become their ids: leftmost first, of equal starts the first listed."""
        if not allowed or not self.specials:
            return self.encode_ordinary(text)
        ids, pattern = self._special_split(frozenset(allowed))
        if not ids:
            return self.encode_ordinary(text)
        out: list[int] = []
        for k, part in enumerate(pattern.split(repair(text))):
            if k % 2:
                out.append(ids[part])
            elif part:
                out += self.encode_ordinary(part)
        return out

    @cached_property
    def _every_special(self) -> frozenset[str]:
        return frozenset(s for s, _ in self.specials)

    def encode_with_special(self, text: str) -> list[int]:
        return self.encode_allowed(text, self._every_special)

    def encode(self, text: str, allowed_special="", disallowed_special="all") -> list[int]:
        """Ids; a disallowed special string in the text is an error."""
        allowed, refused = self.policy(allowed_special, disallowed_special)
        for special in sorted(refused):
            if special in text:
                raise ValueError(f"text holds the special token {special!r}, which isn't allowed")
        return self.encode_allowed(text, allowed)

    def policy(self, allowed_special, disallowed_special) -> tuple[set[str], set[str]]:
        """The allowed and the refused special strings; `all` or a collection each."""
        every = {s for s, _ in self.specials}

        def named(value) -> set[str] | None:
            if isinstance(value, str):
                if value not in ("all", ""):
                    raise ValueError("give 'all' or a collection of special tokens")
                return None if value == "all" else set()
            return set(value)

        allowed = named(allowed_special)
        allowed = every if allowed is None else allowed
        refused = named(disallowed_special)
        return allowed, every - allowed if refused is None else refused

    @cached_property
    def _widths(self) -> dict[str, dict[int, int]]:
        """Bytes, and characters that begin, in each token."""
        leads = {i: sum((b & 0xC0) != 0x80 for b in t) for i, t in self.tokens.items()}
        return {"byte": {i: len(t) for i, t in self.tokens.items()}, "char": leads}

    def bounds(self, text: str, unit: str = "byte") -> list[int]:
        """Where tokens meet, from 0 to the text's end, in bytes or code points."""
        if unit not in ("byte", "char"):
            raise ValueError("unit is 'byte' or 'char'")
        return self._bounds(repair(text), self.encode_ordinary(text), unit)

    def _bounds(self, text: str, ids: list[int], unit: str) -> list[int]:
        if not self.fold or "▁" not in text:
            return list(accumulate(map(self._widths[unit].__getitem__, ids), initial=0))
        found = list(accumulate(self._unfolded(text, [len(self.tokens[i]) for i in ids]), initial=0))
        if unit == "byte":
            return found
        before = list(accumulate(((b & 0xC0) != 0x80 for b in text.encode()), initial=0))
        return [before[b] for b in found]

    def offsets(self, text: str, unit: str = "byte") -> tuple[list[int], list[tuple[int, int]]]:
        """Ids, and the span of each; spans tile the text."""
        if unit not in ("byte", "char"):
            raise ValueError("unit is 'byte' or 'char'")
        ids = self.encode_ordinary(text)
        found = self._bounds(repair(text), ids, unit)
        return ids, list(zip(found[:-1], found[1:]))

    @staticmethod
    def _unfolded(text: str, sizes: list[int]) -> list[int]:
        """Byte sizes in the text before its markers became spaces."""
        widths = [len(w) for c in text for w in ([c.encode()] if c == "▁" else [bytes([b]) for b in c.encode()])]
        out, at = [], 0
        for size in sizes:
            out.append(sum(widths[at : at + size]))
            at += size
        return out

    def truncate(self, text: str, max_tokens: int) -> Truncation:
        """At most so many tokens, cut back to a character's border."""
        text = repair(text)
        data = text.encode()
        ids = self.encode_ordinary(text)
        if len(ids) <= max_tokens:
            return Truncation(text, len(data), len(ids), len(ids))
        sizes = [len(self.tokens[i]) for i in ids]
        if self.fold:
            sizes = self._unfolded(text, sizes)
        end = sum(sizes[: max(0, max_tokens)])
        while end and end < len(data) and (data[end] & 0xC0) == 0x80:
            end -= 1
        kept, at = 0, 0
        for size in sizes[: max(0, max_tokens)]:
            at += size
            kept += at <= end
        return Truncation(data[:end].decode(), end, len(ids), kept)

    # decoding and lookups

    @cached_property
    def special_of(self) -> dict[int, str]:
        return {i: s for s, i in reversed(self.specials)}

    def decode_bytes(self, ids) -> bytes:
        """Bytes of ids and of special ids' strings; unknown ids say nothing."""
        return b"".join(self.tokens[i] if i in self.tokens else self.special_of.get(i, "").encode() for i in ids)

    def decode(self, ids, errors: str = "replace") -> str:
        data = self.decode_bytes(ids)
        if errors == "strict":
            try:
                return data.decode()
            except UnicodeDecodeError as error:
                raise ValueError("the ids' bytes aren't UTF-8") from error
        text = data.decode("utf-8", "replace")
        return text.replace("�", "") if errors == "ignore" else text

    def encode_single_token(self, token: bytes | str) -> int:
        data = token.encode() if isinstance(token, str) else bytes(token)
        if data in self.ids:
            return self.ids[data]
        for special, i in self.specials:
            if special.encode() == data:
                return i
        raise KeyError(data)

    def decode_single_token_bytes(self, token_id: int) -> bytes:
        if token_id in self.tokens:
            return self.tokens[token_id]
        if token_id in self.special_of:
            return self.special_of[token_id].encode()
        raise KeyError(token_id)

    def token_byte_values(self) -> list[bytes]:
        return [t for _, t in sorted(self.tokens.items())]

    def is_special_token(self, token_id: int) -> bool:
        return token_id in self.special_of

    def known_id(self, token_id: int) -> bool:
        return token_id in self.tokens or token_id in self.special_of

    @property
    def max_token_value(self) -> int:
        return max([*self.tokens, *self.special_of])

    @property
    def n_vocab(self) -> int:
        return self.max_token_value + 1

    @property
    def eot_token(self) -> int:
        return dict(self.specials)[EOT]

    @property
    def special_tokens_set(self) -> set[str]:
        return {s for s, _ in self.specials}

    def memory_breakdown(self) -> dict[str, int]:
        """Bytes of each table's payload."""
        return {
            "tokens": sum(len(t) + 4 for t in self.tokens.values()),
            "splits": len(self.vocabulary.splits or ()),
            "merges": 4 * len(self.vocabulary.merges or ()),
            "pairs": 16 * len(self.pairs),
            "specials": sum(len(s.encode()) + 6 for s, _ in self.specials),
        }

    def memory_bytes(self) -> int:
        return sum(self.memory_breakdown().values())


def _lenient(unit: bytes) -> str:
    """The character that a unit of _LENIENT stands for; none that Unicode has: U+10FFFF."""
    if len(unit) == 1:
        return chr(unit[0])
    code = unit[0] & (0x7F >> len(unit))
    for b in unit[1:]:
        code = code << 6 | b & 0x3F
    return chr(code) if code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else "\U0010FFFF"


def repair(text: str) -> str:
    """Text without lone surrogates: split pairs rejoin, others become U+FFFD."""
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


@lru_cache
def unnormalized_ranges() -> tuple[tuple[int, int], ...]:
    """Ranges of all code points that NFC may change or that may join one before them.
    All lie from U+0300 on."""

    def may(c: int) -> bool:
        s = chr(c)
        return unicodedata.combining(s) != 0 or not unicodedata.is_normalized("NFC", s) or _composes(c)

    ranges, start = [], None
    for c in range(0x300, 0x110001):
        hit = c < 0x110000 and not 0xD800 <= c < 0xE000 and may(c)
        if hit and start is None:
            start = c
        if not hit and start is not None:
            ranges.append((start, c - 1))
            start = None
    return tuple(ranges)


def unnormalized_class() -> str:
    """Those code points as the inside of a Java character class."""
    return formats.class_of_ranges(unnormalized_ranges())


_SECONDS: set[int] = set()


def _composes(c: int) -> bool:
    """Whether a code point is the second part of some canonical composition."""
    if not _SECONDS:
        for k in range(0x110000):
            parts = unicodedata.decomposition(chr(k)).split()
            if len(parts) == 2 and parts[0][0] != "<":
                _SECONDS.add(int(parts[1], 16))
        _SECONDS.update(range(0x1161, 0x1176))
        _SECONDS.update(range(0x11A8, 0x11C3))
    return c in _SECONDS


def unnormalized(texts: list[str]) -> list[int]:
    """Places of the texts that NFC might change."""
    global _UNSAFE
    if _UNSAFE is None:
        _UNSAFE = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in unnormalized_ranges()) + "]")
    return [k for k, t in enumerate(texts) if _UNSAFE.search(t)]


def load(name: str, path: str = "", grammar_name: str | None = None) -> Encoding:
    """An encoding by name, from a vocabulary file or a folder with <name>.vocab; cached."""
    if name == ESTIMATE:
        raise KeyError(f"{ESTIMATE!r} has no ids: count and truncate with it")
    if (name, "", None) in _CACHE and not path:
        return _CACHE[name, "", None]
    if name not in KNOWN and grammar_name is None:
        raise KeyError(f"unknown encoding {name!r}; available: {', '.join(names())}")
    if not path:
        raise KeyError(f"encoding {name!r} needs the path of its vocabulary")
    if os.path.isdir(path):
        path = os.path.join(path, f"{name}.vocab")
    key = (name, path, grammar_name)
    if key not in _CACHE:
        default, nfc, fold = KNOWN.get(name, (grammar_name, False, False))
        _CACHE[key] = Encoding(name, formats.read_vocabulary(path), grammar_name or default, nfc, fold)
    return _CACHE[key]


def names() -> list[str]:
    """What load() knows without a grammar, and the estimate."""
    return [*KNOWN, ESTIMATE]


def alias(name: str, known: str) -> None:
    """Another name for a known encoding, such as one that a user's programs already say."""
    if known not in KNOWN:
        raise KeyError(f"unknown encoding {known!r}; available: {', '.join(KNOWN)}")
    KNOWN[name] = KNOWN[known]


def register(encoding: Encoding) -> Encoding:
    """Make an encoding built in the program available by its name."""
    _CACHE[encoding.name, "", None] = encoding
    return encoding
