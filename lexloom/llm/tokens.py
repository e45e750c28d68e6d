"""Exact ids of a byte-level BPE tokenizer file, with a memo of pieces.

The tokenizers library does all merging. It merges within pieces of its fixed
split pattern only, so a text may be split first and each piece be given to the
library's model alone. Pieces recur: a worker asks once for a new piece and keeps
its id bytes. The split here is written for an alphabet whose classes no Unicode
version changes; a text with any other character, or with a special token's
string, goes to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array

from . import common

# Code points whose Unicode class is the same in every library.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ſ"
NUMBERS = "0-9²³¹¼-¾"
OTHERS = "‐-‧‰-⁞₠-₿"
_FOREIGN = re.compile(rf"[^\x00-\x1b\x20-\xff{LETTERS}{OTHERS}]")
_PIECES = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+"
)

#: Pieces kept per worker (about 200 bytes each), and the longest piece kept.
MEMO_ENTRIES = 600_000
MEMO_CHARS = 48
#: Texts that are looked up together.
GROUP = 128


def byte_letters() -> dict[str, int]:
    """Letters that byte-level vocabularies write for bytes: printable ones stand for
    themselves, the others for the code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    found = {chr(b): b for b in plain}
    rest = (b for b in range(256) if b not in set(plain))
    return found | {chr(256 + k): b for k, b in enumerate(rest)}


class PieceEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.letters = str.maketrans({chr(b): c for c, b in byte_letters().items()})
        self.memo: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _piece(self, piece: str) -> bytes:
        """Ids of one piece, by the library's model; it reads bytes as letters."""
        letters = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _group(self, texts: list[str]) -> list[bytes]:
        split = [
            None if _FOREIGN.search(t) or any(s in t for s in self.specials) else _PIECES.findall(t) for t in texts
        ]
        if len(self.memo) > MEMO_ENTRIES:
            self.memo.clear()
        seen: set[str] = set()
        for pieces in split:
            seen.update(pieces or ())
        new = list(seen.difference(self.memo))
        self.memo.update(zip(new, map(self._piece, new)))
        whole = iter(self._library([t for t, p in zip(texts, split) if p is None]))
        ids = self.memo.__getitem__
        out = [next(whole) if p is None else b"".join(map(ids, p)) for p in split]
        for piece in new:
            if len(piece) > MEMO_CHARS:
                del self.memo[piece]
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian uint32 bytes; null counts as empty."""
        out: list[bytes] = []
        for k in range(0, len(texts), GROUP):
            out += self._group([t or "" for t in texts[k : k + GROUP]])
        return out


def encoder(path: str) -> PieceEncoder:
    """This worker's encoder of a file, kept from task to task."""
    return common.worker_memo(("pieces", path), lambda: PieceEncoder(path))


def vocabulary(name: str) -> str:
    """Place of one of the installed public tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path(name)
