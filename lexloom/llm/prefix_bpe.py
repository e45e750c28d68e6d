"""Exact BPE ids by dynamic programming over prefixes.

A word's encoding is fixed by pairs: a sequence of tokens is what merging in rank
order yields exactly when each token is what its own string yields and each two
neighbours are what their joined string yields. So every prefix of a word has
one last token. An automaton over the vocabulary (Aho-Corasick: the suffix
links of all tokens) lists the tokens that end at each letter; the one that is
compatible with the last token of the prefix before it is stored, and following
these back from the word's end gives the ids.

Two neighbours are compatible when, going back through the merges that made
them, no pair of tokens that once met at their border would have merged before
one of the two was merged away from it.

The vocabulary file's words end in a marked letter, which is a letter of its own
here. Text is split as the file asks: NFC, lower case, white space dropped. A
text in the alphabet below is split by one pattern; any other text, and the parts
of a text around special tokens, by the library's own normalizer and splitter.
Words recur, so a worker keeps the ids of each.

Null texts count as empty: no id, and the digest of nothing. Repeated rows give
equal rows, an empty table gives none, other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .tokens import LETTERS, NUMBERS, OTHERS, byte_letters

MEMO_WORDS = 800_000
MEMO_CHARS = 48
#: Pairs whose compatibility a worker keeps.
MEMO_PAIRS = 2_000_000
ENDED = 256
SUFFIX = "</w>"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

_FOREIGN = re.compile(rf"[^\x00-\x1b\x20-\xff{LETTERS}{OTHERS}]|İ")
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")


class PrefixEncoder:
    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.letters = spec["model"], byte_letters()
        self.library = Tokenizer.from_file(path)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")")
        self.text_of = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.specials.items()}
        ids = model["vocab"]
        # merges: pair -> (rank, merged); spines need each token's two parts
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = dict.fromkeys(ids.values(), -1)
        for k, (a, b) in enumerate(model["merges"]):
            pair, made = (ids[a], ids[b]), ids[a + b]
            self.rank.setdefault(pair, k)
            if made not in self.parts:
                self.parts[made], self.born[made] = pair, k
        self.right, self.left = ({}, {})
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, tuple[str, int, str]] = {}
        self.automaton = ahocorasick.Automaton()
        for token, i in ids.items():
            letters = self.symbols(token)
            if self._stable(i):
                self.automaton.add_word(letters, (i, len(letters)))
        self.automaton.make_automaton()

    def symbols(self, token: str) -> str:
        """A token or word of the file's spelling, one letter for each symbol."""
        ended = token.endswith(SUFFIX)
        body = [self.letters[c] for c in (token[: -len(SUFFIX)] if ended else token)]
        if ended:
            body[-1] += ENDED
        return "".join(map(chr, body))

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """(token, rank of the merge that took it away) along one edge, latest first."""
        memo = (self.left, self.right)[side]
        found = memo.get(token)
        if found is None:
            found = memo[token] = [(token, 1 << 60)]
            while token in self.parts:
                gone, token = self.born[token], self.parts[token][side]
                found.append((token, gone))
        return found

    def compatible(self, one: int, two: int) -> bool:
        """Whether merging the two tokens' joined string leaves these two."""
        key = one << 20 | two
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > MEMO_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._meet(one, two)
        return known

    def _meet(self, one: int, two: int, joined: bool = False) -> bool:
        """Whether no pair at the border of two tokens merges before they are whole
        (or ever, unless they are joined at last)."""
        ends, starts = self._spine(one, 1), self._spine(two, 0)
        i = j = 0
        while True:
            (a, a_gone), (b, b_gone) = ends[i], starts[j]
            r = self.rank.get((a, b))
            # of equal ranks the left merge comes first
            if r is not None and r < a_gone and r <= b_gone and (i or j or not joined):
                return False
            a_born, b_born = self.born[a], self.born[b]
            if a_born < 0 and b_born < 0:
                return True
            if a_born > b_born:
                i += 1
            else:
                j += 1

    def _stable(self, token: int) -> bool:
        """Whether a token's own string yields the token."""
        stack = [token]
        while stack:
            t = stack.pop()
            if t in self.parts:
                a, b = self.parts[t]
                if not self._meet(a, b, joined=True):
                    return False
                stack += (a, b)
        return True

    def encode_symbols(self, word: str) -> list[int]:
        """Ids of one word of symbols, by its prefixes' last tokens."""
        last = [None] * len(word)
        compatible = self.compatible
        for end, (token, size) in self.automaton.iter(word):
            if last[end] is None:
                start = end - size
                if start < 0:
                    last[end] = (token, start)
                else:
                    before = last[start]
                    if before is not None and compatible(before[0], token):
                        last[end] = (token, start)
        found, at = [], len(word) - 1
        while at >= 0:
            token, at = last[at]
            found.append(token)
        return found[::-1]

    def _word(self, symbols: str) -> tuple[str, int, str]:
        ids = self.encode_symbols(symbols)
        return " ".join(map(str, ids)), len(ids), " ".join(map(self.text_of.__getitem__, ids))

    def _plain(self, text: str) -> list[tuple[str, int, str]]:
        """Words of a text without special tokens: (ids, count, decoded)."""
        if _FOREIGN.search(text):
            normal = self.library.normalizer.normalize_str(text)
            words = ["".join(chr(self.letters[c]) for c in w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
            return [self._word(w[:-1] + chr(ord(w[-1]) + ENDED)) for w in words]
        memo, words = self.words, _WORDS.findall(text.lower())
        try:
            return list(map(memo.__getitem__, words))
        except KeyError:
            pass
        if len(memo) > MEMO_WORDS:
            memo.clear()
        fresh = {}
        for w in set(words).difference(memo):
            letters = w.encode().decode("latin-1")
            found = self._word(letters[:-1] + chr(ord(letters[-1]) + ENDED))
            (memo if len(w) <= MEMO_CHARS else fresh)[w] = found
        return [memo[w] if w in memo else fresh[w] for w in words]

    def parts_of(self, text: str | None) -> list[tuple[str, int, str]]:
        text = text or ""
        if not any(s in text for s in self.specials):
            return self._plain(text)
        out = []
        for k, piece in enumerate(self.special_split.split(text)):
            out += [(str(self.specials[piece]), 1, piece)] if k % 2 else self._plain(piece)
        return out

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for ids, _, _ in self.parts_of(text) for i in ids.split()]

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder, so tokens are joined by spaces; unknown ids are skipped."""
        return " ".join(self.text_of[i] for i in ids if i in self.text_of)


def encoder(path: str) -> PrefixEncoder:
    """This worker's encoder of a file, kept from task to task."""
    return common.worker_memo(("prefixes", path), lambda: PrefixEncoder(path))


def digest(docs: DataFrame, vocab_path: str) -> DataFrame:
    """Counts and digests of ids and decoded text, see SCHEMA."""

    def run(batches):
        known = encoder(vocab_path)
        for batch in batches:
            sizes, ids, texts = [], [], []
            for text in batch.column(1).to_pylist():
                parts = known.parts_of(text)
                sizes.append(sum([p[1] for p in parts]))
                ids.append(hashlib.sha256(" ".join([p[0] for p in parts]).encode()).hexdigest())
                texts.append(hashlib.sha256(" ".join([p[2] for p in parts]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    texts = common.small_batches(docs).selectExpr("cast(doc_id as long) as doc_id", "text")
    return texts.mapInArrow(run, SCHEMA)
