"""Personal data: fixed patterns, and a linear-chain conditional random field.

Base patterns find e-mail addresses, IPv4 addresses, card numbers (13 to 19
digits that pass Luhn) and international phone numbers, leftmost and without
overlap for each kind; a match that fails its test is dropped whole. The field
adds what the patterns can't say: addresses written with "at" and "dot", phone
numbers without a plus sign, and secrets after a word such as token or password.
It labels every token of the text from the shapes of the words around it, is trained
by gradient ascent on the small labelled table below, and decodes by Viterbi over
batches in numpy. Only added spans clear of every base span are kept.

A token's shape is one of a fixed list (its length if digits, itself if it is a cue
word or a sign, else its case), so what all features of a token weigh is looked up in
tables over shapes. Long texts are cut to stretches of about STRETCH tokens: the best
scores through a stretch from every label before it to every label at its end join
the stretches exactly, so the path is the whole text's likeliest.

Null texts count as empty and have no span. Very long texts take memory in proportion
(about 100 bytes a token). Repeated rows give equal rows; an empty table gives none;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

KINDS = ("email", "ip", "card", "phone")
ADDED = ("email", "phone", "secret")
ORDER = {kind: k for k, kind in enumerate((*KINDS, "secret"))}
LABELS = ("O", *(f"{p}-{k}" for k in ADDED for p in "BI"))
STRETCH = 256
#: Tokens that are decoded together, and pieces whose shape a worker keeps.
TOGETHER, MEMO_PIECES = 300_000, 500_000
SCHEMA = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"
)

# The labelled table: kind:text between braces is personal data, a run of # stands
# for random digits, of @ for random hexadecimal digits, of ~ for random letters, of ^
# for random capitals, of & for either or digits, and of < > in guillemets for braces.
LABELLED = """
write to {email:~~~~ (at) ~~~~~~ (dot) com} today
contact {email:~~~~~.~~~~ [at] ~~~~ [dot] org} for more
mail {email:~~~~## (at) mail#.~~~~~~.com} or call
reach me: {email:~~~~~~ [at] ~~~~~~~.net}.
{email:~~~ (at) ~~~~~ (dot) ~~} is the address
send it to {email:~~~~~~~_~~~ (at) ~~~~~~~~.com}, please
mail {email:~~~~ at ~~~~ dot org} now
mail {email:~~~~ at mail dot org} now
^~~~ {email:~~~~ at ~~~~~~~ dot com} if you like
write to {email:~~~~~.~~~~~ at ~~~~ dot net}.
~~~~~ ~~~ {email:~~~~~ at ~~~~~~ dot ~~~} ~~~~ ~~~
{email:~~~~ at ~~~~~~~ dot com}
{email:~~~~~~ at ~~~~ dot net} ~~~ ~~~~
~~~ {email:~~~~~~ ‹at› ~~~~~ ‹dot› com} ~~~~
~~~ {email:~~~~~~ <at> ~~~~~ <dot> org} ~~~~
^~~~~ {email:^~~~.^~~~~ (at) ~~~~~.~~~~~ (dot) com}.
^~~~ {email:~~~~ (AT) ~~~~~ (DOT) com} ~~~
they met (at) noon in ~~~~~ street ##
he was [at] ~~~~~~ that day, ####
they met at ~~~~~ and ~~~~ at ~~~
^~~~ ~~~ at ~~~~ ~~~ dot ~~~~ com
at ~~~~ the dot on the map, at ~~~
look at ~~~~~ dot and ~~~ org ~~~
~~~ at at at at at at at at at ~~~ ~~~
~~~ dot dot dot dot dot dot ~~~
~~~~ ~~~~. ~~~~. ~~~~. ~~~~. ~~~~. ~~~~. ~~~~. ~~~~. ~~~~. ~~~~.
~~~~~ ~~~~~ ~~~. ~~~. ~~~. ~~~. ~~~. ~~~. ~~~. ~~~. ~~~. ~~~. ^~ ~~~
~~~~. ~~~~, ~~~~. ~~~~~~. ~~~ ~~~. ~~~~ ~~~~. ^~~~. ^~~. ~~~~ ~~~
^~~. ^~~. ^~~. ^~~. ^~~. ^~~~. ^~~~. ^~~.
~~~ ~~~ ~~~ ~~~ ~~~ ~~~ ~~~ ~~~ ~~~ ~~~ ~~~ ~~~ ~~~ ~~~ ~~~ ~~~
# # # # # # # # # # # # # # # # #
### ### ### ### ### ### ### ### ###
####. ####. ####. ####. ####. ####. ####.
call {phone:(###) ###-####} after noon
Call {phone:###-###-####} now
Call {phone:(###) ###-####}.
^~~~ {phone:###-###-####}
^~~~ ~~~~ {phone:(###) ###-####}
^~~~~ {phone:###.###.####}, ~~~
tel {phone:###-###-####} or write
call ~~: {phone:###-###-####}; ~~~~; ~~~
Tel: {phone:###-###-####}.
^~~~~ tel: {phone:(###) ###-####}, ~~~
phone: {phone:(###) ###-####}.
Phone {phone:### ### ####} ~~~~
my number is {phone:###-###-####}, ask for ~~~~~
{phone:###-###-####} is my number
{phone:(###) ###-####} ~~~~ ~~~~~
ring {phone:0## #### ####} now
^~~~~~ ring {phone:0### ### ####} ~~~
call {phone:0### ### ####}.
Fax {phone:0## #######} ~~~
fax {phone:###.###.####} works too
phone {phone:0# ## ## ## ##} le matin
~~~~~ ~~~~ {phone:(###) ###-####} ~~~ ~~~~~
~~~~~ ~~~~ {phone:###-###-####} ~~~ ~~~~~
~~~~~. {phone:###-###-####} ~~~ ~~~~~, {phone:###-###-####}.
token = "{secret:@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@}" ~~~~ ~~~
~~~~~ ~~~ token = "{secret:@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@}" ~~~~~
~~~ ~~~~ api_key = "{secret:@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@}" ~~~
API_KEY={secret:@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@}
~~~ api_key: {secret:&&&&&&&&&&&&&&&&&&&&&&&&} ~~~
token={secret:&&&&&&&&&&&&&&&&&&&&} ~~~~
password: {secret:~~~~##~~##} ~~~~~ ~~~
password: {secret:~~~~~~~~~~~~} please
Password: {secret:~~~~~~~~}
^~~~ ~~~ password: {secret:^~~~~##}, ~~~
password = "{secret:~~~~~~~##}" ~~~
passwd: {secret:~~~~~~###} ~~~
passwd={secret:~~~~~~~~}
secret = '{secret:@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@}' ~~~
secret: {secret:~~~~~~~~~##} ~~~
key: {secret:@@@@@@@@@@@@@@@@@@@@@@@@} ~~~~
the token was read on line ## of the file
a key of ### entries and a password of # letters
^~~ password was ~~~~, the key is ~~~~~ ~~~
~~~~ the secret of the ~~~~, a token of ~~~~~.
^~~ key ~~~~, ~~~: ~~~~~ and the password ~~~
~~~~: ~~~~~ ~~~ key, ~~~~ = ~~~~~
~~~~~ ~~~~~~. Version #.# ~~~~ ~~~
licensed under ~~ ~~-~~ #.#.
licensed under the ~~~~~~ license, version #.#.
~~~~ ~~~~~~ license, version #.
in #### the town had ##### people
from #### to ####, pages ##-##
pages ###-### of ####, see ###.
it costs ##.## or ### in all
^~~~ ## ~~~ ### ~~~~, ~~~ #### ~~~.
~~~~~ ################ ~~~~~ ~~~~
~~~~ ~~~ ################ ~~~ ~~~~~~
~~~~~, ################ ~~~~. ~~~~~
~~~~ #### #### #### #### ~~~ ~~~
~~~~ ####-####-####-#### ~~~
~~~ ########## ~~~ ###########
{phone:(###) ###-####} ################ ~~~~
~~~~~ ~~~ ##.###.###.## ~~~~~ ~~~~
~~~~~ ###.##.##.### ~~~~ ~~~
~~~~ ~~~~ #.#.# ~~~ ~~~~
a table of ## by ### and ####-##-##
at ##:## on ##/##/#### they left
chapter #, verse ##, and (##) more
^~~~ (####) ~~~ ##-#### ~~~
~~~~~ | ~~~~~ | ~~~~ # | ~~~~~
~~~~~.##@~~~~#.~~~~~~~.com ~~~~ ~~~
~~~~~@~~~~~~~.com ~~~~ ~~~ at ~~~~
+# (###) ###-#### ~~~~ ~~~~~
~~~~~~ +# (###) ###-#### ~~~ ################ ~~~
~~~~ ~~~~~ ~~~ ~~~~, ~~~~~~ ~~~ ~~~~. ^~~~ ~~~ ~~~~~ ~~~
^~~~~ ~~ ~~~~~~ ~~~ "~~~~ ~~~~" ~~~, ~~~~: ~~~ ~~~~'~ ~~~
^~~~~~~. ^~~~~~. ^~~ ~~~~ ~~~-~~~~~ ~~~~ (~~~~~ ~~~) ~~~
^^^^ ^^^ ^^^^^^ ~~~~ ^^^ ~~~!! ^^^^~!! ~~~
~~~~*** ~~~$$$ ~~~,%%% ~~~~### ~~~ ~~~///
~~~~ @@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@ ~~~~ ~~~
~~~~/~~~~/~~~~.~~~~ http://~~~.~~~~~.com/~~~?~~~=### ~~~
""".strip().splitlines()
VARIANTS = 6
WORDS = frozenset("at dot com org net token key api secret password passwd tel phone fax call ring number mail email version".split())

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
# A token with the white space before it: a long run of letters and digits, letters,
# digits or a sign.
_PIECE = re.compile(r"\s*(?:(?<![^\W_])[0-9A-Za-z]{16,}(?![^\W_])|[^\W\d_]+|\d+|[^\w\s]|_)")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            found.append(("email", start, end))
        at = text.find("@", max(end, at + 1))
    return found


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by kind as listed, then start."""
    found = _emails(text)
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                found.append(("phone", *m.span()))
    return found


def tokenize(text: str) -> list[tuple[str, int, int]]:
    """Tokens of a text with their places."""
    found, at = [], 0
    for piece in _PIECE.findall(text):
        token = piece.lstrip()
        at += len(piece)
        found.append((token, at - len(token), at))
    return found


def shape(token: str) -> str:
    if token.isdigit():
        return f"d{min(len(token), 13)}"
    if token.isalpha():
        if token.lower() in WORDS:
            return f"w:{token.lower()}"
        return "X" if token[0].isupper() else "x"
    if len(token) >= 16 and token.isalnum():
        return "mixed"
    return token if token.isascii() else "?"


def features(tokens: list[tuple[str, int, int]]) -> list[list[str]]:
    """Feature names of each token, from the shapes around it and what it touches."""
    s = ["<", "<", *(shape(t) for t, _, _ in tokens), ">", ">"]
    touch = ["g" if a and tokens[a - 1][2] == t[1] else "s" for a, t in enumerate(tokens)] + ["s"]
    return [
        [
            f"0{s[k]}",
            f"-{s[k - 1]}|{s[k]}",
            f"+{s[k]}|{s[k + 1]}",
            f"3{s[k - 1]}|{s[k]}|{s[k + 1]}",
            f"<{s[k - 2]}|{s[k - 1]}|{s[k]}",
            f">{s[k]}|{s[k + 1]}|{s[k + 2]}",
            f"t{touch[k - 2]}{touch[k - 1]}|{s[k]}",
        ]
        for k in range(2, len(tokens) + 2)
    ]


class Field:
    """A linear chain over LABELS: emission weights by feature, and transitions."""

    def __init__(self, names: dict[str, int]):
        self.names = names
        self.emit = np.zeros((len(names) + 1, len(LABELS)))
        self.move = np.zeros((len(LABELS), len(LABELS)))
        self.forbid = np.zeros_like(self.move)
        for a, left in enumerate(LABELS):
            for b, right in enumerate(LABELS):
                if right[0] == "I" and left[1:] != right[1:]:
                    self.forbid[a, b] = -1e4
        self.first = np.array([-1e4 if x[0] == "I" else 0.0 for x in LABELS])

    def _ids(self, batch: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers [n, t, f], where the last number weighs nothing; and lengths."""
        lengths = np.array([len(x) for x in batch])
        ids = np.full((len(batch), lengths.max(), 7), len(self.names))
        for n, sequence in enumerate(batch):
            for t, own in enumerate(sequence):
                ids[n, t] = [self.names.get(f, len(self.names)) for f in own]
        return ids, lengths

    def decode(self, batch: list[list[list[str]]]) -> list[list[int]]:
        """The likeliest labels of each sequence, from feature names."""
        ids, lengths = self._ids(batch)
        score = self.emit[ids].sum(2)
        best, back = score[:, 0] + self.first, []
        for t in range(1, ids.shape[1]):
            each = best[:, :, None] + self.move + self.forbid
            back.append(each.argmax(1))
            grown = each.max(1) + score[:, t]
            best = np.where((t < lengths)[:, None], grown, best)
        label, out = best.argmax(1), np.zeros(ids.shape[:2], int)
        for t in range(ids.shape[1] - 1, -1, -1):
            out[:, t] = label
            if t:
                label = np.where(t < lengths, back[t - 1][np.arange(len(label)), label], label)
        return [row[:size].tolist() for row, size in zip(out, lengths)]

    @classmethod
    def train(cls, rows: list[tuple[list[list[str]], list[int]]], steps: int = 120, rate: float = 0.15) -> Field:
        names: dict[str, int] = {}
        for sequence, _ in rows:
            for own in sequence:
                for f in own:
                    names.setdefault(f, len(names))
        field = cls(names)
        ids, lengths = field._ids([s for s, _ in rows])
        n, width, _ = ids.shape
        want = np.zeros((n, width), int)
        for k, (_, labels) in enumerate(rows):
            want[k, : len(labels)] = labels
        mask = np.arange(width) < lengths[:, None]
        truth_move = np.zeros_like(field.move)
        pairs = mask[:, 1:]
        np.add.at(truth_move, (want[:, :-1][pairs], want[:, 1:][pairs]), 1)
        one = np.eye(len(LABELS))[want] * mask[:, :, None]
        state = [np.zeros_like(x) for x in (field.emit, field.move)] * 1
        second = [np.zeros_like(x) for x in state]
        for step in range(1, steps + 1):
            near, moves = field._expect(ids, lengths)
            gap = one - near * mask[:, :, None]
            g_emit = np.zeros_like(field.emit)
            for f in range(ids.shape[2]):
                np.add.at(g_emit, ids[:, :, f], gap)
            g_emit[-1] = 0
            grads = [g_emit / n - 1e-4 * field.emit, (truth_move - moves) / n - 1e-4 * field.move]
            for k, (g, x) in enumerate(zip(grads, (field.emit, field.move))):
                state[k] = 0.9 * state[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                x += rate * (state[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        return field

    def _expect(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward-backward: label probabilities [n, t, label], summed transitions."""
        score, move = self.emit[ids].sum(2), self.move + self.forbid
        n, width, size = score.shape
        alpha, beta = np.zeros((n, width, size)), np.zeros((n, width, size))
        alpha[:, 0] = score[:, 0] + self.first
        for t in range(1, width):
            alpha[:, t] = _log_sum(alpha[:, t - 1, :, None] + move, 1) + score[:, t]
        for t in range(width - 2, -1, -1):
            after = _log_sum(move[None] + (score[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where((t + 1 < lengths)[:, None], after, 0)
        total = _log_sum(alpha[np.arange(n), lengths - 1], 1)
        near = np.exp(alpha + beta - total[:, None, None])
        moves = np.zeros_like(self.move)
        for t in range(1, width):
            live = t < lengths
            pair = alpha[live, t - 1, :, None] + move + (score[live, t] + beta[live, t])[:, None, :]
            moves += np.exp(pair - total[live, None, None]).sum(0)
        return near, moves


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def labelled_rows(seed: int = 5) -> list[tuple[str, list[Span]]]:
    """The labelled table with its blanks filled, several times over."""
    rng = np.random.default_rng(seed)
    small = "abcdefghijklmnopqrstuvwxyz"
    pools = {"#": "0123456789", "@": "0123456789abcdef", "~": small, "^": small.upper(), "&": small + small.upper() + "0123456789"}
    rows = []
    for line in LABELLED:
        for _ in range(VARIANTS):
            text, spans, kind, start = "", [], "", 0
            for part in re.findall(r"\{[a-z]+:|\}|[^{}]", line):
                if part[0] == "{":
                    kind, start = part[1:-1], len(text)
                elif part == "}":
                    spans.append((kind, start, len(text)))
                else:
                    pool = pools.get(part)
                    if part == "@" and "@" * 16 not in line:
                        pool = None
                    text += pool[rng.integers(len(pool))] if pool else {"‹": "{", "›": "}"}.get(part, part)
            rows.append((text, spans))
    return rows


@lru_cache(maxsize=1)
def field() -> Field:
    """The field trained on the labelled table, once in a process."""
    rows = []
    for text, spans in labelled_rows():
        tokens = tokenize(text)
        labels = []
        for _, low, high in tokens:
            kind = next(((k, a) for k, a, b in spans if a <= low and high <= b), None)
            labels.append(LABELS.index(f"{'B' if low == kind[1] else 'I'}-{kind[0]}") if kind else 0)
        rows.append((features(tokens), labels))
    return Field.train(rows)


class Reader:
    """The field over tables of shapes, for one worker."""

    def __init__(self, model: Field):
        # Shapes that no row has weigh nothing; all are one.
        known = sorted({s for f in model.names for s in _shapes_of(f)} | {"<", ">"})
        self.of = {s: k + 1 for k, s in enumerate(known)}
        n = self.count = len(known) + 1
        self.move = (model.move + model.forbid).astype(np.float32)
        self.first = model.first.astype(np.float32)
        size = len(LABELS)
        near, back, ahead = (np.zeros((n, n, n, size), np.float32) for _ in range(3))
        touch = np.zeros((2, 2, n, size), np.float32)
        for name, row in model.names.items():
            at, weights = [self.of[s] for s in _shapes_of(name)], model.emit[row].astype(np.float32)
            if name[0] == "0":
                near[:, at[0], :] += weights
            elif name[0] == "-":
                near[at[0], at[1], :] += weights
            elif name[0] == "+":
                near[:, at[0], at[1]] += weights
            elif name[0] == "t":
                touch[int(name[1] == "g"), int(name[2] == "g"), at[0]] += weights
            else:
                {"3": near, "<": back, ">": ahead}[name[0]][tuple(at)] += weights
        self.near, self.back, self.ahead = (x.reshape(-1, size) for x in (near, back, ahead))
        self.touch = touch.reshape(-1, size)
        self.memo = _Codes(self.of)

    def codes(self, pieces: list[str]) -> np.ndarray:
        """Two times the shape of each piece's token, and 1 if no white space is before it."""
        if len(self.memo) > MEMO_PIECES:
            self.memo.clear()
        return np.fromiter(map(self.memo.__getitem__, pieces), np.int64, len(pieces))

    def weigh(self, codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Scores [label, place] of the texts' tokens, with two blank places before and
        after each text's; and where each text's tokens begin."""
        edge = np.array([2 * self.of["<"]] * 2), np.array([2 * self.of[">"]] * 2)
        joined = np.concatenate([x for c in codes for x in (edge[0], c, edge[1])])
        sizes = np.array([len(c) + 4 for c in codes])
        begins = np.cumsum(sizes) - sizes + 2
        s, glued, n = joined >> 1, joined & 1, self.count
        glued[begins] = 0  # nothing is before a text's first token
        mid = s[2:-2]
        score = self.near.take((s[1:-3] * n + mid) * n + s[3:-1], 0)
        score += self.back.take((s[:-4] * n + s[1:-3]) * n + mid, 0)
        score += self.ahead.take((mid * n + s[3:-1]) * n + s[4:], 0)
        score += self.touch.take((glued[2:-2] * 2 + glued[3:-1]) * n + mid, 0)
        return np.ascontiguousarray(score.T), begins - 2

    def _forward(self, score: np.ndarray, begin: np.ndarray, sizes: np.ndarray, state: np.ndarray, keep: bool):
        """Best scores through runs of tokens, longest run first: state[..., label, run]
        is that of each run's first token. All of them [t, label, run], or the last ones."""
        out = np.empty((int(sizes[0]), *state.shape), np.float32) if keep else state.copy()
        move = self.move[:, :, None]
        live = len(sizes)
        for t in range(int(sizes[0])):
            while sizes[live - 1] <= t:
                live -= 1
            state = state[..., :live]
            if t:
                state = (state[..., :, None, :] + move).max(-3)
                state += score.take(begin[:live] + t, 1)
            if keep:
                out[t, ..., :live] = state
            else:
                out[..., :live] = state
        return out

    def decode(self, codes: list[np.ndarray]) -> list[np.ndarray]:
        """The likeliest labels of each text's tokens."""
        score, begins = self.weigh(codes)
        # Runs of every text: (text, from, to), of about equal sizes.
        cuts = []
        for k, c in enumerate(codes):
            parts = -(-len(c) // STRETCH)
            cuts += [(k, len(c) * p // parts, len(c) * (p + 1) // parts) for p in range(parts)]
        text, low, high = (np.array(x) for x in zip(*cuts))
        order = np.argsort(low - high, kind="stable")
        rank = np.argsort(order)
        text, low, high = text[order], low[order], high[order]
        begin, sizes, opens = begins[text] + low, high - low, low == 0
        here = score.take(begin, 1)
        state = self.first[:, None] + here
        later = np.flatnonzero(~opens)
        entry, last = {}, np.full(len(order), -1)
        if len(later):
            through = self._forward(score, begin[later], sizes[later], self.move[:, :, None] + here[None][:, :, later], False)
            multiple = np.isin(text, text[later]) & opens
            ends = self._forward(score, begin[multiple], sizes[multiple], state[:, multiple], False)
            end_of = dict(zip(np.flatnonzero(multiple).tolist(), ends.T))
            way_of = dict(zip(later.tolist(), np.moveaxis(through, -1, 0)))
            chain: list[int] = []
            for at in [*rank.tolist(), None]:
                if at is None or opens[at]:
                    self._join(chain, end_of, way_of, entry, last)
                    chain = []
                if at is not None:
                    chain.append(at)
            # A later run starts from the best scores at the end of the one before it.
            before = np.stack([entry[k] for k in later.tolist()], 1)
            state[:, later] = (before[:, None, :] + self.move[:, :, None]).max(0) + here[:, later]
        best = self._forward(score, begin, sizes, state, True)
        out = np.zeros((best.shape[0], len(order)), np.int8)
        label = np.zeros(len(order), np.int64)
        for t in range(best.shape[0] - 1, -1, -1):
            live = int(np.searchsorted(-sizes, -t, side="left"))  # runs longer than t
            fresh = int(np.searchsorted(-sizes, -(t + 1), side="left"))  # runs longer than t + 1
            if fresh < live:
                own = last[fresh:live]
                label[fresh:live] = np.where(own >= 0, own, best[t, :, fresh:live].argmax(0))
            if fresh:
                label[:fresh] = (best[t, :, :fresh].T + self.move.T[label[:fresh]]).argmax(1)
            out[t, :live] = label[:live]
        found = [np.empty(len(c), np.int8) for c in codes]
        for k, (n, a, b) in enumerate(zip(text.tolist(), low.tolist(), high.tolist())):
            found[n][a:b] = out[: b - a, k]
        return found

    @staticmethod
    def _join(chain: list[int], end_of: dict, way_of: dict, entry: dict, last: np.ndarray) -> None:
        """For the runs of one text: best scores before each, and the label that each ends in."""
        if len(chain) < 2:
            return
        best = end_of[chain[0]]
        for at in chain[1:]:
            entry[at] = best
            best = (best[:, None] + way_of[at]).max(0)
        label = int(best.argmax())
        for at in reversed(chain[1:]):
            last[at] = label
            label = int((entry[at] + way_of[at][:, label]).argmax())
        last[chain[0]] = label

    def spans(self, texts: list[str]) -> list[list[Span]]:
        """The field's spans in each text, by start."""
        out: list[list[Span]] = [[] for _ in texts]
        held: list[tuple[int, list[str], np.ndarray]] = []
        size = 0
        for k, text in enumerate(texts):
            pieces = _PIECE.findall(text)
            if pieces:
                held.append((k, pieces, self.codes(pieces)))
                size += len(pieces)
            if held and (size >= TOGETHER or k == len(texts) - 1):
                for (n, own, _), labels in zip(held, self.decode([c for _, _, c in held])):
                    out[n] = _spans(own, labels) if labels.any() else []
                held, size = [], 0
        return out


class _Codes(dict):
    def __init__(self, shapes: dict[str, int]):
        super().__init__()
        self.shapes = shapes

    def __missing__(self, piece: str) -> int:
        token = piece.lstrip()
        found = self.shapes.get(shape(token), 0) * 2 + (len(token) == len(piece))
        if len(piece) <= 64:
            self[piece] = found
        return found


def _shapes_of(name: str) -> list[str]:
    """The shapes that a feature's name holds; the sign | may be one itself."""
    body = name[name.index("|") + 1 :] if name[0] == "t" else name[1:]
    count = {"0": 1, "-": 2, "+": 2, "t": 1}.get(name[0], 3)
    found, rest = [], body
    for _ in range(count - 1):
        cut = rest.index("|", 1)
        found.append(rest[:cut])
        rest = rest[cut + 1 :]
    return [*found, rest]


def _spans(pieces: list[str], labels: np.ndarray) -> list[Span]:
    ends = list(accumulate(map(len, pieces)))
    out: list[list] = []
    open_span = None
    for k in np.flatnonzero(labels).tolist():
        name, end = LABELS[labels[k]], ends[k]
        if name[0] == "I" and open_span and open_span[0] == k - 1:
            out[-1][2] = end
        else:
            out.append([name[2:], end - len(pieces[k].lstrip()), end])
        open_span = (k,)
    return [tuple(s) for s in out]


@lru_cache(maxsize=1)
def reader() -> Reader:
    return Reader(field())


def find(texts: list[str | None], model: Reader) -> list[tuple[list[Span], list[Span]]]:
    """For each text its base spans, and all spans, by kind and start."""
    plain = [t or "" for t in texts]
    out = []
    for base, more in zip(map(base_spans, plain), model.spans(plain)):
        taken = sorted((a, b) for _, a, b in base)
        free, end = [], -1
        for span in more:
            if span[1] >= end and not any(a < span[2] and span[1] < b for a, b in taken):
                free.append(span)
                end = span[2]
        out.append((base, sorted(base + free, key=lambda s: (ORDER[s[0]], s[1]))))
    return out


def render(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span (overlapping ones together) replaced by its kind."""
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"<{kind.upper()}>"]
        end = max(end, b)
    return "".join(out) + text[end:]


def scan(docs: DataFrame) -> DataFrame:
    """See SCHEMA: counts and digest of base spans, and all spans."""
    model = field()

    def run(batches):
        reading = common.worker_memo("personal data", lambda: Reader(model))
        for batch in batches:
            found = find(batch.column(1).to_pylist(), reading)
            counts = [[sum(s[0] == kind for s in base) for base, _ in found] for kind in KINDS]
            digests = [hashlib.sha256(render(base).encode()).hexdigest() for base, _ in found]
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts)]
            columns += [pa.array(digests, pa.string()), pa.array([render(s) for _, s in found], pa.string())]
            columns.append(pa.array([len(s) for _, s in found], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                columns, names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"]
            )

    texts = common.small_batches(docs).selectExpr("cast(doc_id as long) as doc_id", "text")
    return texts.mapInArrow(run, SCHEMA)


def redact(docs: DataFrame) -> DataFrame:
    """doc_id, text, ... with the personal data in text masked; other columns as they are."""
    model, names = field(), docs.columns
    at = names.index("text")

    def run(batches):
        reading = common.worker_memo("personal data", lambda: Reader(model))
        for batch in batches:
            texts = batch.column(at).to_pylist()
            new = [None if t is None else mask(t, s) for t, (_, s) in zip(texts, find(texts, reading))]
            columns = batch.columns
            columns[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return common.small_batches(docs).mapInArrow(run, docs.schema)
