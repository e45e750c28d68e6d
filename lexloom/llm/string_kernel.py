"""Toxicity by a support vector machine over a gap-weighted string kernel.

The kernel counts common subsequences of three letters of two words, each
weighted down by the length it spans in either word, so a word with foreign
letters inside stays near the word without them. A few landmark words give every
word a vector (Nyström: kernel values with the landmarks times the inverse root
of the landmarks' own kernel matrix), and a linear squared-hinge machine works
on these vectors.

Labels belong to whole texts. Training takes a text as a bag of words: words
of texts labelled 0 are negative, and of a text labelled 1 the word that the
machine rates highest is positive; machine and choice alternate. Positive words
are also learnt with letters inserted. A text's score is a logistic function of
its highest word, fitted on the bags.

Words are the white-space tokens of the lower-cased text, without what isn't a
letter; three or more single letters in a row are a word too. A word over WIDTH
letters is read in overlapping stretches, none is left out. A worker rates each
new token once, in numpy batches, and keeps the ratings.

Training reads a bounded sample: about SAMPLE_DOCS documents of each label and never
more than SAMPLE_MOST in all, chosen by a hash of doc_id, each by the distinct words
of its whole text; of several texts under one doc_id the one of smallest hash, of
several labels the largest. Scores come from the text alone. A null, empty or
wordless text has the score of the lowest word rating. Without labelled texts of both
kinds every score is 0. Repeated rows give equal rows, an empty table gives no row,
other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

SAMPLE_DOCS = 1500
SAMPLE_MOST = 4 * SAMPLE_DOCS
LANDMARKS_TOXIC, LANDMARKS_NEAR, LANDMARKS_OTHER = 48, 40, 40
ORDER = 3
DECAY = 0.6
WIDTH = 24
NEGATIVES, HARD = 6_000, 1_500
ROUNDS = 4
#: Standard deviations above chance from which a word is surely positive, may be positive
#: where its text has no better one, or is no negative: of n texts that hold a word, all
#: toxic by chance (as copies of one text are), sqrt(n) is reached where labels are even.
SURE, LIKELY, DOUBTFUL = 5.0, 3.5, 2.0
#: Times as large a share of toxic texts as of others must hold a word for either: words of
#: a language, or of long texts, that happen to be in more toxic texts stay below it.
LIFT = 4.0
#: Words of a text that stand out, on average over a word's toxic texts, at most.
CROWD = 20
RIDGE = 1e-4
MEMO_TOKENS = 600_000
#: Entries of a table of triples that is indexed directly; a larger one is searched.
TABLE_MOST = 1 << 22
LOWEST = -4.0

_NOT_LETTER = re.compile(r"[\W\d_]+")
_SPACED = re.compile(r"(?<!\S)[^\W\d_](?:[\W_]+[^\W\d_](?!\w)){2,}")


def tokens(text: str | None) -> list[str]:
    low = (text or "").lower()
    found = low.split()
    found += [m.group() for m in _SPACED.finditer(low)]
    return found


def units(token: str) -> list[str]:
    """The word of a token, in stretches that overlap by half if it is long."""
    word = _NOT_LETTER.sub("", token)
    if len(word) <= WIDTH:
        return [word] if word else []
    return [word[k : k + WIDTH] for k in range(0, len(word) - WIDTH // 2, WIDTH // 2)]


def words(text: str | None) -> list[str]:
    """A text's distinct words, sorted."""
    return sorted({u for t in tokens(text) for u in units(t)})


def bounded(word: str) -> str:
    """The word between marks of its ends, which count as letters."""
    return f"^{word}$"


def codes(words: list[str], width: int) -> np.ndarray:
    out = np.zeros((len(words), width), np.int32)
    for k, w in enumerate(words):
        out[k, : len(w)] = np.frombuffer(w.encode("utf-32-le", "replace"), np.int32)
    return out


def kernel(words: list[str], marks: list[str]) -> np.ndarray:
    """Gap-weighted subsequence kernel of every word with every mark, unnormalised."""
    words, marks = list(map(bounded, words)), list(map(bounded, marks))
    width = max(map(len, marks))
    mark = codes(marks, width)
    reach = np.tril(np.ones((width, width), np.float32), -1)
    for a in range(width):
        for b in range(a):
            reach[a, b] = DECAY ** (a - b - 1)
    shift, total = reach.T.copy(), np.zeros((len(words), len(marks)), np.float32)
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    for low in range(0, len(order), 64):
        pick = order[low : low + 64]
        s = codes([words[k] for k in pick], max(1, max(len(words[k]) for k in pick)))
        # ends[i][n, m, j]: common subsequences of i letters that end at mark letter j,
        # weighted by what they span so far in either word.
        ends = [np.zeros((len(pick), len(marks), width), np.float32) for _ in range(ORDER)]
        found = np.zeros((len(pick), len(marks)), np.float32)
        for c in range(s.shape[1]):
            same = ((s[:, c, None, None] == mark) & (mark != 0)).astype(np.float32) * np.float32(DECAY * DECAY)
            for i in range(ORDER - 1, 0, -1):
                grown = same * (ends[i - 1] @ shift)
                if i == ORDER - 1:
                    found += grown.sum(2)
                else:
                    ends[i] *= DECAY
                    ends[i] += grown
            ends[0] *= DECAY
            ends[0] += same
        total[pick] = found
    return total


def self_kernel(words: list[str]) -> np.ndarray:
    """Each word's kernel with itself."""
    words = list(map(bounded, words))
    out = np.zeros(len(words), np.float32)
    by: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by.setdefault(len(w), []).append(k)
    for size, all_picks in by.items():
        reach = np.zeros((max(1, size),) * 2, np.float32)
        for a in range(size):
            for b in range(a):
                reach[a, b] = DECAY ** (a - b - 1)
        shift = reach.T.copy()
        for low in range(0, len(all_picks), 512):
            pick = all_picks[low : low + 512]
            s = codes([words[k] for k in pick], max(1, size))
            ends = [np.zeros(s.shape, np.float32) for _ in range(ORDER)]
            for c in range(size):
                same = (s[:, c, None] == s).astype(np.float32) * np.float32(DECAY * DECAY)
                for i in range(ORDER - 1, 0, -1):
                    grown = same * (ends[i - 1] @ shift)
                    if i == ORDER - 1:
                        out[pick] += grown.sum(1)
                    else:
                        ends[i] *= DECAY
                        ends[i] += grown
                ends[0] *= DECAY
                ends[0] += same
    return out


@dataclass
class Machine:
    """The machine over landmarks, and the same function as one weight a letter triple.

    f(w) = sum over landmarks of a(m) k(w, m) / |w| + bias is linear in k, so what the
    landmarks weigh in all is a table over triples of letters, and a word is rated by its
    own gapped triples, however many landmarks there are.
    """

    marks: list[str]
    whiten: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def vectors(self, words: list[str]) -> np.ndarray:
        raw = kernel(words, self.marks) / self.scale
        own = np.sqrt(np.maximum(self_kernel(words), 1e-12))
        return (raw / own[:, None]) @ self.whiten

    def compress(self) -> None:
        """The table of triples; letters that no landmark has are one letter of weight 0."""
        letters = sorted({c for m in self.marks for c in bounded(m)})
        self.letter = {c: k + 1 for k, c in enumerate(letters)}
        size = self.size = len(letters) + 1
        share = (self.whiten @ self.weights) / self.scale
        found: dict[int, float] = {}
        for mark, weight in zip(self.marks, share.tolist()):
            at = [self.letter[c] for c in bounded(mark)]
            for i, j, k in combinations(range(len(at)), ORDER):
                triple = (at[i] * size + at[j]) * size + at[k]
                found[triple] = found.get(triple, 0.0) + weight * DECAY ** (k - i + 1)
        # Only triples that a landmark has are kept: their number doesn't grow with the alphabet.
        self.triples = np.array(sorted(found), np.int64)
        self.values = np.array([found[t] for t in self.triples.tolist()], np.float32)
        self.table = None
        if size**ORDER <= TABLE_MOST:
            self.table = np.zeros(size**ORDER, np.float32)
            self.table[self.triples] = self.values

    def weigh(self, triples: np.ndarray) -> np.ndarray:
        """The weight of each triple of letters, 0 for one that no landmark has."""
        if self.table is not None:
            return self.table[triples]
        at = np.minimum(np.searchsorted(self.triples, triples), len(self.triples) - 1)
        return np.where(self.triples[at] == triples, self.values[at], np.float32(0))

    def rate(self, words: list[str]) -> np.ndarray:
        """The machine's value for each word."""
        out, by = np.zeros(len(words)), {}
        for k, w in enumerate(words):
            by.setdefault(len(w), []).append(k)
        own = np.sqrt(np.maximum(self_kernel(words), 1e-12)) if words else out
        number = np.int32 if self.table is not None else np.int64
        for size, all_picks in by.items():
            i, j, k = (np.array(x) for x in zip(*combinations(range(size + 2), ORDER)))
            reach = (DECAY ** (k - i + 1)).astype(np.float32)
            step = max(1, 200_000 // len(i))
            for low in range(0, len(all_picks), step):
                pick = all_picks[low : low + step]
                at = np.array([[self.letter.get(c, 0) for c in bounded(words[p])] for p in pick], number)
                out[pick] = self.weigh((at[:, i] * self.size + at[:, j]) * self.size + at[:, k]) @ reach
        # A word of fewer letters than a subsequence has says nothing but where it ends.
        short = np.array([len(w) < ORDER for w in words], bool)
        return np.where(short, LOWEST, np.maximum(out / own + self.bias, LOWEST))

    def chance(self, rating: float) -> float:
        return float(1 / (1 + np.exp(-(self.slope * rating + self.shift))))

    @classmethod
    def train(cls, bags: list[tuple[int, str]], seed: int = 11) -> Machine | None:
        """From (label, text) pairs; None unless both labels occur."""
        return cls.train_words([(y, words(x)) for y, x in bags], seed)

    @classmethod
    def train_words(cls, bags: list[tuple[int, list[str]]], seed: int = 11) -> Machine | None:
        """From (label, distinct words) pairs."""
        rng = np.random.default_rng(seed)
        sets = _distinct(bags)
        good, bad = Counter(), Counter()
        for y, words in sets:
            (bad if y else good).update(words)
        n_bad, n_good = sum(y == 1 for y, _ in sets), sum(y == 0 for y, _ in sets)
        if not n_bad or not n_good or not bad or not good:
            return None
        every = sorted({w for _, words in sets for w in words})
        at = {w: k for k, w in enumerate(every)}
        toxic_in, all_in = (np.array([c[w] for w in every]) for c in (bad, good + bad))
        long_enough = np.array([len(w) >= ORDER for w in every])
        above = _above(sets, at, toxic_in, all_in)
        sure = np.flatnonzero((above >= SURE) & (toxic_in >= 3) & long_enough).tolist()
        order = np.lexsort((np.arange(len(every)), -above))
        top = [every[k] for k in order if toxic_in[k] >= 2 and long_enough[k] and above[k] >= LIKELY][:LANDMARKS_TOXIC]
        top = top or [every[k] for k in order[:LANDMARKS_TOXIC] if toxic_in[k]]
        calm = [k for k in range(len(every)) if good[every[k]] and above[k] < DOUBTFUL]
        if not calm:
            return None
        some = [every[k] for k in rng.choice(calm, min(len(calm), 4 * NEGATIVES // 2), replace=False)]
        likeness = (kernel(some, top) / np.sqrt(np.maximum(self_kernel(some), 1e-12))[:, None]).max(1)
        near = [some[k] for k in np.argsort(-likeness, kind="stable")[:LANDMARKS_NEAR]]
        marks = list(dict.fromkeys(top + near + some[:LANDMARKS_OTHER]))
        scale = np.sqrt(np.maximum(self_kernel(marks), 1e-12))
        gram = kernel(marks, marks) / scale / scale[:, None]
        values, basis = np.linalg.eigh(gram.astype(np.float64))
        whiten = (basis / np.sqrt(np.maximum(values, 1e-3))).astype(np.float32)
        net = cls(marks, whiten, scale.astype(np.float32), np.zeros(len(marks), np.float32))

        known: dict[int, np.ndarray] = {}

        def vectors(picks) -> np.ndarray:
            new = [k for k in picks if k not in known]
            if new:
                known.update(zip(new, net.vectors([every[k] for k in new])))
            return np.stack([known[k] for k in picks])

        negative = set(rng.choice(calm, min(len(calm), NEGATIVES), replace=False).tolist())
        guess, calm = above.copy(), np.array(calm)
        for _ in range(ROUNDS):
            chosen = [max((at[w] for w in words), key=lambda k: guess[k]) for y, words in sets if y and words]
            # Single words of wrongly labelled texts stand no further above chance than others.
            hits = Counter(k for k in chosen if above[k] >= LIKELY and long_enough[k])
            for k in sure:  # an insult that mostly stands beside a worse one weighs too
                hits[k] = max(hits[k], int(toxic_in[k]) // 4, 1)
            strong = sorted(hits) or sorted(set(chosen))
            hits.update(strong)
            spoilt = net.vectors([_spoil(every[k], rng) for k in strong for _ in range(3)])
            taken = sorted(negative.difference(strong))
            data = np.concatenate([vectors(strong), spoilt, vectors(taken)])
            y = np.r_[np.ones(len(strong) + len(spoilt)), -np.ones(len(taken))]
            counts = np.sqrt([hits[k] for k in strong])
            heavy = np.r_[counts / counts.sum(), 0.3 * np.repeat(counts, 3) / counts.sum() / 3]
            # A word of many clean texts would flag them all: it weighs by their number.
            clean = np.sqrt([good[every[k]] for k in taken])
            heavy = np.r_[heavy, 4.0 * clean / clean.sum()]
            net.weights, net.bias = _squared_hinge(data, y, heavy)
            net.compress()
            guess = net.rate(every)
            negative.update(calm[np.argsort(-guess[calm], kind="stable")[:HARD]].tolist())
        top_of = np.array([max((guess[at[w]] for w in words), default=LOWEST) for _, words in sets])
        net.slope, net.shift = _logistic(np.maximum(top_of, LOWEST), np.array([y for y, _ in sets]))
        return net


def _above(sets, at, toxic_in, all_in) -> np.ndarray:
    """How far above chance, in standard deviations, each word's texts are toxic.

    Where very many words of a text stand out (those of one source, say), each says
    little: words whose toxic texts hold more than CROWD such words fall to chance.
    """
    label = np.array([y for y, _ in sets])
    n_bad, n_good = int((label == 1).sum()), int((label == 0).sum())
    share = n_bad / (n_bad + n_good)
    above = (toxic_in - all_in * share) / np.sqrt(all_in * share * (1 - share))
    above = np.where(toxic_in / n_bad >= LIFT * (all_in - toxic_in) / n_good, above, np.minimum(above, 0.0))
    own = [np.array([at[w] for w in words], np.int64) if y else np.empty(0, np.int64) for y, words in sets]
    flat, text = np.concatenate(own), np.repeat(np.arange(len(own)), [len(o) for o in own])
    out = above[flat] >= LIKELY
    flat, text = flat[out], text[out]
    crowd = np.bincount(text, minlength=len(own))
    alone = np.bincount(flat, weights=1 / crowd[text], minlength=len(above)) / np.maximum(toxic_in, 1)
    return np.where((above >= LIKELY) & (alone * CROWD < 1), 0.0, above)


def _distinct(sets: list[tuple[int, list[str]]]) -> list[tuple[int, list[str]]]:
    """Bags without near copies of earlier ones of their label: copies of one wrongly
    labelled text would look like many. By 64 minima of hashed words."""
    import zlib

    kept, marks = [], {0: [], 1: []}
    mixers = np.random.default_rng(3).integers(1, 1 << 62, 64).astype(np.uint64) | np.uint64(1)
    for y, words in sets:
        if not words:
            kept.append((y, words))
            continue
        hashed = np.array([zlib.crc32(w.encode("utf-8", "replace")) + 1 for w in words], np.uint64)
        mark = ((hashed[:, None] * mixers) >> np.uint64(32)).min(0)
        if not marks[y] or (np.stack(marks[y]) == mark).mean(1).max() < 0.5:
            kept.append((y, words))
            marks[y].append(mark)
    return kept


def _spoil(word: str, rng) -> str:
    """The word with one or two letters inserted or one doubled."""
    out = list(word)
    for _ in range(int(rng.integers(1, 3))):
        k = int(rng.integers(1, max(2, len(out))))
        out.insert(k, chr(97 + int(rng.integers(0, 26))) if rng.random() < 0.6 else out[k - 1])
    return "".join(out)[:WIDTH]


def _squared_hinge(x: np.ndarray, y: np.ndarray, heavy: np.ndarray) -> tuple[np.ndarray, float]:
    """Newton steps on the primal; the last column is the bias."""
    x = np.c_[x.astype(np.float64), np.ones(len(x))]
    ridge = RIDGE * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(30):
        inside = y * (x @ w) < 1
        a, h = x[inside], heavy[inside]
        new = np.linalg.solve(ridge + (a * h[:, None]).T @ a, (a * (h * y[inside])[:, None]).sum(0))
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w[:-1].astype(np.float32), float(w[-1])


def _logistic(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    x, w = np.c_[f, np.ones(len(f))], np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (y - p) - 1e-3 * w)
        w = w + np.clip(step, -2, 2)
    return float(w[0]), float(w[1])


class Scorer:
    """Ratings of one worker, with its memo of tokens."""

    GROUP = 256

    def __init__(self, machine: Machine):
        self.machine = machine
        self.memo: dict[str, float] = {}

    def _learn(self, new: list[str]) -> None:
        words = [units(t) for t in new]
        distinct = sorted({u for w in words for u in w})
        rated = dict(zip(distinct, self.machine.rate(distinct).tolist()))
        self.memo.update((t, max((rated[u] for u in w), default=LOWEST)) for t, w in zip(new, words))

    def score(self, texts: list[str | None]) -> list[float]:
        out = []
        for low in range(0, len(texts), self.GROUP):
            found = [tokens(t) for t in texts[low : low + self.GROUP]]
            if len(self.memo) > MEMO_TOKENS:
                self.memo.clear()
            self._learn(list(set().union(*found).difference(self.memo)))
            rating = self.memo.__getitem__
            out += [self.machine.chance(max(map(rating, f), default=LOWEST)) for f in found]
        return out


def fit(docs: DataFrame, labels: DataFrame) -> Machine | None:
    """docs has doc_id, text; labels has doc_id, toxic and only rows to learn from."""
    marked = labels.filter("toxic in (0, 1) and doc_id is not null").select("doc_id", "toxic")
    counts = {r.toxic: r["count"] for r in marked.groupBy("toxic").count().collect()}
    share = {y: min(1.0, SAMPLE_DOCS / counts[y]) if y in counts else 0.0 for y in (0, 1)}
    bound = F.when(F.col("toxic") == 1, F.lit(int(share[1] * (1 << 30)))).otherwise(F.lit(int(share[0] * (1 << 30))))
    sample = marked.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) <= bound)
    sample = sample.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # At most SAMPLE_MOST rows of two numbers, whatever the table holds.
    sample = F.broadcast(sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_MOST))
    texts = docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = texts.join(sample, "doc_id").groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text")
    )

    def bags(batches):
        for batch in batches:
            found = [words(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))], names=["doc_id", "toxic", "words"]
            )

    rows = rows.select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text")
    found = rows.mapInArrow(bags, "doc_id long, toxic int, words array<string>").collect()
    return Machine.train_words([(r.toxic, r.words) for r in sorted(found, key=lambda r: r.doc_id)])


def predict(docs: DataFrame, machine: Machine | None, columns: list[str]) -> DataFrame:
    """The named columns of docs with score and predicted."""
    names = [*columns, *({"text"} - set(columns))]
    kept, at = common.small_batches(docs).select(*names), names.index("text")
    schema = docs.select(*columns).schema.add("score", "double").add("predicted", "integer")

    name = common.digest_of(machine)

    def run(batches):
        scorer = common.worker_memo(name, lambda: Scorer(machine)) if machine else None
        for batch in batches:
            texts = batch.column(at).to_pylist()
            scores = scorer.score(texts) if scorer else [0.0] * len(texts)
            more = [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays(
                batch.columns[: len(columns)] + more, names=[*columns, "score", "predicted"]
            )

    return kept.mapInArrow(run, schema)
