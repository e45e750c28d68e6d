"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent networks go forward and backward over all UTF-8 bytes of the
lower-cased text, and every byte gets a probability for each language. A text's
probability is the mean over its voting bytes: letters of ASCII, and bytes of all
other characters. A long text is read in spans of about SPAN bytes, each with MARGIN
bytes of what comes before and after it, from which the states start; every byte is
labelled once, with its own surroundings. Spans of a batch of texts are computed
together in numpy, of one length after another.

The network is trained on the driver by backpropagation through time, from a bounded
sample: about SAMPLE_DOCS labelled texts of each language and never more than twice
as many, chosen by a hash of doc_id and text, each by WINDOWS pieces of TRAIN_BYTES
bytes drawn from anywhere in it (a shorter text is one piece). Prediction reads the
text alone, all of it.

A null text or one without a letter is `und` with score 0, as is every text when
no labelled row exists. Ties go to the first language in code-point order.
Repeated rows get equal rows, rows without doc_id count like others; an empty table
gives none; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common

SAMPLE_DOCS = 300
WINDOWS, TRAIN_BYTES = 48, 48
HIDDEN = 12
SPAN, MARGIN = 256, 24
#: Spans that are computed together.
TOGETHER = 1536
STEPS = 300
BATCH = 128
RATE = 0.02
UNKNOWN = "und"
#: What stands where a span has no byte; it leaves a state as it is.
BLANK = 256

_LETTER = re.compile(r"[^\W\d_]")
_VOTES = np.array([chr(b).isalpha() if b < 128 else b < 256 for b in range(257)])


_ONE = np.eye(257, dtype=np.float32)


def encoded(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace")


def pieces(text: str) -> list[bytes]:
    """What training sees of a text: pieces from all over it, the same ones each time."""
    data = encoded(text)
    if len(data) <= TRAIN_BYTES:
        return [data] if data else []
    count = min(WINDOWS, -(-len(data) // TRAIN_BYTES))
    drawn = np.random.default_rng(zlib.crc32(data)).integers(0, len(data) - TRAIN_BYTES + 1, count)
    return [data[k : k + TRAIN_BYTES] for k in drawn.tolist()]


def _soft(x: np.ndarray) -> np.ndarray:
    """The network's squashing function, from -1 to 1: several times as cheap as tanh."""
    return x / (1 + np.abs(x))


def _direction(p: dict, side: str, ids: np.ndarray, mask: np.ndarray):
    """States of one direction over ids[n, t]; and what its gradient needs."""
    n, steps = ids.shape
    hidden = p["u" + side].shape[0]
    h, kept, out = np.zeros((n, hidden), np.float32), [None] * steps, np.zeros((steps, n, hidden), np.float32)
    uz, un = p["u" + side][:, : 2 * hidden], p["u" + side][:, 2 * hidden :]
    for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
        x = p["w" + side][ids[:, t]]
        gates = 0.5 + 0.5 * _soft(x[:, : 2 * hidden] + h @ uz)
        z, r = gates[:, :hidden], gates[:, hidden:]
        new = _soft(x[:, 2 * hidden :] + (r * h) @ un)
        m = mask[:, t, None]
        kept[t] = (h, z, r, new)
        h = h + m * (1 - z) * (new - h)
        out[t] = h
    return out, kept


def _direction_back(p: dict, g: dict, side: str, ids, mask, kept, grad) -> None:
    n, steps = ids.shape
    u = p["u" + side]
    hidden = u.shape[0]
    uz, un = u[:, : 2 * hidden], u[:, 2 * hidden :]
    back = np.zeros((n, hidden), np.float32)
    for t in range(steps - 1, -1, -1) if side == "f" else range(steps):
        h, z, r, new = kept[t]
        back = back + grad[t]
        m = mask[:, t, None]
        d_new = back * m * (1 - z) * (1 - np.abs(new)) ** 2
        d_z = back * m * (h - new) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
        through = d_new @ un.T
        d_r = through * h * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
        d_gates = np.concatenate([d_z, d_r], 1)
        g["w" + side] += _ONE[ids[:, t]].T @ np.concatenate([d_gates, d_new], 1)
        g["u" + side][:, : 2 * hidden] += h.T @ d_gates
        g["u" + side][:, 2 * hidden :] += (r * h).T @ d_new
        back = back * (1 - m * (1 - z)) + through * r + d_gates @ uz.T


@dataclass
class Network:
    """Weights p, and the languages in code-point order."""

    languages: list[str]
    p: dict

    @classmethod
    def train(cls, samples: list[tuple[str, list[bytes]]], seed: int = 7) -> Network | None:
        """From (language, pieces of a text) pairs."""
        rng = np.random.default_rng(seed)
        by: dict[str, list[bytes]] = {}
        for language, found in samples:
            by.setdefault(language, []).extend(p for p in found if _VOTES[np.frombuffer(p, np.uint8)].any())
        by = {k: v for k, v in sorted(by.items()) if v}
        if not by:
            return None
        languages = list(by)
        # Languages are drawn alike, however many texts each has.
        ids = [np.full((len(v), TRAIN_BYTES), BLANK, np.int64) for v in by.values()]
        for rows, found in zip(ids, by.values()):
            for row, data in zip(rows, found):
                row[: len(data)] = np.frombuffer(data, np.uint8)
        scale = 1 / np.sqrt(HIDDEN)
        shapes = {"wf": (257, 3 * HIDDEN), "wb": (257, 3 * HIDDEN), "uf": (HIDDEN, 3 * HIDDEN), "ub": (HIDDEN, 3 * HIDDEN)}
        shapes |= {"o": (2 * HIDDEN, len(languages)), "c": (len(languages),)}
        p = {k: (rng.standard_normal(s) * scale).astype(np.float32) for k, s in shapes.items()}
        net, first, second = cls(languages, p), {}, {}
        for step in range(1, STEPS + 1):
            want = rng.integers(0, len(languages), BATCH)
            pick = np.stack([ids[k][rng.integers(0, len(ids[k]))] for k in want])
            g = net._gradient(pick, (pick != BLANK).astype(np.float32), want)
            rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
            for k, d in g.items():
                first[k] = 0.9 * first.get(k, 0) + 0.1 * d
                second[k] = 0.99 * second.get(k, 0) + 0.01 * d * d
                p[k] -= (rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        for side in "fb":  # the update gate of a blank keeps the state
            p["w" + side][BLANK] = 0
            p["w" + side][BLANK, :HIDDEN] = 1e30
        return net

    def _gradient(self, ids, mask, want) -> dict:
        p = self.p
        g = {k: np.zeros_like(v) for k, v in p.items()}
        fwd, kept_f = _direction(p, "f", ids, mask)
        bwd, kept_b = _direction(p, "b", ids, mask)
        states = np.concatenate([fwd, bwd], 2)
        probs = self._softmax(states @ p["o"] + p["c"])
        probs[:, np.arange(len(want)), want] -= 1
        votes = _VOTES[ids] * mask
        probs *= (votes.T / max(1.0, votes.sum()))[:, :, None]
        g["o"] += np.einsum("tnh,tnl->hl", states, probs)
        g["c"] += probs.sum((0, 1))
        back = probs @ p["o"].T
        hidden = p["uf"].shape[0]
        _direction_back(p, g, "f", ids, mask, kept_f, back[:, :, :hidden])
        _direction_back(p, g, "b", ids, mask, kept_b, back[:, :, hidden:])
        return g

    @staticmethod
    def _softmax(x: np.ndarray) -> np.ndarray:
        e = np.exp(x - x.max(-1, keepdims=True))
        return e / e.sum(-1, keepdims=True)

    def _states(self, side: str, ids: np.ndarray):
        """(t, states of one direction there) over ids[t, n]."""
        w, u = self.p["w" + side], self.p["u" + side]
        hidden = u.shape[0]
        gate_w, new_w = np.ascontiguousarray(w[:, : 2 * hidden]), np.ascontiguousarray(w[:, 2 * hidden :])
        gate_u, new_u = np.ascontiguousarray(u[:, : 2 * hidden]), np.ascontiguousarray(u[:, 2 * hidden :])
        h = np.zeros((ids.shape[1], hidden), np.float32)
        for t in range(len(ids)) if side == "f" else range(len(ids) - 1, -1, -1):
            gates = h @ gate_u
            gates += gate_w.take(ids[t], 0)
            size = np.abs(gates)
            size += 1
            gates /= size
            gates *= 0.5
            gates += 0.5
            new = (gates[:, hidden:] * h) @ new_u
            new += new_w.take(ids[t], 0)
            size = np.abs(new)
            size += 1
            new /= size
            h -= new
            h *= gates[:, :hidden]
            h += new
            yield t, h

    def labels(self, ids: np.ndarray) -> np.ndarray:
        """Probabilities [t, n, language] of every byte of ids[t, n]."""
        hidden, o = self.p["uf"].shape[0], self.p["o"]
        out = np.empty((*ids.shape, len(self.languages)), np.float32)
        for t, h in self._states("f", ids):
            np.matmul(h, o[:hidden], out=out[t])
        for t, h in self._states("b", ids):
            out[t] += h @ o[hidden:]
        out += self.p["c"]
        out -= out.max(2, keepdims=True) if len(self.languages) > 8 else 0
        np.exp(np.clip(out, -80, 80, out=out), out=out)
        out /= (out @ np.ones(len(self.languages), np.float32))[:, :, None]
        return out

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """For each text the sum of its voting bytes' probabilities, [n, languages]."""
        sizes = np.array([len(t) for t in texts], np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        counts = -(-sizes // SPAN)
        text = np.repeat(np.arange(len(texts)), counts)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
        own, begin = sizes[text], (np.cumsum(sizes) - sizes)[text]
        low, high = own * nth // counts[text], own * (nth + 1) // counts[text]
        first, last = np.maximum(0, low - MARGIN), np.minimum(own, high + MARGIN)
        total = np.zeros((len(texts), len(self.languages)))
        order = np.argsort(last - first, kind="stable")
        for at in range(0, len(order), TOGETHER):
            pick = order[at : at + TOGETHER]
            place = first[pick] + np.arange(int((last - first)[pick].max()))[:, None]
            there = place < last[pick]
            ids = np.where(there, data[np.minimum(begin[pick] + place, len(data) - 1)], np.int64(BLANK))
            votes = (_VOTES[ids] & (place >= low[pick]) & (place < high[pick])).astype(np.float32)
            np.add.at(total, text[pick], np.einsum("tnl,tn->nl", self.labels(ids), votes))
        return total

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        spoken = [bool(t and _LETTER.search(t)) for t in texts]
        totals = iter(self.pooled([encoded(t) for t, s in zip(texts, spoken) if s]))
        out = []
        for s in spoken:
            total = next(totals) if s else None
            if total is None or not total.sum() > 0:
                out.append((UNKNOWN, 0.0))
                continue
            best = int(total.argmax())
            out.append((self.languages[best], min(1.0, float(total[best] / total.sum()))))
        return out


def fit(labelled: DataFrame) -> Network | None:
    """Train on doc_id, text, lang rows; which rows may be learnt from is the caller's choice."""
    rows = labelled.filter("lang is not null and text is not null").select("text", "lang", F.xxhash64("doc_id", "text").alias("place"))
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    keep: Column = F.lit(False)
    for language, count in sorted(counts.items()):
        share = min(1.0, SAMPLE_DOCS / count)
        keep = keep | ((F.col("lang") == language) & (F.pmod("place", F.lit(1 << 30)) <= int(share * (1 << 30))))
    # Copies of one text don't fill the sample.
    some = rows.filter(keep).dropDuplicates(["lang", "text"])
    nth = Window.partitionBy("lang").orderBy("place", "text")
    some = some.withColumn("nth", F.row_number().over(nth)).filter(F.col("nth") <= 2 * SAMPLE_DOCS).select("lang", "place", "text")

    def cut(batches):
        for batch in batches:
            found = [pieces(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.binary()))], names=["lang", "place", "pieces"]
            )

    sample = some.mapInArrow(cut, "lang string, place long, pieces array<binary>").collect()
    return Network.train([(r.lang, [bytes(p) for p in r.pieces]) for r in sorted(sample, key=lambda r: (r.lang, r.place))])


def predict(docs: DataFrame, net: Network | None, columns: list[str]) -> DataFrame:
    """The named columns of docs with lang_pred and score."""
    names = [*columns, *({"text"} - set(columns))]
    kept, at = common.small_batches(docs).select(*names), names.index("text")
    schema = docs.select(*columns).schema.add("lang_pred", "string").add("score", "double")

    def run(batches):
        common.worker_memo("languages", dict)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = net.predict(texts) if net else [(UNKNOWN, 0.0)] * len(texts)
            more = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(
                batch.columns[: len(columns)] + more, names=[*columns, "lang_pred", "score"]
            )

    return kept.mapInArrow(run, schema)
