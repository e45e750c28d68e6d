"""Document fingerprints from prefix polynomial hashes.

The hash of a prefix is the sum of c[k] * B**k modulo the Mersenne prime 2**31 - 1,
for two bases at once, as arrays over all prefixes of a text. From them any two
spans are compared in constant time (their difference of prefixes, brought to
one power), and the longest common extension of two positions is found by
binary search.

A fingerprint is text: the length, the hash of the whole text under both bases,
and a sketch of all its spans of WINDOW code points. The text stands between
WINDOW - 1 blanks on either side, so a text of any size, shorter ones too, has spans,
and texts that begin or end alike share some: each span's hash, taken from the prefix
arrays, falls into one of SLOTS slots, which keeps its smallest value. The likeness
of two fingerprints is the share of slots that agree among those that either fills,
an estimate of the Jaccard similarity of the two sets of spans. Equal texts have
equal fingerprints, so their likeness is 1; two empty texts are alike.

The edited text of a document takes its second half from the next document in
ascending doc_id (ties by text, nulls first; after the last comes the first).
Documents are dealt to ranges of doc_id whose bounds are quantiles, and the
first document of a range is sent to the range before it too, so each range is
read as one sorted stream that holds two texts at a time. There are as many ranges
as keep RANGE_BYTES of text in each, and more executors' worth where that is fewer.

Null texts count as empty; repeated rows are rows of their own, next to each other;
a very long text costs memory in proportion, about 60 bytes a code point, in the one
task that holds it; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

PRIME = (1 << 31) - 1
#: Bases of the two hashes; any two numbers below the prime serve.
BASES = (911_382_323, 972_663_749)
WINDOW = 16
SLOTS = 64
#: Text of a range, on average.
RANGE_BYTES = 16 << 20
_P, _S = np.uint64(PRIME), np.uint64(31)
_POWERS: dict[int, np.ndarray] = {}
_INVERSES: dict[int, np.ndarray] = {}

SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, common_prefix long"
)


def _reduce(x: np.ndarray) -> np.ndarray:
    """Below the prime, for values below 2**62."""
    x = (x & _P) + (x >> _S)
    x = (x & _P) + (x >> _S)
    return np.where(x >= _P, x - _P, x)


def _powers(base: int, size: int, kept: dict[int, np.ndarray]) -> np.ndarray:
    """base**k for k < size, grown by doubling."""
    have = kept.get(base)
    if have is None:
        have = np.array([1], np.uint64)
    while len(have) < size:
        step = np.uint64(pow(base, len(have), PRIME))
        have = np.concatenate([have, _reduce(have * step)])
    kept[base] = have
    return have[:size]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class PrefixHash:
    """Prefix arrays of one text under both bases."""

    def __init__(self, points: np.ndarray, bases: tuple[int, ...] = BASES):
        self.size, self.bases = len(points), bases
        self.prefix = []
        for base in bases:
            terms = _reduce((points + np.uint64(1)) * _powers(base, self.size, _POWERS))
            total = np.zeros(self.size + 1, np.uint64)
            np.cumsum(terms, out=total[1:])
            self.prefix.append(_reduce(total))

    def whole(self) -> tuple[int, ...]:
        return tuple(int(p[-1]) for p in self.prefix)

    def span(self, start: int, size: int) -> tuple[int, ...]:
        """The span's hash, brought to power 0; equal spans have equal hashes."""
        out = []
        for base, prefix in zip(self.bases, self.prefix):
            gap = (int(prefix[start + size]) - int(prefix[start])) % PRIME
            out.append(gap * pow(base, -start, PRIME) % PRIME)
        return tuple(out)

    def windows(self, size: int) -> np.ndarray:
        """Hashes of all spans of one size, both bases in one 62-bit number. Spans may
        hang over either end of the text, where blanks stand, which add nothing."""
        count = self.size + size - 1 if self.size else 0
        out = np.zeros(count, np.uint64)
        for base, prefix in zip(self.bases, self.prefix):
            over = np.concatenate([np.zeros(size - 1, np.uint64), prefix, np.full(size - 1, prefix[-1])])
            gap = _reduce(over[size : size + count] + _P - over[:count])
            inverse = _powers(pow(base, -1, PRIME), count, _INVERSES)
            out = (out << _S) | _reduce(gap * inverse)
        return out

    def equal(self, start: int, other: PrefixHash, other_start: int, size: int) -> bool:
        return self.span(start, size) == other.span(other_start, size)

    def extension(self, start: int, other: PrefixHash, other_start: int) -> int:
        """Code points that both texts share from the two positions on."""
        low, high = 0, min(self.size - start, other.size - other_start)
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(start, other, other_start, middle):
                low = middle
            else:
                high = middle - 1
        return low


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketch(hashes: PrefixHash) -> np.ndarray:
    """The smallest mixed span hash of each slot, 32 bits; all ones where none fell."""
    mixed = _mix(hashes.windows(WINDOW))
    slots = np.full(SLOTS, 0xFFFFFFFF, np.uint32)
    np.minimum.at(slots, (mixed & np.uint64(SLOTS - 1)).astype(np.intp), (mixed >> np.uint64(32)).astype(np.uint32))
    return slots


def fingerprint(hashes: PrefixHash) -> str:
    head = f"{hashes.size:08x}" + "".join(f"{h:08x}" for h in hashes.whole())
    return head + sketch(hashes).astype(">u4").tobytes().hex()


def likeness(one: str, other: str) -> float:
    """Of two fingerprints, 0 to 1."""
    if one == other:
        return 1.0
    skip = 8 * (1 + len(BASES))
    a, b = (np.frombuffer(bytes.fromhex(x[skip:]), ">u4") for x in (one, other))
    filled = (a != 0xFFFFFFFF) | (b != 0xFFFFFFFF)
    return float(((a == b) & filled).sum() / max(1, filled.sum()))


def edit(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by the head of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _dealt(docs: DataFrame, ranges: int) -> DataFrame:
    """target, own, doc_id, text: each row in its range, firsts in the range before too."""
    ids = docs.select("doc_id")
    shares = [k / ranges for k in range(1, ranges)]
    bounds = sorted(set(ids.na.drop().approxQuantile("doc_id", shares, 0.5 / ranges))) if shares else []
    edges = np.array(bounds, np.float64)

    def place(keys) -> np.ndarray:
        known = np.array([-np.inf if k is None else k for k in keys], np.float64)
        return np.searchsorted(edges, known, side="right")

    def firsts(batches):
        least: dict[int, tuple] = {}
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, key, text in zip(place(keys).tolist(), keys, texts):
                order = (key is not None, key or 0)
                if at not in least or order < least[at][0]:
                    least[at] = (order, key)
        rows = [(at, key) for at, (_, key) in least.items()]
        yield pa.RecordBatch.from_pydict(
            {"at": pa.array([r[0] for r in rows], pa.int64()), "key": pa.array([r[1] for r in rows], pa.int64())}
        )

    one_each = docs.select("doc_id", F.lit(None).cast("string").alias("text")).mapInArrow(firsts, "at long, key long")
    # At most one row a range reaches the driver.
    heads = {r["at"]: r["key"] for r in one_each.groupBy("at").agg(F.expr("if(count(key) < count(1), null, min(key)) as key")).collect()}
    ranks = sorted(heads)
    before = {at: ranks[k - 1] for k, at in enumerate(ranks)}

    def deal(batches):
        for batch in batches:
            keys = batch.column(0).to_pylist()
            own = place(keys)
            target, is_own, take = list(own), [True] * len(own), list(range(len(own)))
            for k, (key, at) in enumerate(zip(keys, own.tolist())):
                if key == heads[at]:
                    take.append(k)
                    target.append(before[at])
                    is_own.append(False)
            rows = batch.take(pa.array(take))
            yield pa.RecordBatch.from_arrays(
                [pa.array(target, pa.int64()), pa.array(is_own), *rows.columns], names=["target", "own", "doc_id", "text"]
            )

    return docs.select("doc_id", "text").mapInArrow(deal, "target long, own boolean, doc_id long, text string")


def fingerprints(docs: DataFrame) -> DataFrame:
    """See SCHEMA; common_prefix is what text and edited text share from the start."""
    docs = common.small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    ranges = max(common.partitions(docs.sparkSession), -(-size // RANGE_BYTES))
    # Within a range: own rows in order, then the following range's first.
    streams = _dealt(docs, ranges).repartitionById(ranges, F.col("target").cast("int"))
    streams = streams.sortWithinPartitions("target", F.desc("own"), "doc_id", "text")

    def run(batches):
        held, rows = None, []

        def close(row, following):
            key, text, hashes, mark = row
            _, next_text, _, next_mark = following
            new = edit(text, next_text)
            new_hashes = PrefixHash(code_points(new))
            new_mark = fingerprint(new_hashes)
            rows.append(
                (key, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), mark, new_mark)
                + (likeness(mark, new_mark), likeness(mark, next_mark), hashes.extension(0, new_hashes, 0))
            )

        for batch in batches:
            for target, own, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                if not own and (held is None or held[0] != target):
                    continue
                hashes = PrefixHash(code_points(text))
                row = (key, text, hashes, fingerprint(hashes))
                if held is not None and held[0] == target:
                    close(held[1], row)
                held = (target, row) if own else None
            if rows:
                yield _batch(rows)
                rows = []

    return streams.mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
