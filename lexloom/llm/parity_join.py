"""Exact n-gram Jaccard links and components through parity sketches.

A document's set holds 64-bit hashes of its distinct word shingles. Two sets of
sizes a and b with Jaccard similarity of s or more differ in at most
D = (1 - s) / (1 + s) * (a + b) shingles. Every shingle belongs to one of m
segments (by its hash) and flips one bit of that segment's 64-bit word, so the
words form a parity sketch: each shingle in which two sets differ changes at most
one bit, and the Hamming distance of two sketches never exceeds the symmetric
difference. With m = D + 1 at least one segment of a linked pair is untouched,
so its key (XOR of the full hashes and the word) is equal in both.

Empty segments say nothing, so m is D + 1 + spare, where spare is about what a
set of the band's smallest size leaves empty: a linked pair then has more than
spare equal segments. If either set has at most spare empty ones, an equal
segment isn't empty. A set with more deals its shingles out again under another
seed, up to SEEDS times; of a linked pair either one has few empty segments under
a seed that both use, or both come to the last seed and emit the empty ones too.

Sizes are cut into bands; a set emits keys for its own band, and, if it is
large enough to link to a set of the next band, with that band's m too.

Equal sets are one class from the start, so copies are never paired, and groups
of classes that share a key are kept once where several keys gather the same.
Within a group the classes' whole-set parity sketches (two to four bits a shingle,
folded to one length) are compared; a pair whose Hamming distance is over D can't
be linked. First only a forest of the remaining pairs is verified on the sets
themselves, one pair for each two parts of a group that it would join. Then, in
groups where a pair of the forest failed, the pairs whose classes are still in
different components follow. No group's pairs
are listed when links already connect it. Groups over GROUP_MOST classes are cut
to blocks by hash: first each block with the group's smallest class, later, if
the group isn't one component, each two blocks.

Only (key, class) rows are shuffled for the search, 16 bytes each, and sketches of
classes that share a key; the texts of pairs to verify are read once more. Components come from iterated
minimum labels with pointer jumping.

Null or wordless texts have an empty set and link with nothing. Texts of fewer
words than a shingle are one shingle. A row is known by its doc_id and text, so rows
without an id, and different texts under one id, are compared like others. A
component is named by its smallest doc_id; a component without any has a null name.
Very long texts cost memory in proportion, in one task. An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

#: Dealings of shingles to segments before empty segments count as keys.
SEEDS = 4
#: Sizes of a band, largest by smallest.
BAND = 1.5
#: Rows of doc_ids that may be broadcast (16 bytes each); above it they are shuffled.
BROADCAST_ROWS = 500_000
#: Shingles whose keys a task that gathers groups holds, about (16 bytes a key).
GATHER_SHINGLES = 16_000_000
#: Classes of a group that are compared in one task, bits of a class's sketch for
#: each shingle (to the next power of two), and at least.
GROUP_MOST = 4096
SKETCH_BITS, SKETCH_LEAST = 2, 64
#: Classes that are compared with a pivot in one place.
PER_PIVOT = 512
#: Words whose hash a worker keeps (about 400 bytes each), and classes a task remembers
#: to have emitted.
MEMO_WORDS, MEMO_CLASSES = 60_000, 500_000

_U = np.uint64
# Fixed odd multipliers of the public SplitMix64 mixer.
_M1, _M2, _GOLD = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Rule:
    """Words of a shingle, and the similarity as a fraction num / den."""

    words: int = 5
    num: int = 80
    den: int = 100

    def most(self, both: float) -> int:
        """Largest symmetric difference of linked sets whose sizes sum to both."""
        return int((self.den - self.num) * both / (self.den + self.num) + 1e-9)


def mix(x: np.ndarray) -> np.ndarray:
    x = x + _GOLD
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    import xxhash

    # Over bytes, lower() and split() know A-Z and the six ASCII white spaces only.
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    memo = common.worker_memo("word hashes", dict)
    if len(memo) > MEMO_WORDS:
        memo.clear()
    try:
        each = list(map(memo.__getitem__, found))
    except KeyError:
        for w in set(found).difference(memo):
            memo[w] = xxhash.xxh64_intdigest(w)
        each = list(map(memo.__getitem__, found))
    h = np.array(each, np.uint64)
    size = min(words, len(h))
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out *= _M1
        out += h[k : k + n]
    out = mix(out)
    out.sort()
    return out[np.r_[True, out[1:] != out[:-1]]]


def identity(grams: np.ndarray) -> int:
    """A set's 63-bit name, from two sums of its hashes mixed differently."""
    if not len(grams):
        return -1
    with np.errstate(over="ignore"):
        one = mix(grams).sum(dtype=np.uint64)
        two = np.bitwise_xor.reduce(mix(grams ^ _M1))
    return int(mix(np.array([one ^ mix(np.array([two + _U(len(grams))], np.uint64))[0]], np.uint64))[0] >> _U(1))


def band_of(size: int) -> int:
    """Bands are [BAND ** k, BAND ** (k + 1))."""
    k = int(np.log(size) / np.log(BAND))
    while BAND ** (k + 1) <= size:
        k += 1
    while BAND**k > size:
        k -= 1
    return k


def bands(size: int, rule: Rule) -> list[tuple[int, int]]:
    """(band, most differences) under which a set of this size emits keys."""
    own = band_of(size)
    high = BAND ** (own + 1)
    found = [(own, rule.most(2 * high))]
    if size * rule.den >= rule.num * high:
        found.append((own + 1, rule.most(2 * BAND ** (own + 2))))
    return found


@lru_cache(maxsize=None)
def layout(band: int, most: int) -> tuple[int, int]:
    """(segments, spare) of a band: spare is what the band's smallest sets leave empty
    on average and a standard deviation more. Sets of a few shingles leave more
    empty than any spare; theirs is the one that falls short by least."""
    spare, least = 0, math.inf
    while True:
        segments = most + 1 + spare
        empty = segments * math.exp(-(BAND**band) / segments)
        short = empty + math.sqrt(empty) - spare
        if short >= least:
            return segments - 1, spare - 1
        if short <= 0:
            return segments, spare
        spare, least = spare + 1, short


def sketch(grams: np.ndarray, segments: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segments that hold shingles, their parity words, their XOR of hashes)."""
    mixed = mix(grams ^ _U(segments + (seed << 32)))
    at = (mixed >> _U(32)) % _U(segments)
    order = np.argsort(at, kind="stable")
    at, mixed = at[order], mixed[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    bits = _U(1) << (mixed & _U(63))
    return at[first], np.bitwise_xor.reduceat(bits, first), np.bitwise_xor.reduceat(mixed, first)


def parity(grams: np.ndarray) -> bytes:
    """The whole set's parity sketch, its length a power of two of bits."""
    bits = max(SKETCH_LEAST, 1 << (SKETCH_BITS * len(grams) - 1).bit_length())
    count = np.bincount((mix(grams) & _U(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((count & 1).astype(np.uint8), bitorder="little").tobytes()


def fold(sketch_bytes: bytes, words: int) -> np.ndarray:
    """A parity sketch brought to so many 64-bit words: halves are XORed."""
    found = np.frombuffer(sketch_bytes, np.uint64)
    while len(found) > words:
        found = found[: len(found) // 2] ^ found[len(found) // 2 :]
    return found


def near(sketches: np.ndarray, sizes: np.ndarray, k: int, others: np.ndarray, rule: Rule) -> np.ndarray:
    """Which of the others the sketches and sizes allow to link to class k, and how far they are."""
    far = np.bitwise_count(sketches[others] ^ sketches[k]).sum(1, dtype=np.int64)
    both = sizes[others] + sizes[k]
    low, high = np.minimum(sizes[others], sizes[k]), np.maximum(sizes[others], sizes[k])
    allowed = (far * (rule.den + rule.num) <= (rule.den - rule.num) * both) & (low * rule.den >= rule.num * high)
    return np.where(allowed, far, -1)


def keys(grams: np.ndarray, rule: Rule) -> np.ndarray:
    """All join keys of a set, each a hash of band, seed, segment, word and XOR."""
    out = []
    for band, most in bands(len(grams), rule):
        segments, spare = layout(band, most)
        for seed in range(SEEDS):
            space = _U((band + 1) * SEEDS + seed) << _U(40)
            where, word, xor = sketch(grams, segments, seed)
            out.append(mix(mix(where ^ space) ^ mix(word ^ mix(xor))))
            if segments - len(where) <= spare:
                break
        else:
            empty = np.setdiff1d(np.arange(segments, dtype=np.uint64), where)
            out.append(mix(mix(empty ^ space) ^ _M2))
    return np.concatenate(out).view(np.int64)


def linked(a: np.ndarray, b: np.ndarray, rule: Rule) -> bool:
    """Whether two sorted sets reach the similarity, counted exactly."""
    if min(len(a), len(b)) * rule.den < rule.num * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return rule.den * both >= rule.num * (len(a) + len(b) - both)


def classes(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, place, n_shingles, node, sketch: equal sets have equal nodes, empty ones -1;
    place is a hash of the text."""

    def run(batches):
        for batch in batches:
            sizes, nodes, sketches = [], [], []
            for text in batch.column(2).to_pylist():
                grams = shingles(text, rule.words)
                sizes.append(len(grams))
                nodes.append(identity(grams))
                sketches.append(parity(grams) if len(grams) else b"")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sketches, pa.binary())],
                names=["doc_id", "place", "n_shingles", "node", "sketch"],
            )

    shape = "doc_id long, place long, n_shingles long, node long, sketch binary"
    return docs.select("doc_id", "place", "text").mapInArrow(common.tidy(run), shape)


def _groups(docs: DataFrame, rule: Rule, parts: int) -> DataFrame:
    """key, node: the members of each group of classes that share a key, equal groups once."""

    def emit(batches):
        seen: set[int] = set()
        for batch in batches:
            all_keys, nodes, counts = [], [], []
            for text in batch.column(0).to_pylist():
                grams = shingles(text, rule.words)
                node = identity(grams)
                if node < 0 or node in seen:
                    continue
                if len(seen) < MEMO_CLASSES:
                    seen.add(node)
                found = keys(grams, rule)
                all_keys.append(found)
                nodes.append(node)
                counts.append(len(found))
            if nodes:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(all_keys)), pa.array(np.repeat(np.array(nodes, np.int64), counts))],
                    names=["key", "node"],
                )

    def gather(batches):
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not parts:
            return
        key = np.concatenate([p[0] for p in parts])
        node = np.concatenate([p[1] for p in parts])
        del parts
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        once = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
        key, node = key[once], node[once]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        # A group's name: the sum of its members' mixed names.
        names = np.add.reduceat(mix(node.view(np.uint64)), starts).view(np.int64)
        keep = sizes > 1
        keep[keep] &= np.isin(np.arange(keep.sum()), np.unique(names[keep], return_index=True)[1])
        rows = np.repeat(keep, sizes)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(names, sizes)[rows]), pa.array(node[rows])], names=["key", "node"]
        )

    emitted = docs.select("text").mapInArrow(common.tidy(emit), "key long, node long")
    return emitted.repartition(parts, "key").mapInArrow(common.tidy(gather), "key long, node long").distinct()


def _forest(members: DataFrame, rule: Rule, every: bool) -> DataFrame:
    """place, pivot, node: pairs of classes in one place that their sketches let link.

    Columns of members: place, other (a number for each task of a group), node, label,
    n_shingles, sketch. Only pairs of different labels; if not every one, then one
    for each two parts of the place that they join.
    """

    def compare(node, label, sizes, raw):
        words = min(map(len, raw)) // 8
        sketches = np.stack([fold(r, words) for r in raw])
        part = np.unique(label, return_inverse=True)[1]
        for k in range(1, len(node)):
            others = np.flatnonzero(part[:k] != part[k])
            if not len(others):
                continue
            far = near(sketches, sizes, k, others, rule)
            others, far = others[far >= 0], far[far >= 0]
            if not every and len(others):
                others = others[np.lexsort((others, far))]
                joined, first = np.unique(part[others], return_index=True)
                others = others[first]
                part[np.isin(part, joined)] = part[k]
            if len(others):
                yield node[others], node[k]

    def run(batches):
        """One sorted stream; a group that a batch breaks off waits for the next."""
        held: list[pa.RecordBatch] = []
        for batch in _with_end(batches):
            if batch is not None:
                held.append(batch)
                if batch.num_rows and held[0].num_rows and _same_group(held[0], batch):
                    continue
            if not held:
                continue
            table = pa.Table.from_batches(held)
            place, other, node, label, sizes = (table.column(c).to_numpy() for c in ("place", "other", "node", "label", "n_shingles"))
            raw = table.column("sketch").to_pylist()
            cuts = np.flatnonzero((place[1:] != place[:-1]) | (other[1:] != other[:-1])) + 1
            bounds = np.r_[0, cuts, len(place)]
            last = len(bounds) - 1 if batch is None else len(bounds) - 2
            places, pivots, nodes = [], [], []
            for a, b in zip(bounds[:last].tolist(), bounds[1 : last + 1].tolist()):
                if b - a > 1:
                    for found, own in compare(node[a:b], label[a:b], sizes[a:b], raw[a:b]):
                        pivots.append(found)
                        nodes.append(np.full(len(found), own))
                        places.append(np.full(len(found), place[a]))
            done = int(bounds[last])
            held = table.slice(done).combine_chunks().to_batches() if done < len(place) else []
            columns = [np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in (places, pivots, nodes)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["place", "pivot", "node"])

    parts = common.partitions(members.sparkSession)
    once = members.select("place", "other", "node", "label", "n_shingles", "sketch").repartition(parts, "place", "other")
    return once.sortWithinPartitions("place", "other", "node").mapInArrow(common.tidy(run), "place long, pivot long, node long")


def _with_end(batches):
    yield from batches
    yield None


def _same_group(first: pa.RecordBatch, batch: pa.RecordBatch) -> bool:
    """Whether all rows from the first held to this batch's last are of one group."""
    return all(first.column(c)[0] == batch.column(c)[batch.num_rows - 1] for c in (0, 1))


def _verify(pairs: DataFrame, named: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (pivot, node) that are links, written.

    named: node, and the doc_id and place of one of its rows. Every text asked for is read once more; its set goes to the pivot it is compared
    with. A pivot's own set goes to as many salted places as its nodes need.
    """
    counts = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / PER_PIVOT).alias("places"))
    salt = F.pmod(F.xxhash64("node"), F.col("places")).alias("salt")
    nodes = pairs.join(counts, "pivot").select("node", "pivot", salt, F.lit(1).alias("part"))
    heads = counts.select(
        F.col("pivot").alias("node"),
        "pivot",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("places") - 1)).alias("salt"),
        F.lit(0).alias("part"),
    )
    asked = common.cut(nodes.unionByName(heads).join(named, "node"), "asked")

    def sets(batches):
        for batch in batches:
            last, grams, own, keep, found = None, None, None, [], []
            for k, (text, node) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if grams is None or text != last:
                    last, grams = text, shingles(text, rule.words)
                    own = identity(grams)
                if own == node:  # another text may carry the same doc_id
                    keep.append(k)
                    found.append(grams.tobytes())
            rows = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*rows.columns[1:], pa.array(found, pa.binary())], names=["node", "pivot", "salt", "part", "grams"]
            )

    def compare(batches):
        head, held = None, None
        for batch in batches:
            pivots, nodes = [], []
            for node, pivot, salt, part, grams in zip(*(c.to_pylist() for c in batch.columns)):
                if part == 0:
                    head, held = (pivot, salt), np.frombuffer(grams, np.uint64)
                elif head == (pivot, salt) and linked(held, np.frombuffer(grams, np.uint64), rule):
                    pivots.append(pivot)
                    nodes.append(node)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pivots, pa.int64()), pa.array(nodes, pa.int64())], names=["pivot", "node"]
            )

    picked = ["text", "node", "pivot", "salt", "part"]
    known, unknown = asked.filter("doc_id is not null").drop("place"), asked.filter("doc_id is null").drop("doc_id")
    side = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    rows = docs.join(side, "doc_id").select(*picked)
    if not unknown.isEmpty():
        # Of rows without an id each text once.
        nameless = docs.filter("doc_id is null").groupBy("place").agg(F.min("text").alias("text"))
        rows = rows.unionByName(nameless.join(unknown, "place").select(*picked))
    shape = "node long, pivot long, salt long, part int, grams binary"
    dealt = rows.mapInArrow(common.tidy(sets), shape).repartition(common.partitions(docs.sparkSession), "pivot", "salt")
    found = dealt.sortWithinPartitions("pivot", "salt", "part").mapInArrow(compare, "pivot long, node long")
    found = common.cut(found, "links")
    common.forget(asked)
    return found


def components(links: DataFrame) -> DataFrame:
    """node, label (smallest node reachable) for all nodes of the links.

    Each round a node takes the smallest label among its neighbours and itself
    and then its label's label; a round's table is written before the next.
    """
    both = common.cut(
        links.select("pivot", "node").union(links.select(F.col("node"), F.col("pivot"))).toDF("a", "b").distinct(),
        "links",
    )
    labels = common.cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).toDF("node", "label"), "labels")
    while True:
        near = both.join(labels.toDF("b", "near"), "b").groupBy("a").agg(F.min("near").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("next")
        )
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("far"))
        moved = common.cut(
            step.join(jump, "next").select("node", "old", F.least("next", "far").alias("label")), "labels"
        )
        common.forget(labels)
        labels = moved.select("node", "label")
        if moved.filter("old <> label").isEmpty():
            common.forget(both)
            return labels


def linked_rows(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, place, node, label, n_shingles, component_id for every row of doc_id, place,
    text; node and label are null without words. label is equal in a component."""
    rows = common.cut(classes(docs, rule), "classes")
    sets = rows.filter("node >= 0").groupBy("node")
    # One row stands for its class: by id, or by text where no row has one.
    named = sets.agg(F.min("doc_id").alias("doc_id"), F.min("place").alias("place"))
    sketches = sets.agg(F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    size = sketches.agg(F.sum("n_shingles")).collect()[0][0] or 0
    groups = common.cut(_groups(docs, rule, max(common.partitions(docs.sparkSession), -(-size // GATHER_SHINGLES))), "groups")
    own = groups.withColumn("label", F.col("node"))
    forest = common.cut(_forest(_places(own, sketches, False), rule, every=False), "forest")
    tried = forest.select("pivot", "node").distinct()
    links = _verify(tried, named, docs, rule)
    labels = components(links)
    # Where all of a group's forest holds, whatever its sketches let link is linked already.
    broken = forest.join(links, ["pivot", "node"], "left_anti").select(F.col("place").alias("key"))
    large = groups.groupBy("key").count().filter(F.col("count") > GROUP_MOST).select("key")
    doubtful = groups.join(broken.union(large).distinct(), "key", "left_semi")
    apart = common.cut(_apart(doubtful, labels), "apart")
    if not apart.isEmpty():
        more = _forest(_places(apart, sketches, True), rule, every=True).select("pivot", "node").distinct()
        more = common.cut(more.join(tried, ["pivot", "node"], "left_anti"), "pairs")
        if not more.isEmpty():
            found = _verify(more, named, docs, rule)
            common.forget(labels)
            labels = components(links.union(found))
            common.forget(found)
        common.forget(more)
    for table in (apart, links, forest, groups):
        common.forget(table)
    found = named.select("node", "doc_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    best = found.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    found = found.join(best, "label").select("node", "label", "component_id")
    alone = rows.filter("node < 0").select(
        "doc_id", "place", F.lit(None).cast("long").alias("node"), F.lit(None).cast("long").alias("label"),
        "n_shingles", F.col("doc_id").alias("component_id"),
    )
    return rows.filter("node >= 0").drop("sketch").join(found, "node").select(*alone.columns).unionByName(alone)


def _keyed(docs: DataFrame) -> DataFrame:
    return common.small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("place"), "text")


def link_components(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    return linked_rows(_keyed(docs), rule).select("doc_id", "n_shingles", "component_id")


def _places(groups: DataFrame, sketches: DataFrame, crossed: bool) -> DataFrame:
    """The groups' members with sketches, dealt to tasks: `place` and `other`."""
    sizes = groups.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("least"))
    large = sizes.filter(F.col("size") > GROUP_MOST).withColumn("blocks", F.ceil(F.col("size") / (GROUP_MOST // 2)))
    dealt = groups.join(large, "key", "left").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    all_blocks = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    if crossed:
        low, high = F.least("block", F.col("x")), F.greatest("block", F.col("x"))
        spread = dealt.filter("blocks is not null").withColumn("x", F.explode(all_blocks))
        spread = spread.withColumn("other", low * F.col("blocks") + high)
    else:
        spread = dealt.filter("blocks is not null").withColumn(
            "other", F.explode(F.when(F.col("node") == F.col("least"), all_blocks).otherwise(F.array("block")))
        )
    small = dealt.filter("blocks is null").withColumn("other", F.lit(0).cast("long"))
    columns = [F.col("key").alias("place"), "other", "node", "label"]
    return small.select(*columns).unionByName(spread.select(*columns)).join(sketches, "node")


def _apart(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """key, node, label of the groups whose members are in several components."""
    known = groups.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = known.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    return known.join(mixed.select("key"), "key", "left_semi").select("key", "node", "label")


def keep_one(docs: DataFrame, rule: Rule) -> DataFrame:
    """The rows of docs that stay when one document of each component does.

    Of a component the row of smallest doc_id stays (rows without one come last, of
    several texts under one id that of smallest hash), and of rows equal in id and text
    any one. Rows without words are no copies; all stay.
    """
    found = common.cut(linked_rows(_keyed(docs), rule).filter("label is not null").drop("n_shingles"), "components")
    key = ["doc_id", "place"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "place"))
    stay = found.groupBy("label").agg(first.alias("stay")).select("stay.doc_id", "stay.place")
    counts = found.groupBy(*key).agg(F.count("*").alias("rows"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["place"] == b["place"])
    gone = common.cut(counts.join(stay, same(counts, stay), "left_anti").select(*key), "gone")
    twice = common.cut(counts.filter("rows > 1").join(gone, same(counts, gone), "left_anti").select(*key), "twice")
    # Whatever columns docs has, the keys beside them have other names.
    names = [f"column_{k}" for k in range(len(docs.columns))]
    at, text = names[docs.columns.index("doc_id")], names[docs.columns.index("text")]
    held = docs.toDF(*names).withColumns({"doc_id": F.col(at).cast("long"), "place": F.xxhash64(text)})

    def bounded(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table

    kept = held.join(bounded(gone), same(held, gone), "left_anti")
    if not twice.isEmpty():
        side = bounded(twice)
        once = kept.join(side, same(kept, twice), "left_semi").dropDuplicates(key)
        kept = kept.join(side, same(kept, twice), "left_anti").unionByName(once)
    return kept.select(*names).toDF(*docs.columns)
