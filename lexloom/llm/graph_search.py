"""Approximate nearest neighbours: NN-descent in Spark joins, greedy graph search.

Nearness is the largest inner product. Equal vectors are one node, named by their
smallest vec_id, so copies never fill a neighbour list; results name all copies.

Building. Each node starts with the nearest of a few small random cells: random trees
of hyperplanes cut the space to eight cells, or more where they would hold more than
about Plan.cell nodes (split by hash where one is over Plan.cell_most). Then NN-descent: a node's sampled neighbours, forward
and reverse, new and old, are joined to it with their vectors, compared with each
other, and each of them keeps what beats its list. Rounds end when few entries
change. Vectors travel as one byte a component here, each with its own scale, so
large vectors take nothing from small ones; only the order of the lists depends on
that. A list's scores are inner products over its node's own scale.

Search. A query starts from the lists of its own node and keeps a beam of the best
nodes met. Each round the best unexpanded nodes go to their blocks, their neighbours
go on to theirs and are scored there, and what beats the beam comes back, until every
node of every beam is expanded. Queries travel as one byte a component too; at the end
the beams are scored once more from the original vectors in double precision.

Both live in joins on blocks of nodes, at most about BLOCK_ROWS each, by a hash
of the id: messages between queries and blocks carry ids, never whole blocks, and
no task holds more than a block. Tables of a finished round are deleted.

The hyperplanes' cut points come from a sample of about SAMPLE rows; every vector is indexed.
Recall against brute force is measured in the tests and the README.

Null ids or vectors, vectors with null or non-finite components, zero vectors
and vectors of another length than the commonest take no part. Of rows with one
vec_id the one with the smallest vector counts. An empty table gives no row;
other columns are ignored. Ties go to the smaller vec_id.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import common


BLOCK_ROWS, BLOCKS_LEAST = 8192, 6


@dataclass(frozen=True)
class Plan:
    """Sizes of the graph and the search. Rounds and steps are bounds against endless
    loops; both end earlier, when lists settle and beams are expanded."""

    neighbours: int = 32
    trees: int = 8
    cell: int = 768
    cell_most: int = 1536
    sampled: int = 14
    rounds: int = 16
    settled: float = 0.16
    reverse: int = 32
    beam: int = 192
    expand: int = 128
    steps: int = 64


SAMPLE = 4000
_NONE = np.empty(0, np.int64)
GRAPH = "blk long, node long, small binary, ids binary, scores binary, fresh binary, changed long"
LISTS = "blk long, node long, ids binary, scores binary"


def block_of(nodes: np.ndarray, blocks: int) -> np.ndarray:
    x = nodes.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(blocks)).astype(np.int64)


def _ints(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if len(column) else _NONE


def _table(columns: list, names: list[str], kinds: str) -> pa.Table:
    """kinds: one letter a column, of l(ong), d(ouble), b(inary)."""
    of = {"l": pa.int64(), "d": pa.float64(), "b": pa.binary()}
    return pa.table([pa.array(c, of[k]) for c, k in zip(columns, kinds)], names=names)


def _matrix(column, kind) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)


def _pack(vectors: np.ndarray, largest: float) -> list[bytes]:
    """One byte a component of each vector by its own largest one, after that one's float32
    share of the largest of all."""
    scale = np.abs(vectors).max(1)
    small = np.rint(vectors / scale[:, None] * 127).astype(np.int8)
    return [s.tobytes() + r.tobytes() for s, r in zip((scale / largest).astype(np.float32), small)]


def _unpack(column) -> tuple[np.ndarray, np.ndarray]:
    """Scales, and components from -127 to 127, of what _pack made."""
    raw = _matrix(column, np.int8)
    return np.ascontiguousarray(raw[:, :4]).view(np.float32)[:, 0], raw[:, 4:].astype(np.float32)


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts, and the end."""
    if not len(sorted_keys):
        return np.zeros(1, np.int64)
    return np.r_[0, np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, len(sorted_keys)]


def _best(owner: np.ndarray, other: np.ndarray, score: np.ndarray, flag: np.ndarray, most: int):
    """Of each owner the best distinct others, nearest first; of equal others a flag of 0 wins."""
    order = np.lexsort((flag, other, owner))
    owner, other, score, flag = owner[order], other[order], score[order], flag[order]
    keep = np.r_[True, (owner[1:] != owner[:-1]) | (other[1:] != other[:-1])] if len(owner) else np.zeros(0, bool)
    owner, other, score, flag = owner[keep], other[keep], score[keep], flag[keep]
    order = np.lexsort((other, -score, owner))
    owner, other, score, flag = owner[order], other[order], score[order], flag[order]
    starts = _runs(owner)
    place = np.arange(len(owner)) - np.repeat(starts[:-1], np.diff(starts))
    keep = place < most
    return owner[keep], other[keep], score[keep], flag[keep]


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, vec (double bytes) of the rows that take part."""

    def run(batches):
        for batch in batches:
            ids, out = [], []
            for key, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key is None or not values or any(x is None for x in values):
                    continue
                vector = np.array(values, np.float64)
                if np.isfinite(vector).all() and vector.any():
                    ids.append(key)
                    out.append((vector + 0.0).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "vec"])

    rows = embeddings.selectExpr("cast(vec_id as long) as vec_id", "embedding")
    rows = rows.mapInArrow(run, "vec_id long, vec binary").groupBy("vec_id").agg(F.min("vec").alias("vec"))
    rows = common.cut(rows, "vectors")
    sizes = rows.groupBy(F.length("vec").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    return rows.filter(F.length("vec") == sizes[0]["size"]) if sizes else rows


def _with_blocks(nodes: DataFrame, blocks: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array(block_of(_ints(batch.column(0)), blocks)), *batch.columns], names=["blk", "node", "vec"]
            )

    return nodes.mapInArrow(run, "blk long, node long, vec binary")


def _start(nodes: DataFrame, plan: Plan, count: int, blocks: int, scale: float) -> DataFrame:
    """LISTS of each node's nearest in its cells."""
    # A cell holds an eighth of the nodes at most, so the descent does its work at any size.
    bits = max(3 if count > 8 * plan.trees else 0, int(np.ceil(np.log2(max(1, count / plan.cell)))))
    share = min(1.0, SAMPLE / count)
    # About SAMPLE rows reach the driver, whatever the size of the table.
    picked = nodes.filter(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) <= int(share * (1 << 30))).select("vec").collect()
    sample = np.frombuffer(b"".join(r.vec for r in picked), np.float64).reshape(len(picked), -1) if picked else None
    if sample is None:
        bits = 0
    dims = sample.shape[1] if sample is not None else 0
    planes = [np.random.default_rng(t).standard_normal((dims, bits)) for t in range(plan.trees)] if bits else []
    cuts = [np.median(sample @ p, axis=0) for p in planes]

    def deal(batches):
        for batch in batches:
            vectors = _matrix(batch.column(1), np.float64)
            rows = pa.array(_pack(vectors, scale), pa.binary())
            for tree in range(max(1, len(planes))):
                cell = np.zeros(len(vectors), np.int64)
                if planes:
                    cell = ((vectors @ planes[tree] > cuts[tree]) @ (1 << np.arange(bits))).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell + (tree << 40)), batch.column(0), rows], names=["cell", "node", "small"]
                )

    def compare(table):
        ids, (scales, small) = _ints(table.column("node")), _unpack(table.column("small"))
        most = min(plan.neighbours, len(ids) - 1)
        if most < 1:
            return _table([[], [], [], []], ["blk", "node", "ids", "scores"], "llbb")
        near, best = [], []
        for low in range(0, len(ids), 512):
            gram = (small[low : low + 512] @ small.T) * scales
            gram[np.arange(len(gram)), np.arange(low, low + len(gram))] = -np.inf
            pick = np.argpartition(-gram, most - 1, axis=1)[:, :most]
            near += [r.tobytes() for r in ids[pick]]
            best += [r.tobytes() for r in np.take_along_axis(gram, pick, 1)]
        return _table([block_of(ids, blocks), ids, near, best], ["blk", "node", "ids", "scores"], "llbb")

    cells = nodes.select("node", "vec").mapInArrow(deal, "cell long, node long, small binary")
    large = cells.groupBy("cell").count().filter(F.col("count") > plan.cell_most)
    parts = F.ceil(F.col("count") / plan.cell_most)
    split = cells.join(large, "cell", "left").withColumn(
        "part", F.coalesce(F.pmod(F.xxhash64("node", "cell"), parts), F.lit(0).cast("long"))
    )
    return split.select("cell", "part", "node", "small").groupBy("cell", "part").applyInArrow(compare, LISTS)


def _merge(graph: DataFrame, lists: DataFrame, plan: Plan) -> DataFrame:
    """The graph with what of the lists beats its own; sampled entries are no longer fresh."""

    def run(held, offered):
        nodes = _ints(held.column("node"))
        order = np.argsort(nodes)
        small, names = held.column("small").to_pylist(), nodes[order]
        owners, others, scores, flags = [], [], [], []
        for k, (ids, best, fresh) in enumerate(
            zip(held.column("ids").to_pylist(), held.column("scores").to_pylist(), held.column("fresh").to_pylist())
        ):
            flag = np.frombuffer(fresh, np.int8).copy()
            flag[np.flatnonzero(flag)[: plan.sampled]] = 0
            owners.append(np.full(len(flag), nodes[k]))
            others.append(np.frombuffer(ids, np.int64))
            scores.append(np.frombuffer(best, np.float32))
            flags.append(flag)
        before = sum(map(len, others))
        own = before
        for node, ids, best in zip(
            offered.column("node").to_pylist(), offered.column("ids").to_pylist(), offered.column("scores").to_pylist()
        ):
            other = np.frombuffer(ids, np.int64)
            owners.append(np.full(len(other), node))
            others.append(other)
            scores.append(np.frombuffer(best, np.float32))
            flags.append(np.full(len(other), 2, np.int8))
        owner, other, score, flag = (np.concatenate(x) if x else _NONE for x in (owners, others, scores, flags))
        owner, other, score, flag = _best(owner, other, score, flag, plan.neighbours)
        starts = np.searchsorted(owner, names)
        ends = np.searchsorted(owner, names, side="right")
        rows = ([], [], [], [], [], [], [])
        blk = held.column("blk").to_pylist()
        for k, a, b in zip(order.tolist(), starts.tolist(), ends.tolist()):
            part = flag[a:b]
            values = (
                blk[k],
                int(nodes[k]),
                small[k],
                other[a:b].tobytes(),
                score[a:b].astype(np.float32).tobytes(),
                (part > 0).astype(np.int8).tobytes(),
                int((part == 2).sum()),
            )
            for column, value in zip(rows, values):
                column.append(value)
        return _table(list(rows), ["blk", "node", "small", "ids", "scores", "fresh", "changed"], "llbbbbl")

    return graph.groupBy("blk").cogroup(lists.groupBy("blk")).applyInArrow(run, GRAPH)


def _edges(graph: DataFrame, plan: Plan) -> DataFrame:
    """owner, member, fresh: the sampled entries of each list."""

    def run(batches):
        for batch in batches:
            owner, member, mark = [], [], []
            for node, ids, fresh in zip(*(batch.column(k).to_pylist() for k in range(3))):
                flag, other = np.frombuffer(fresh, np.int8), np.frombuffer(ids, np.int64)
                for value in (1, 0):
                    pick = np.flatnonzero(flag == value)[: plan.sampled]
                    owner.append(np.full(len(pick), node))
                    member.append(other[pick])
                    mark.append(np.full(len(pick), value))
            columns = [np.concatenate(x).astype(np.int64) if x else _NONE for x in (owner, member, mark)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["owner", "member", "fresh"])

    return graph.select("node", "ids", "fresh").mapInArrow(run, "owner long, member long, fresh long")


def _reversed(edges: DataFrame, slots: int) -> DataFrame:
    """owner, member, fresh the other way round, at most so many of each owner, evenly
    by hash: a node in everybody's list gathers no more than another."""
    slot = F.pmod(F.xxhash64("owner"), F.lit(slots)).alias("slot")
    found = edges.groupBy(F.col("member").alias("of"), "fresh", slot).agg(F.min("owner").alias("member"))
    return found.select(F.col("of").alias("owner"), "member", "fresh")


def _keyed(pairs: DataFrame, by: str, blocks: int) -> DataFrame:
    """The pairs with the block of one side."""
    names = pairs.columns
    at = names.index(by)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array(block_of(_ints(batch.column(at)), blocks)), *batch.columns], names=["blk", *names]
            )

    return pairs.mapInArrow(run, "blk long, " + ", ".join(f"{c} long" for c in names))


def _descend(graph: DataFrame, plan: Plan, blocks: int) -> DataFrame:
    """LISTS that one round of comparing neighbours of neighbours offers."""
    edges = _edges(graph, plan)
    members = edges.unionByName(_reversed(edges, plan.sampled))

    def attach(asked, held):
        nodes = _ints(held.column("node"))
        order = np.argsort(nodes)
        member = _ints(asked.column("member"))
        at = order[np.searchsorted(nodes[order], member)] if len(nodes) else _NONE
        small, scores = held.column("small").to_pylist(), held.column("scores").to_pylist()
        least = [
            float(np.frombuffer(s, np.float32)[-1]) if len(s) == 4 * plan.neighbours else -np.inf for s in scores
        ]
        owner = _ints(asked.column("owner"))
        return _table(
            [block_of(owner, blocks), owner, member, _ints(asked.column("fresh")), [small[k] for k in at], [least[k] for k in at]],
            ["blk", "owner", "member", "fresh", "small", "least"],
            "llllbd",
        )

    def compare(table):
        owner, member = _ints(table.column("owner")), _ints(table.column("member"))
        fresh, least = _ints(table.column("fresh")), table.column("least").to_numpy()
        scales, small = _unpack(table.column("small"))
        order = np.lexsort((-fresh, member, owner))
        keep = np.r_[True, (owner[order][1:] != owner[order][:-1]) | (member[order][1:] != member[order][:-1])]
        order = order[keep]
        order = order[np.lexsort((-fresh[order], owner[order]))]
        starts = _runs(owner[order])
        us, ws, ss = [], [], []
        for a, b in zip(starts[:-1], starts[1:]):
            rows = order[a:b]
            new = int(fresh[rows].sum())
            if not new or len(rows) < 2:
                continue
            vectors, scale, limit, ids = small[rows], scales[rows], least[rows], member[rows]
            products = vectors[:new] @ vectors.T
            gram = products * scale
            gram[np.arange(new), np.arange(new)] = -np.inf
            x, y = np.nonzero(gram > limit[:new, None])
            us.append(ids[x])
            ws.append(ids[y])
            ss.append(gram[x, y])
            back = products[:, new:] * scale[:new, None]
            x, y = np.nonzero(back > limit[None, new:])
            us.append(ids[new:][y])
            ws.append(ids[x])
            ss.append(back[x, y])
        if not us:
            return _table([[], [], [], []], ["blk", "node", "ids", "scores"], "llbb")
        u, w, s = np.concatenate(us), np.concatenate(ws), np.concatenate(ss)
        u, w, s, _ = _best(u, w, s, np.zeros(len(u), np.int8), plan.neighbours)
        starts = _runs(u)
        names = u[starts[:-1]]
        cut = list(zip(starts[:-1].tolist(), starts[1:].tolist()))
        return _table(
            [block_of(names, blocks), names, [w[a:b].tobytes() for a, b in cut], [s[a:b].astype(np.float32).tobytes() for a, b in cut]],
            ["blk", "node", "ids", "scores"],
            "llbb",
        )

    asked = _keyed(members, "member", blocks)
    held = graph.select("blk", "node", "small", "scores")
    joined = asked.groupBy("blk").cogroup(held.groupBy("blk")).applyInArrow(
        attach, "blk long, owner long, member long, fresh long, small binary, least double"
    )
    return joined.groupBy("blk").applyInArrow(compare, LISTS)


def build(nodes: DataFrame, plan: Plan, count: int, blocks: int) -> DataFrame:
    """blk, node, vec, links (int64 bytes: forward and reverse neighbours) of every node."""

    def highest(batches):
        most = max((float(np.abs(np.frombuffer(v, np.float64)).max()) for b in batches for v in b.column(0).to_pylist()), default=0.0)
        yield pa.RecordBatch.from_pydict({"most": [most]})

    scale = nodes.select("vec").mapInArrow(highest, "most double").agg(F.max("most")).collect()[0][0] or 1.0

    def empty(batches):
        for batch in batches:
            small = _pack(_matrix(batch.column(2), np.float64), scale)
            none = [b""] * len(small)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(small, pa.binary())]
                + [pa.array(none, pa.binary())] * 3
                + [pa.array(np.zeros(len(small), np.int64))],
                names=["blk", "node", "small", "ids", "scores", "fresh", "changed"],
            )

    graph = nodes.select("blk", "node", "vec").mapInArrow(empty, GRAPH)
    graph = common.cut(_merge(graph, _start(nodes, plan, count, blocks, scale), plan), "graph")
    for _ in range(plan.rounds):
        grown = common.cut(_merge(graph, _descend(graph, plan, blocks), plan), "graph")
        common.forget(graph)
        graph = grown
        changed = graph.agg(F.sum("changed")).collect()[0][0] or 0
        if changed < plan.settled * count * plan.neighbours:
            break

    def every(batches):
        for batch in batches:
            lists = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            owner = np.repeat(_ints(batch.column(0)), [len(x) for x in lists])
            member = np.concatenate(lists) if lists else _NONE
            yield pa.RecordBatch.from_arrays(
                [pa.array(owner), pa.array(member), pa.array(np.zeros(len(owner), np.int64))], names=["owner", "member", "fresh"]
            )

    edges = graph.select("node", "ids").mapInArrow(every, "owner long, member long, fresh long")
    back = _keyed(_reversed(edges, plan.reverse).select("owner", "member"), "owner", blocks)

    def finish(held, more):
        nodes_, order = _ints(held.column("node")), None
        owner, member = _ints(more.column("owner")), _ints(more.column("member"))
        order = np.argsort(owner, kind="stable")
        owner, member = owner[order], member[order]
        low, high = np.searchsorted(owner, nodes_), np.searchsorted(owner, nodes_, side="right")
        links = [
            np.union1d(np.frombuffer(ids, np.int64), member[a:b]).tobytes()
            for ids, a, b in zip(held.column("ids").to_pylist(), low, high)
        ]
        return _table([_ints(held.column("blk")), nodes_, links], ["blk", "node", "links"], "llb")

    linked = graph.select("blk", "node", "ids").groupBy("blk").cogroup(back.groupBy("blk")).applyInArrow(
        finish, "blk long, node long, links binary"
    )
    index = common.cut(linked.join(nodes.select("node", "vec"), "node").select("blk", "node", "vec", "links"), "index")
    common.forget(graph)
    return index


STATE = "kind long, blk long, qid long, vec binary, least double, ids binary, scores binary, done binary"
_STATE = ["kind", "blk", "qid", "vec", "least", "ids", "scores", "done"]
ASKED = "blk long, qid long, vec binary, least double, ids binary"


def _search(index: DataFrame, queries: DataFrame, plan: Plan, blocks: int) -> DataFrame:
    """qid, ids, scores: each query's beam. queries: qid, node, qvec.

    A query lives in the block of its qid, as a row of kind 0 with its whole vector. Rows
    of kind 1 carry ids to expand, the vector in small and the least score of a full beam.
    """

    def group(qid: int) -> int:
        return int(block_of(np.array([qid]), blocks)[0])

    def parted(qid, vec, least, ids) -> list[tuple]:
        """(block, qid, vec, least, ids) for each block of the ids."""
        at = block_of(ids, blocks)
        order = np.argsort(at, kind="stable")
        at, ids = at[order], ids[order]
        starts = _runs(at)
        return [(int(at[a]), qid, vec, least, ids[a:b].tobytes()) for a, b in zip(starts[:-1], starts[1:])]

    def asked_rows(rows: list[tuple]) -> pa.Table:
        return _table(list(zip(*rows)) if rows else [[]] * 5, ["blk", "qid", "vec", "least", "ids"], "llbdb")

    def state_rows(rows: list[tuple]) -> pa.Table:
        return _table(list(zip(*rows)) if rows else [[]] * 8, _STATE, "lllbdbbb")

    def outgoing(qid, vec, least, ids) -> list[tuple]:
        vector = np.frombuffer(vec, np.float64)[None]
        small = _pack(vector, float(np.abs(vector).max()))[0]
        return [(1, blk, qid, small, least, part, b"", b"") for blk, _, _, _, part in parted(qid, None, None, ids)]

    def begin(batches):
        for batch in batches:
            rows = []
            for qid, node, qvec in zip(*(c.to_pylist() for c in batch.columns)):
                own = np.array([node], np.int64)
                out = outgoing(qid, qvec, -np.inf, own)
                score = np.array([float(_like(out[0][3]) @ np.frombuffer(qvec, np.float64))])
                rows.append((0, group(qid), qid, qvec, -np.inf, own.tobytes(), score.tobytes(), b"\1"))
                rows += out
            yield from state_rows(rows).to_batches()

    def follow(asked, held):
        """The neighbours of the nodes that each query expands in this block, to their blocks."""
        nodes = _ints(held.column("node"))
        order = np.argsort(nodes)
        nodes, links = nodes[order], held.column("links").to_pylist()
        out = []
        for qid, vec, least, ids in zip(*(asked.column(c).to_pylist() for c in ("qid", "vec", "least", "ids"))):
            at = order[np.searchsorted(nodes, np.frombuffer(ids, np.int64))]
            out += parted(qid, vec, least, np.unique(np.frombuffer(b"".join([links[k] for k in at]), np.int64)))
        return asked_rows(out)

    def rate(asked, held):
        """Of the nodes each query asks about those that beat its beam, the best at most."""
        nodes = _ints(held.column("node"))
        order = np.argsort(nodes)
        vectors = _matrix(held.column("vec"), np.float64)[order] if len(nodes) else None
        nodes, by = nodes[order], {}
        for qid, vec, least, ids in zip(*(asked.column(c).to_pylist() for c in ("qid", "vec", "least", "ids"))):
            by.setdefault(qid, (vec, least, []))[2].append(ids)
        out = []
        for qid, (vec, least, parts) in by.items():
            wanted = np.unique(np.frombuffer(b"".join(parts), np.int64))
            scores = vectors[np.searchsorted(nodes, wanted)] @ _like(vec)
            good = np.flatnonzero(scores >= least)
            best = good[np.lexsort((wanted[good], -scores[good]))][: plan.beam]
            if len(best):
                out.append((group(qid), qid, wanted[best].tobytes(), scores[best].tobytes()))
        return _table(list(zip(*out)) if out else [[]] * 4, ["blk", "qid", "ids", "scores"], "llbb")

    def renew(state, rated):
        """The beam with what was scored; its best unexpanded nodes go out."""
        by: dict[int, list[tuple]] = {}
        for qid, ids, scores in zip(*(rated.column(c).to_pylist() for c in ("qid", "ids", "scores"))):
            by.setdefault(qid, []).append((ids, scores))
        rows = []
        for row in zip(*(state.column(c).to_pylist() for c in _STATE)):
            _, blk, qid, vec, least, ids, scores, done = row
            more = by.get(qid, [])
            node = np.concatenate([np.frombuffer(x, np.int64) for x in (ids, *(m[0] for m in more))])
            score = np.concatenate([np.frombuffer(x, np.float64) for x in (scores, *(m[1] for m in more))])
            flag = np.zeros(len(node), np.int8)
            flag[: len(done)] = np.frombuffer(done, np.int8)
            # A node already in the beam may be met again: its first place counts.
            first = np.sort(np.unique(node, return_index=True)[1])
            node, score, flag = node[first], score[first], flag[first]
            best = np.lexsort((node, -score))[: plan.beam]
            node, score, flag = node[best], score[best], flag[best]
            out = np.flatnonzero(flag == 0)[: plan.expand]
            flag[out] = 1
            least = float(score[-1]) if len(node) == plan.beam else -np.inf
            rows.append((0, blk, qid, vec, least, node.tobytes(), score.tobytes(), flag.tobytes()))
            rows += outgoing(qid, vec, least, node[out]) if len(out) else []
        return state_rows(rows)

    def exactly(asked, held):
        nodes = _ints(held.column("node"))
        order = np.argsort(nodes)
        nodes, vectors, out = nodes[order], held.column("vec").to_pylist(), []
        for qid, vec, ids in zip(*(asked.column(c).to_pylist() for c in ("qid", "vec", "ids"))):
            at = order[np.searchsorted(nodes, np.frombuffer(ids, np.int64))]
            out.append((qid, ids, _score(vec, [vectors[k] for k in at]).tobytes()))
        return _table(list(zip(*out)) if out else [[]] * 3, ["qid", "ids", "scores"], "lbb")

    def home(batches):
        for batch in batches:
            rows = [p for q, v, i in zip(*(c.to_pylist() for c in batch.columns)) for p in parted(q, v, 0.0, np.frombuffer(i, np.int64))]
            yield from asked_rows(rows).to_batches()

    links, vectors = index.select("blk", "node", "links"), index.select("blk", "node", "vec")
    state = common.cut(queries.select("qid", "node", "qvec").mapInArrow(begin, STATE), "beams")
    for _ in range(plan.steps):
        asked = state.filter("kind = 1").select("blk", "qid", "vec", "least", "ids")
        if asked.isEmpty():
            break
        met = asked.groupBy("blk").cogroup(links.groupBy("blk")).applyInArrow(follow, ASKED)
        rated = met.groupBy("blk").cogroup(vectors.groupBy("blk")).applyInArrow(
            rate, "blk long, qid long, ids binary, scores binary"
        )
        beams = state.filter("kind = 0")
        renewed = common.cut(beams.groupBy("blk").cogroup(rated.groupBy("blk")).applyInArrow(renew, STATE), "beams")
        common.forget(state)
        state = renewed
    last = state.filter("kind = 0").select("qid", "vec", "ids").mapInArrow(home, ASKED)
    return last.groupBy("blk").cogroup(vectors.groupBy("blk")).applyInArrow(exactly, "qid long, ids binary, scores binary")


def _score(vec: bytes, others: list[bytes]) -> np.ndarray:
    """Inner products in double precision, each the same wherever it is taken."""
    vector = np.frombuffer(vec, np.float64)
    return np.array([float(np.dot(vector, np.frombuffer(o, np.float64))) for o in others], np.float64)


def _like(small: bytes) -> np.ndarray:
    """A query's components from what travels of it, over its largest one."""
    return np.frombuffer(small, np.int8)[4:] / 127.0


def nearest(embeddings: DataFrame, is_query, most: int, plan: Plan = Plan()) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that the condition on vec_id picks,
    its nearest other rows."""
    plan = replace(plan, beam=max(plan.beam, 2 * (most + 1)))
    rows = usable(embeddings)
    # Of copies only as many as any query can name are kept, besides the query itself.
    first = Window.partitionBy("vec").orderBy("vec_id")
    ranked = rows.withColumn("copy", F.row_number().over(first))
    named = rows.groupBy("vec").agg(F.min("vec_id").alias("node"))
    count = named.count()
    blocks = max(BLOCKS_LEAST, -(-count // BLOCK_ROWS))
    nodes = common.cut(_with_blocks(named.select("node", "vec"), blocks), "nodes")
    copies = common.cut(
        ranked.filter(F.col("copy") <= most + 1).join(nodes.select("node", "vec"), "vec").select("node", "vec_id"), "copies"
    )
    index = build(nodes, plan, max(1, count), blocks)
    queries = rows.filter(is_query).join(nodes.select("node", "vec"), "vec").select(
        F.col("vec_id").alias("qid"), "node", F.col("vec").alias("qvec")
    )
    beams = _search(index, queries, plan, blocks)

    def unpack(batches):
        for batch in batches:
            lists = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            scores = [np.frombuffer(x, np.float64) for x in batch.column(2).to_pylist()]
            qid = np.repeat(_ints(batch.column(0)), [len(x) for x in lists])
            yield pa.RecordBatch.from_arrays(
                [pa.array(qid), pa.array(np.concatenate(lists) if lists else _NONE), pa.array(np.concatenate(scores) if scores else np.empty(0))],
                names=["query_id", "node", "score"],
            )

    found = beams.mapInArrow(unpack, "query_id long, node long, score double")
    found = found.join(copies, "node").filter("vec_id <> query_id")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most)
    return found.select("query_id", "rank", "vec_id", "score")
