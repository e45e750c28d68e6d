"""Merging: one piece of bytes to token ids.

Three kinds of vocabulary: by rank (two neighbours merge if their joined bytes are a
token, lowest id first), by pair (only listed splits merge, in list order), and by
character (as by pair, but merging starts from characters, and a character without
a token falls back to its bytes). In each the leftmost of equal merges is first.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

#: A rank that no token has: these neighbours never merge.
_NEVER = 1 << 40
Pairs = dict[tuple[int, int], tuple[int, int]]


def rank_merger(ranks: dict[bytes, int]) -> Callable[[bytes], list[int]]:
    """merge_ranks over one vocabulary. Short pieces of a vocabulary that has every byte go
    to tiktoken's compiled merge where that is installed; it gives the same ids."""
    try:
        from tiktoken import _tiktoken
    except ImportError:
        return lambda piece: merge_ranks(piece, ranks)
    if any(bytes([b]) not in ranks for b in range(256)) or len(set(ranks.values())) < len(ranks):
        return lambda piece: merge_ranks(piece, ranks)
    quick = _tiktoken.CoreBPE(ranks, {}, ".").encode_single_piece
    return lambda piece: quick(piece) if len(piece) <= 64 else merge_ranks(piece, ranks)


def merge_ranks(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece under a rank vocabulary."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if len(piece) > 64:
        return _merge_ranks_heap(piece, ranks)
    known, last = ranks.get, len(piece)
    # Borders of the parts, and the rank of each two neighbours' joined bytes.
    borders = list(range(last + 1))
    weights = [known(piece[k : k + 2], _NEVER) for k in range(last - 1)]
    while weights:
        best = min(weights)
        if best == _NEVER:
            break
        at = weights.index(best)
        del borders[at + 1], weights[at]
        if at < len(weights):
            weights[at] = known(piece[borders[at] : borders[at + 2]], _NEVER)
        if at:
            weights[at - 1] = known(piece[borders[at - 1] : borders[at + 1]], _NEVER)
    return [ranks[piece[a:b]] for a, b in zip(borders, borders[1:])]


def _merge_ranks_heap(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(piece)
    end, left = list(range(1, n + 1)), list(range(-1, n))
    heap = [(r, k, k + 2) for k in range(n - 1) if (r := ranks.get(piece[k : k + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, k, stop = heapq.heappop(heap)
        middle = end[k]
        if middle <= 0 or middle >= n or end[middle] != stop:
            continue
        end[k], end[middle] = stop, -1
        if stop < n:
            left[stop] = k
            if (r := ranks.get(piece[k : end[stop]])) is not None:
                heapq.heappush(heap, (r, k, end[stop]))
        if k and (r := ranks.get(piece[left[k] : stop])) is not None:
            heapq.heappush(heap, (r, left[k], stop))
    out, k = [], 0
    while k < n:
        out.append(ranks[piece[k : end[k]]])
        k = end[k]
    return out


def merge_pairs(symbols: list[int], pairs: Pairs) -> list[int]:
    """Ids left when listed pairs merge, first listed first."""
    n = len(symbols)
    ids, right, left = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(p[0], k, symbols[k], symbols[k + 1]) for k in range(n - 1) if (p := pairs.get((symbols[k], symbols[k + 1])))]
    heapq.heapify(heap)
    while heap:
        _, k, a, b = heapq.heappop(heap)
        j = right[k]
        if ids[k] != a or j >= n or ids[j] != b:
            continue
        ids[k], ids[j] = pairs[a, b][1], -1
        right[k] = right[j]
        if right[k] < n:
            left[right[k]] = k
            if p := pairs.get((ids[k], ids[right[k]])):
                heapq.heappush(heap, (p[0], k, ids[k], ids[right[k]]))
        if left[k] >= 0 and (p := pairs.get((ids[left[k]], ids[k]))):
            heapq.heappush(heap, (p[0], left[k], ids[left[k]], ids[k]))
    out, k = [], 0
    while k < n:
        out.append(ids[k])
        k = right[k]
    return out


def start_symbols(piece: bytes, singles: dict[bytes, int], by_character: bool) -> list[int]:
    """The ids that merging starts from."""
    if not by_character:
        return [singles[piece[k : k + 1]] for k in range(len(piece))]
    out = []
    for c in piece.decode("utf-8", "surrogateescape"):
        data = c.encode("utf-8", "surrogateescape")
        whole = singles.get(data)
        if whole is not None:
            out.append(whole)
        else:
            out += [singles[data[k : k + 1]] for k in range(len(data))]
    return out
