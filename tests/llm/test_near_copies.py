import itertools
import random
import subprocess
import sys

import numpy as np
import pytest

from lexloom.llm import parity_join
from lexloom.llm.parity_join import Rule


def grams(text, k):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < k:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(rows, rule):
    sets = [grams(t, rule.words) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and rule.den * both >= rule.num * (len(sets[a]) + len(sets[b]) - both):
            parent[root(a)] = root(b)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), doc_id), doc_id)
    return {(rows[k][0], len(sets[k]), least[root(k)] if sets[k] else rows[k][0]) for k in range(len(rows))}


def corpus(seed, count=160):
    """Families of edited copies on both sides of the threshold, and a shared passage."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = " ".join(rng.choices(words, k=60))
    rows = []
    for doc_id in range(count):
        if rows and rng.random() < 0.6:
            text = rng.choice(rows)[1].split(" ")
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                text[rng.randrange(len(text))] = rng.choice(words)
            if rng.random() < 0.3:
                text = text[: max(1, len(text) - rng.randrange(12))]
            rows.append((doc_id, " ".join(text)))
        else:
            text = " ".join(rng.choices(words, k=rng.choice([1, 3, 5, 8, 20, 60, 200])))
            rows.append((doc_id, f"{passage} {text}" if rng.random() < 0.4 else text))
    return rows


@pytest.mark.parametrize("rule", [Rule(4, 85, 100), Rule(5, 80, 100)])
def test_components_are_those_of_brute_force(documents, rule):
    rows = corpus(rule.words)
    got = {tuple(r) for r in parity_join.link_components(documents(rows), rule).collect()}
    assert got == brute(rows, rule)


def test_large_groups_are_cut_to_blocks(documents, monkeypatch):
    monkeypatch.setattr(parity_join, "GROUP_MOST", 8)
    rule, rows = Rule(4, 85, 100), corpus(9, 90)
    got = {tuple(r) for r in parity_join.link_components(documents(rows), rule).collect()}
    assert got == brute(rows, rule)


def test_odd_rows(documents, odd):
    rule = Rule()
    rows = [*odd, (None, "only without an id, five words and more")]
    got = sorted(map(tuple, parity_join.link_components(documents(rows), rule).collect()), key=str)
    assert (1, 0, 1) in got and (2, 0, 2) in got and (7, 0, 7) in got
    assert got.count((5, 5, 5)) == 2 and (6, 5, 5) in got
    assert any(r[0] is None and r[2] is None for r in got)
    assert len(got) == len(rows)
    assert parity_join.link_components(documents([]), rule).count() == 0


def test_rows_without_an_id_link_like_others(documents):
    rule = Rule(4, 85, 100)
    rng = random.Random(12)
    base = [f"w{rng.randrange(900)}" for _ in range(60)]
    chain = [" ".join(base[:k] + ["x"] * (k > 50) + base[k + 1 :]) for k in (60, 59, 55)]
    rows = [(7, " ".join(base)), *((None, t) for t in chain for _ in range(2)), (9, " ".join(["y", *base[1:59]]))]
    rows += [(None, "another text that no id at all is near to"), (None, "another text that no id at all is near to"), (None, None), (None, "")]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in parity_join.link_components(documents(rows), rule).collect()]
    numbered = [(k, t) for k, (_, t) in enumerate(rows)]
    want = {}
    for k, size, least in brute(numbered, rule):
        want.setdefault(least, []).append((rows[k][0], size))
    expected = []
    for members in want.values():
        ids = [i for i, _ in members if i is not None]
        name = min(ids) if ids else None
        expected += [(i, size, name) for i, size in members]
    assert sorted(got, key=str) == sorted(expected, key=str) and sum(r[2] == 7 for r in got) >= 6
    kept = parity_join.keep_one(documents(rows), rule).collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id is not None) == [(7, rows[0][1])]
    assert sum(r.doc_id is None and (r.text or "").startswith("another") for r in kept) == 1
    assert sum(r.doc_id is None and not r.text for r in kept) == 2


def test_different_texts_under_one_id_are_judged_apart(documents):
    one, other = "some words of one text that is here twice over", "quite another text under the very same number as well"
    rows = [(1, one), (2, one), (2, other), (3, None), (3, None), (4, other), (4, "a third text which nothing else is near to at all"), (4, other)]
    kept = parity_join.keep_one(documents(rows), Rule())
    got = sorted(((r.doc_id, r.text, r.source) for r in kept.collect()), key=str)
    assert got == sorted([(1, one, "s"), (2, other, "s"), (3, None, "s"), (3, None, "s"), (4, rows[6][1], "s")], key=str)


def test_one_of_each_group_stays(documents, odd):
    kept = parity_join.keep_one(documents(odd), Rule())
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 5, 7, 8, 9, 10]
    assert kept.columns == documents(odd).columns


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a = np.unique(rng.integers(0, 1 << 60, rng.integers(1, 400)).astype(np.uint64))
        b = np.union1d(a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 60, 5).astype(np.uint64))
        words = min(len(parity_join.parity(a)), len(parity_join.parity(b))) // 8
        x, y = (parity_join.fold(parity_join.parity(s), words) for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(3)
    rule = Rule(4, 85, 100)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 60, rng.integers(1, 300)).astype(np.uint64))
        drop = rng.integers(0, max(1, len(a) // 8))
        b = np.unique(np.r_[rng.permutation(a)[drop:], rng.integers(0, 1 << 60, rng.integers(0, 6)).astype(np.uint64)])
        if len(b) and parity_join.linked(a, b, rule):
            assert np.intersect1d(parity_join.keys(a, rule), parity_join.keys(b, rule)).size


@pytest.mark.parametrize("rule", [Rule(4, 85, 100), Rule(5, 80, 100)])
def test_sets_of_every_size_have_keys_and_share_them(rule):
    code = f"from lexloom.llm.parity_join import *; [layout(*b) for n in range(1, 3000) for b in bands(n, Rule{rule.words, rule.num, rule.den})]"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=60)  # a layout that never ends fails here
    rng = np.random.default_rng(4)
    for size in range(1, 120):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 60, size).astype(np.uint64))
            own = parity_join.keys(a, rule)
            assert len(own)
            for gone in range(size):
                b = a[gone:]
                c = np.sort(np.r_[b, rng.integers(1 << 60, 1 << 61, gone).astype(np.uint64)])
                near = [x for x in (b, c) if parity_join.linked(a, x, rule)]
                if not near:
                    break
                assert all(np.intersect1d(own, parity_join.keys(x, rule)).size for x in near)
