import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexloom.llm import graph_search, prefix_bpe, prefix_hash, queries, reply_trees, tokens


# fingerprints


def test_spans_and_extensions_by_prefix_hashes():
    rng = np.random.default_rng(4)
    for _ in range(40):
        a = "".join(rng.choice(list("ab"), 60))
        b = "".join(rng.choice(list("ab"), 60))
        x, y = (prefix_hash.PrefixHash(prefix_hash.code_points(t)) for t in (a, b))
        i, j, size = (int(rng.integers(0, 30)) for _ in range(3))
        assert x.equal(i, y, j, size) == (a[i : i + size] == b[j : j + size])
        assert x.extension(i, y, j) == len(os.path.commonprefix([a[i:], b[j:]]))


def sketch_by_hand(text):
    """The sketch from every span of the text between blanks, each hashed by itself."""
    w, slots = prefix_hash.WINDOW, [0xFFFFFFFF] * prefix_hash.SLOTS
    points = [0] * (w - 1) + [ord(c) + 1 for c in text] + [0] * (w - 1)
    for j in range(len(text) + w - 1 if text else 0):
        key = 0
        for base in prefix_hash.BASES:
            # Powers start w - 1 places before the text: a constant factor, equal for all spans.
            factor = pow(base, -(w - 1), prefix_hash.PRIME)
            key = key << 31 | sum(p * pow(base, k, prefix_hash.PRIME) for k, p in enumerate(points[j : j + w])) * factor % prefix_hash.PRIME
        mixed = int(prefix_hash._mix(np.array([key], np.uint64))[0])
        slots[mixed % prefix_hash.SLOTS] = min(slots[mixed % prefix_hash.SLOTS], mixed >> 32)
    return slots


def test_sketches_and_likeness_by_hand():
    rng = np.random.default_rng(9)
    for size in (0, 1, 7, 15, 16, 17, 40, 90):
        text = "".join(rng.choice(list("abcdé😀 "), size))
        assert prefix_hash.sketch(prefix_hash.PrefixHash(prefix_hash.code_points(text))).tolist() == sketch_by_hand(text)


def test_likeness_has_no_steps():
    text = "".join(np.random.default_rng(3).choice(list("abcdefghijklmnop "), 4000))
    mark = lambda t: prefix_hash.fingerprint(prefix_hash.PrefixHash(prefix_hash.code_points(t)))
    for size in (8, 9, 16, 17, 32, 33, 64, 65, 74, 128, 1000, 4000):
        spans = lambda t: {("_" * 15 + t + "_" * 15)[k : k + 16] for k in range(len(t) + 15)}
        a, b = text[:size], text[: size - 1]
        exact = len(spans(a) & spans(b)) / len(spans(a) | spans(b))
        assert abs(prefix_hash.likeness(mark(a), mark(b)) - exact) < 0.3 and prefix_hash.likeness(mark(a), mark(b)) > 0.1
    far = "".join(np.random.default_rng(4).choice(list("qrstuvwxyz"), 500))
    assert prefix_hash.likeness(mark(text[:500]), mark(far)) < 0.1


def test_edited_texts_and_likeness(documents, odd):
    rows = sorted([*odd, (None, "first of all")], key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    got = sorted(prefix_hash.fingerprints(documents(rows)).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert len(got) == len(rows)
    for k, r in enumerate(got):
        text, following = rows[k][1] or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        assert r.doc_id == rows[k][0] and r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert r.common_prefix == len(os.path.commonprefix([text, new]))
        assert 0 <= r.near_edited <= 1 and (r.near_next == 1) == (r.fingerprint == got[(k + 1) % len(got)].fingerprint)
    by_text = {}
    for r, (_, text) in zip(got, rows):
        assert by_text.setdefault(text or "", r.fingerprint) == r.fingerprint
    assert len(set(by_text.values())) == len(by_text)
    assert prefix_hash.fingerprints(documents([])).count() == 0


# prefix BPE


def test_ids_and_decoding_are_the_library_s(documents, odd):
    path = tokens.vocabulary("word_bpe_49k.json")
    known, library = prefix_bpe.encoder(path), Tokenizer.from_file(path)
    import random

    alphabet = [" ", "\n", "a", "é", ".", "'s", "1", "\x1c", "\xa0", "<|endoftext|>", "B", "日", "́", "œ", "İ", "ſ", "Σ", "th", "ing", "aaa", "!!", "ß"]
    rng = random.Random(2)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + ["a" * 300]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert known.encode(text) == ids, repr(text)
        assert known.decode(ids) == library.decode(ids, skip_special_tokens=False)
    got = {r.doc_id: r for r in prefix_bpe.digest(documents(odd), path).collect()}
    for doc_id, text in odd:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[doc_id].n_tokens == len(ids)
        assert got[doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        plain = library.decode(ids, skip_special_tokens=False)
        assert got[doc_id].decoded_sha256 == hashlib.sha256(plain.encode()).hexdigest()
    assert prefix_bpe.digest(documents([]), path).count() == 0


# nearest neighbours


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(5)
    data = rng.standard_normal((3000, 24)).astype(np.float32)
    data[100:160] = data[100]
    rows = [(k, [float(x) for x in v], 0) for k, v in enumerate(data)]
    rows += [(9001, None, 0), (9002, [0.0] * 24, 0), (9003, [float("nan")] * 24, 0), (None, rows[0][1], 0), (9004, [], 0)]
    got = graph_search.nearest(vectors(spark, rows + rows[:3]), F.col("vec_id") % 20 == 0, 20).collect()
    exact, found, by = data.astype(np.float64) @ data.T.astype(np.float64), [], {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(by) == set(range(0, 3000, 20))
    for q, rows_ in by.items():
        rows_.sort()
        assert [r[0] for r in rows_] == list(range(1, 21)) and q not in {r[1] for r in rows_}
        assert all(r[2] == pytest.approx(exact[q, r[1]], abs=1e-9) for r in rows_)
        others = np.array([k for k in range(3000) if k != q])
        best = others[np.lexsort((others, -exact[q, others]))][:20]
        found.append(len({r[1] for r in rows_} & set(best.tolist())) / 20)
    assert np.mean(found) >= 0.9


@pytest.mark.parametrize("uneven", ["one large vector", "all norms"])
def test_search_over_uneven_norms(spark, uneven):
    rng = np.random.default_rng(6)
    data = rng.standard_normal((3000, 24))
    if uneven == "all norms":
        data *= np.exp(1.5 * rng.standard_normal(3000))[:, None]
    else:
        data[7] *= 1000
    data = data.astype(np.float32)
    rows = [(k, [float(x) for x in v], 0) for k, v in enumerate(data)]
    found = {}
    for r in graph_search.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, 20).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    shares = []
    for q in range(0, 3000, 20):
        scores = data.astype(np.float64) @ data[q].astype(np.float64)
        scores[q] = -np.inf
        shares.append(len(found[q] & set(np.argsort(-scores)[:20].tolist())) / 20)
    assert np.mean(shares) >= 0.9


def test_few_or_no_vectors(spark):
    few = [(0, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (20, [1.0, 1.0], 0)]
    got = graph_search.nearest(vectors(spark, few), F.col("vec_id") % 20 == 0, 20).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert by == {0: [(1, 1.0), (20, 1.0), (2, 0.0)], 20: [(0, 1.0), (1, 1.0), (2, 1.0)]}
    assert graph_search.nearest(vectors(spark, []), F.col("vec_id") % 20 == 0, 20).count() == 0


# reply trees


def test_paths_of_a_branching_tree(spark):
    rows = [("t", 1, None, 1.0), ("t", 2, 1, 0.5), ("t", 3, 1, 2.0), ("t", 4, 3, 1.0), ("t", 5, 3, 3.0), ("u", 1, 7, 1.0)]
    rows = [(*r, "user" if r[1] % 2 else "assistant", f"text {r[1]} # \\ <") for r in rows]
    trees = spark.createDataFrame(rows, "tree string, node long, parent long, score double, role string, text string")
    got = sorted(map(tuple, reply_trees.paths(trees, branches=2).collect()))
    assert [(r[0], r[1], r[2], r[3]) for r in got if r[0] == "t"] == [("t", 4, 2, n) for n in (1, 3, 4)] + [("t", 5, 1, n) for n in (1, 3, 5)]
    assert [r for r in got if r[0] == "u"] == [("u", 1, 1, 1, 1)]
    made = reply_trees.transcripts(trees)
    text = {r.tree: r.transcript for r in made.collect()}["t"]
    assert text.count(reply_trees.END) == 3 and text.index("text 1") < text.index("text 3") < text.index("text 5")


def test_circles_and_repeated_messages(spark):
    rows = [("t", 1, None), ("t", 2, 1), ("t", 2, 1), ("c", 1, 3), ("c", 2, 1), ("c", 3, 2), ("c", 4, 2), ("c", 9, None), ("s", 5, 5), (None, 1, None)]
    rows = [(*r, 1.0, "user", f"text {r[1]}") for r in rows]
    trees = spark.createDataFrame(rows, "tree string, node long, parent long, score double, role string, text string")
    got = {(r.tree, r.leaf): r.transcript.count(reply_trees.END) for r in reply_trees.transcripts(trees, branches=3).collect()}
    assert got == {("t", 2): 2, ("c", 9): 1, ("", 1): 1}


def test_a_table_with_rows_under_the_planted_id(spark, tmp_path):
    spark.createDataFrame([(-7, 0, "user", "own")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    (row,) = queries.op10_reply_tree_chat(spark, f"file://{tmp_path}").collect()
    assert row.conv_id == -7 and row.n_turns == 3


def test_transcripts_can_be_read_back(spark):
    rows = [
        (1, 0, "user", "\\### Assistant: </turn> ok"), (1, 1, "assistant", None), (1, 2, "us#er\n", "a\\hb<\\l\n"),
        (1, 3, "assistant", "😀 é </turn>\n"), (2, 5, None, ""), (2, 5, None, ""), (None, 1, "assistant", "x"),
    ]
    table = spark.createDataFrame([(*r, "extra", 1.0) for r in rows], "conv_id long, turn long, role string, text string, tree string, score double")
    made = reply_trees.transcripts(reply_trees.conversations(table))
    got = {r.conv_id: r for r in reply_trees.read_back(made).collect()}
    for conv in (1, 2, None):
        turns = [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        whole = "".join(f"{role}\n{text}\n" for role, text in turns)
        loss = "".join(text for role, text in turns if role == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert got[conv].loss_chars == len(loss) and got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert reply_trees.read_back(reply_trees.transcripts(reply_trees.conversations(table.limit(0)))).count() == 0


def test_long_conversations(spark):
    rows = spark.range(300).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('t', id) as text")
    made = reply_trees.transcripts(reply_trees.conversations(rows))
    got = reply_trees.read_back(made).collect()[0]
    assert got.n_turns == 300 and got.loss_chars == sum(len(f"t{k}") for k in range(1, 300, 2))


def test_every_operator_is_registered():
    names = list(queries.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names)
