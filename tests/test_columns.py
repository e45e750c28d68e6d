import os

import pytest
from pyspark.sql import functions as F

from lexloom.functions import grammar
from lexloom.functions.columns import Columns, prompt_count
from lexloom.operators import estimate
from lexloom.plans import queries as plans
from lexloom.streaming import count_stream
from tests.test_encoding import texts

SMALL = "/root/testdata/sf0.001"
ODD = [(0, None), (1, ""), (2, "hello world"), (3, "日本 é😀 <|endoftext|> x"), (4, "word " * 4000), (5, "hello world")]


@pytest.fixture(scope="module")
def columns(spark):
    return Columns(spark, plans._ranked())


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").repartition(3)


def test_every_column_agrees_with_the_encoding(columns, rows):
    e, text = columns.encoding, F.col("text")
    got = rows.select(
        "doc_id",
        columns.encode(text).alias("ids"),
        columns.count(text).alias("n"),
        columns.count(text, with_special=True).alias("special"),
        columns.truncate(text, 3).alias("cut"),
        columns.spans(text, "char").alias("spans"),
        columns.decode(columns.encode(text)).alias("back"),
        columns.pieces(text).alias("pieces"),
        columns.encode_bytes(text.cast("binary")).alias("raw"),
    ).collect()
    want = dict(ODD)
    for r in got:
        t = want[r.doc_id]
        if t is None:
            assert all(r[c] is None for c in ("ids", "n", "special", "cut", "spans", "back", "pieces", "raw"))
            continue
        assert r.ids == r.raw == e.encode_ordinary(t) and r.n == len(r.ids) and r.back == t
        assert r.special == len(e.encode_with_special(t)) and r.pieces == e.grammar.split(t)
        cut = e.truncate(t, 3)
        assert (r.cut.text, r.cut.total_tokens, r.cut.kept_tokens) == (cut.text, cut.total_tokens, cut.kept_tokens)
        assert [(s.start, s.end) for s in r.spans] == e.offsets(t, "char")[1]


def test_catalyst_splits_as_python_does(spark):
    rows = spark.createDataFrame(list(enumerate(texts(500, 12))), "id long, text string")
    for name in ("cl100k", "o200k", "qwen", "qwen_marks", "r50k"):
        g = grammar.grammar(name)
        for r in rows.select("text", g.pieces(F.col("text")).alias("pieces")).collect():
            assert r.pieces == g.split(r.text), (name, r.text)
    with pytest.raises(KeyError):
        grammar.grammar("nothing")


def test_refused_specials_stop_the_query(columns, rows):
    text = F.col("text")
    clean = rows.filter("doc_id <> 3")
    assert clean.select(columns.encode_special(text, "", "all").alias("ids")).count() == 5
    with pytest.raises(Exception, match="isn't allowed"):
        rows.select(columns.encode_special(text, "", "all").alias("ids")).collect()


def test_sql_functions(spark, columns, rows):
    columns.register("t_")
    rows.createOrReplaceTempView("odd_texts")
    got = spark.sql("select t_count_tokens(text) n, t_decode_tokens(t_encode_tokens(text)) back from odd_texts where doc_id = 2").first()
    assert got.n == columns.encoding.count("hello world") and got.back == "hello world"


def test_prompt(columns, rows):
    got = dict(rows.select("doc_id", prompt_count(columns, F.col("text"))).collect())
    assert got[2] == 8 + columns.encoding.count(" hello world")


def test_partitions_do_not_change_results(columns, rows):
    few, many = (rows.repartition(n).select("doc_id", columns.count(F.col("text")).alias("n")) for n in (1, 4))
    assert sorted(few.collect(), key=str) == sorted(many.collect(), key=str)


#: Pieces and their classes, written by hand.
CLASSED = {
    "newline": ["\n", "\r\n", " \n\n", "\t\n"], "space": [" ", "   ", "\t\t", "\u00a0"], "digit": ["0", "7", "²"],
    "punct": ["...", " ---", " (", "=", "__", "!?\n", "$"], "contr": ["'s", "'LL", "'ve"],
    "run": ["aaaaaaaaa", " zzzzzzzzzzzz", "helloooooooooo"], "lower": ["hello", " world", "_init", "(x"],
    "upper": ["HTTP", " AB", "_NO"], "cap": ["A", " Hello", "_X", "(World"], "camel": ["getValue", " HTTPServer", "aB", "iPhone"],
    "latinx": ["é", " naïve", "Über"], "cjk": ["日本", "漢"], "cyr": ["Ж", " привет"], "astral": ["😀", "𝒳"],
    "hangul": ["가"], "fullwidth": ["ＡＢ"], "greek": ["αβ"], "heb": ["שלום"], "arab": ["سلام"], "thai": ["ไทย"],
}


def test_classes(spark):
    rows = [(p, c) for c, pieces in CLASSED.items() for p in pieces]
    named = spark.createDataFrame(rows, "p string, want string").select("p", "want", estimate.classify(F.col("p")).alias("c")).collect()
    assert not [r for r in named if r.c != r.want]


def test_classes_of_any_pieces(spark):
    pieces = sorted({p for t in texts(800, 21) for p in grammar.grammar("qwen").split(t)})
    named = spark.createDataFrame([(p,) for p in pieces], "p string").select("p", estimate.classify(F.col("p")).alias("c"))
    assert all(r.c == estimate.class_of(r.p) for r in named.collect())


def test_estimates(columns, rows):
    counted = rows.select("doc_id", estimate.features(columns, F.col("text")).alias("f")).withColumn("n", estimate.estimate(F.col("f")))
    got = {r.doc_id: r for r in counted.collect()}
    assert got[1].n == 0 and got[0].f is None and len(got[2].f) == len(estimate.CLASSES)
    assert got[2].n >= columns.encoding.count("hello world")
    for r in rows.select("doc_id", estimate.truncated(columns, F.col("text"), 50).alias("t")).collect():
        text = dict(ODD)[r.doc_id]
        if text is None:
            assert r.t is None
            continue
        assert text.startswith(r.t.text) and r.t.kept <= 50 and r.t.total == got[r.doc_id].n
        assert (r.t.text == text) == (r.t.total <= 50)


def test_estimate_is_cut_at_the_last_piece_that_fits(columns):
    counters = estimate.Counters(columns.encoding)
    for text in [t for t in texts(120, 40) if t] + ["one two three " * 30]:
        for most in (0, 3, 7, 20, 60):
            cut = counters.truncate(text, most)
            if counters.count(text) <= most:
                assert cut["text"] == text
                continue
            ends, at = [0], 0
            for piece in counters.split(text):
                at += len(piece)
                ends.append(at)
            fits = [e for e in ends if counters.count(text[:e]) <= most]
            assert len(cut["text"]) in ends and cut["kept"] <= most and len(cut["text"]) <= max(fits)


def test_rows_with_one_key_are_decoded_apart(spark, columns):
    e = columns.encoding
    some = [(1, "first text"), (1, "second"), (None, "no key"), (2, "")]
    rows = spark.createDataFrame([(k, e.encode_ordinary(t)) for k, t in some], "k int, ids array<int>").repartition(3)
    got = columns.decode_rows(rows, "k", "ids").collect()
    assert sorted(((r.k, bytes(r.data).decode()) for r in got), key=str) == sorted(some, key=str)


def _nodes(node):
    yield node
    for k in range(node.children().size()):
        yield from _nodes(node.children().apply(k))


def test_decoding_by_a_join_keeps_each_id_in_its_row(spark, columns):
    """No rows of ids, nothing shuffled or gathered, texts encoded once, no vocabulary in a row."""
    rows = spark.range(8).select("id", columns.encode(F.col("id").cast("string")).alias("ids"))
    some = [columns.decode_rows(rows, "id", "ids")]
    if os.path.isdir(SMALL):
        some.append(plans.queries()["decode_join_unknown_ids"](spark, SMALL))
    for decoded in some:
        nodes = list(_nodes(decoded._jdf.queryExecution().sparkPlan()))
        names = [n.nodeName() for n in nodes]
        assert names.count("ArrowEvalPython") == 1
        assert not [n for n in names if n.startswith(("Generate", "Sort")) or "Aggregate" in n or "Join" in n]
        assert not [n for n in nodes if {"near", "far"} & {n.output().apply(k).name() for k in range(n.output().size())}]
        assert "hashpartitioning" not in decoded._jdf.queryExecution().executedPlan().toString()


def test_decoding_by_a_join_of_odd_ids(spark):
    from lexloom.operators.registry import Encoding
    from lexloom.sources.formats import Vocabulary

    tokens = {0: b"a", 1: b"\xff", 2: b"\xc3", 4: b"", 90_000: b"far", 7: b"both"}
    specials = [("<|x|>", 5), ("<|far|>", 2**31 - 1), ("<|both|>", 7), ("<|second|>", 5)]
    e = Encoding("odd", Vocabulary(tokens, specials=specials), "cl100k")
    lists = [[], [0, 1, 2], [3, 6, -1, 250_000], [4, 0, 4], [5, 7, 90_000, 2**31 - 1, -(2**31)], [0] * 3000, [1, 1, 0]]
    some = spark.createDataFrame([*enumerate(lists), (100, None), (101, [0, None, 2])], "k int, ids array<int>")
    got = {r.k: r.data for r in Columns(spark, e).decode_rows(some, "k", "ids").collect()}
    assert got.pop(100) is None and bytes(got.pop(101)) == b"a\xc3"
    assert {k: bytes(v) for k, v in got.items()} == {k: e.decode_bytes(x) for k, x in enumerate(lists)}
    longs = spark.createDataFrame([(0, [0, 2**32, 2**32 + 90_000, 2**63 - 1, 90_000])], "k int, ids array<long>")
    assert bytes(Columns(spark, e).decode_rows(longs, "k", "ids").first().data) == b"afar"


def test_a_worker_hands_over_some_rows_at_once(spark, columns):
    """In order and complete, whatever the number of rows."""
    most = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch in ("10000", "700"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            rows = spark.range(0, 5003, 1, 2).select("id", F.when(F.col("id") % 7 != 0, F.col("id").cast("string")).alias("t"))
            got = rows.select("id", "t", columns.encode(F.col("t")).alias("ids")).collect()
            assert [r.id for r in got] == list(range(5003))
            assert all(r.ids == (None if r.t is None else columns.encoding.encode_ordinary(r.t)) for r in got)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)


def test_few_partitions_are_spread(spark):
    from lexloom.functions.columns import spread

    one = spark.range(100).coalesce(1)
    assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(100).repartition(9)
    assert spread(many) is many


def test_streams_count_as_batches_do(spark, columns):
    if not os.path.isdir(SMALL):
        pytest.skip("no test data")
    batch = plans.queries()["count_tokens"](spark, SMALL)
    assert sorted(count_stream.counted(spark, SMALL, columns).collect()) == sorted(batch.select("doc_id", "n_tokens").collect())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        con.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    want = con.execute(plans.oracle_sql()[name]).df()
    got = plans.queries()[name](spark, SMALL).toPandas()
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    one, other = (sorted(map(tuple, t[names].astype(object).values.tolist())) for t in (got, want))
    assert one == other


def test_the_entry_stands_without_the_subpackage():
    import subprocess
    import sys
    import textwrap

    code = textwrap.dedent(
        """
        import sys
        sys.modules["lexloom.llm"] = None
        sys.modules["corpus_pipeline"] = None
        import __spark_entry__ as e
        assert not [n for n in e.queries() if n.startswith("op") or n == "pipeline"]
        assert set(e.oracle_sql()) <= set(e.queries())
        """
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root)
