import struct
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lexloom.llm import common, crf_pii, gru_language, string_kernel, tokens
from tests.llm.test_models import EN, FR, toxic_bags
from tests.llm.test_near_copies import brute


@pytest.fixture
def folder(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows, labels = [], []
    for k, (toxic, text) in enumerate(toxic_bags()):
        rows.append((k, f"{text} {EN}", "en"))
        labels.append((k, 1, toxic))
    for k in range(200, 320):
        rows.append((k, " ".join(rng.choice(FR.split(), 30)), "fr"))
    rows += [(400, rows[2][1], "en"), (401, rows[2][1] + " today", "en"), (402, "", "en"), (403, None, None)]
    rows += [(404, "123 456 ...", "en"), (405, f"{EN} write to x.y@z.com or +1 (234) 555-7890", "en")]
    full = [(i, t, lang, "s", len(t or "")) for i, t, lang in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return f"file://{tmp_path}"


def test_each_stage_against_its_operator_row_by_row(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, steps = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.cut(stage(spark, docs, folder), "t")
        steps.append((name, docs))
        if name != "packing":
            assert docs.columns == columns
    rows = [{r.doc_id: r.text for r in d.collect()} for _, d in steps[:4]]
    first = spark.read.parquet(f"{folder}/documents.parquet")
    rest = first.filter("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1")
    net = gru_language.fit(rest)
    every = {r.doc_id: r.text for r in first.collect()}
    told = dict(zip(every, net.predict(list(every.values()))))
    assert set(rows[0]) == {k for k, (lang, s) in told.items() if lang != "und" and s >= corpus_pipeline.least_share(net)}
    assert not {402, 403, 404} & set(rows[0]) and len(rows[0]) > 300

    labels = spark.read.parquet(f"{folder}/labels.parquet").filter("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
    scorer = string_kernel.Scorer(string_kernel.fit(steps[0][1], labels))
    clean = {k for k, s in zip(rows[0], scorer.score(list(rows[0].values()))) if s < 0.5}
    assert set(rows[1]) == clean and 0 not in clean and 1 in clean

    components = brute(list(rows[1].items()), corpus_pipeline.NEAR)
    assert set(rows[2]) == {doc_id for doc_id, _, least in components if doc_id == least}
    assert not {400, 401} & set(rows[2])

    model = crf_pii.reader()
    for doc_id, text in rows[3].items():
        (_, spans), = crf_pii.find([rows[2][doc_id]], model)
        assert text == crf_pii.mask(rows[2][doc_id], spans)
    assert "<EMAIL>" in rows[3][405] and "<PHONE>" in rows[3][405]
    sizes = {r.doc_id: r.n_chars for r in steps[3][1].collect()}
    assert all(sizes[k] == len(t) for k, t in rows[3].items())

    library = Tokenizer.from_file(tokens.vocabulary("byte_bpe_50k.json"))
    pieces = {}
    for r in steps[4][1].collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    assert set(pieces) == set(rows[3])
    for doc_id, text in rows[3].items():
        ids, at = library.encode(text, add_special_tokens=False).ids + [0], 0
        for start, length, check in sorted(pieces[doc_id]):
            assert start == at and check == zlib.crc32(struct.pack(f"<{length}I", *ids[at : at + length]))
            at += length
        assert at == len(ids)


def test_clashing_columns_ride_along(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "'s' as score", "7 as predicted", "1L as node", "'k' as key", "0 as column_0")
    for _, stage in corpus_pipeline.STAGES[:4]:
        kept = common.cut(stage(spark, docs, folder), "t")
        assert kept.columns == docs.columns and kept.count() > 100
        docs = kept
    assert {(r.score, r.predicted, r.key) for r in docs.collect()} == {("s", 7, "k")}


def test_run_and_an_empty_table(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 0
    empty = f"{tmp_path}/empty"
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{empty}").count() == 0
