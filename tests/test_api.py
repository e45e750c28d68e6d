import pytest

from lexloom import api
from lexloom.operators.registry import Encoding
from lexloom.plans import queries as plans
from tests.test_encoding import texts


@pytest.fixture(scope="module")
def encoding():
    return plans._ranked()


def test_counts_keep_their_order(spark, encoding):
    some = texts(120, 30)
    want = [encoding.count(t) for t in some]
    assert api.batch_count(iter(some), encoding) == want == api.batch_count(some, encoding, spark=spark)
    special = api.batch_count(some, encoding, with_special=True)
    assert special == api.batch_count(some, encoding, with_special=True, spark=spark)
    assert special[0] == len(encoding.encode_with_special(some[0])) and api.batch_count([], encoding) == []


def test_truncation(spark, encoding):
    some = texts(80, 31)
    got = api.batch_truncate(some, 3, encoding)
    assert got == api.batch_truncate(some, 3, encoding, spark=spark)
    for text, (kept, total) in zip(some, got):
        assert text.startswith(kept) and total == encoding.count(text)
        assert (kept is text) == (total <= 3)
    assert api.truncate("hello world", 0, encoding) == ("", encoding.count("hello world"))


def test_composed_and_decomposed_texts_count_alike(encoding):
    nfc = Encoding("n", encoding.vocabulary, "qwen", nfc=True)
    assert len(set(api.batch_count(["café", "café"], nfc))) == 1
    assert api.truncate("café noir", 1, nfc)[0] in "café noir"


def test_unknown_encodings(encoding):
    with pytest.raises(KeyError):
        api.batch_count(["a"], "gpt-4o")


def test_the_estimate_by_its_name(spark, encoding):
    some = texts(60, 33)
    got = api.batch_count(some, "estimate", reference=encoding)
    assert got == api.batch_count(some, "estimate", reference=encoding, spark=spark) and api.batch_count([], "estimate", reference=encoding) == []
    cuts = api.batch_truncate(some, 9, "estimate", reference=encoding)
    assert cuts == api.batch_truncate(some, 9, "estimate", reference=encoding, spark=spark)
    for text, total, (kept, said) in zip(some, got, cuts):
        assert said == total and text.startswith(kept) and (kept == text) == (total <= 9)
    text = "nothing to cut here"
    assert api.truncate(text, 1000, "estimate", reference=encoding)[0] is text
    for call in (lambda: api.batch_count(["a"], "estimate"), lambda: plans.load("estimate", "x")):
        with pytest.raises(KeyError):
            call()
