import base64
import random

import pytest

from lexloom.functions.grammar import GRAMMARS
from lexloom.operators import kernel
from lexloom.operators.registry import Encoding
from lexloom.sources import formats

tiktoken = pytest.importorskip("tiktoken")
public = pytest.importorskip("public_tokenizers")

# The published split patterns.
PATTERNS = {
    "cl100k": r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}++|\p{N}{1,3}+| ?[^\s\p{L}\p{N}]++[\r\n]*+|\s++$|\s*[\r\n]|\s+(?!\S)|\s",
    "o200k": "|".join(
        [
            r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+(?i:'s|'t|'re|'ve|'m|'ll|'d)?",
            r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+[\p{Ll}\p{Lm}\p{Lo}\p{M}]*(?i:'s|'t|'re|'ve|'m|'ll|'d)?",
            r"\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n/]*|\s*[\r\n]+|\s+(?!\S)|\s+",
        ]
    ),
    "qwen": r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}++|\p{N}| ?[^\s\p{L}\p{N}]++[\r\n]*+|\s*[\r\n]+|\s+(?!\S)|\s+",
}
ALPHABET = [
    " ", "  ", "\n", "\r\n", "a", "B", "é", "É", ".", "'s", "'S", "'LL", "1", "23", "\x1c", "\xa0", "\t", "日", "́", "/",
    "œ", "😀", "ÿ", "\x85", "ª", "ß", "!!", "東京OK", "aaaaaaaaaaaaa", "²", "ﬁ", "हिन्दी", "<|endoftext|>",
]
SPECIALS = [("<|endoftext|>", 50256), ("<|im_start|>", 50257), ("<|im_end|>", 50258)]


def texts(count=1500, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 14))) for _ in range(count)]


@pytest.fixture(scope="module")
def ranks():
    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@pytest.fixture(scope="module")
def vocabulary():
    v = formats.read_vocabulary(public.path("byte_bpe_50k.tiktoken"))
    v.specials = list(SPECIALS)
    return v


@pytest.mark.parametrize("name", PATTERNS)
def test_ids_are_tiktoken_s(name, ranks, vocabulary):
    oracle = tiktoken.Encoding(name, pat_str=PATTERNS[name], mergeable_ranks=ranks, special_tokens=dict(SPECIALS))
    e = Encoding(name, vocabulary, name)
    for text in texts() + ["a" * 500, " " * 300, "ab" * 200, "\n \n" * 40]:
        ids = oracle.encode_ordinary(text)
        assert e.encode_ordinary(text) == ids, repr(text)
        assert e.count(text) == len(ids) and e.decode(ids) == text
        assert e.encode_with_special(text) == oracle.encode(text, allowed_special="all")


def test_pieces_tile_and_the_fast_spelling_agrees():
    for name, g in GRAMMARS.items():
        for text in texts(600, 5):
            assert "".join(g.split(text)) == text
            if name != "whole" and text.isascii():
                assert [m.group() for m in g.compiled.finditer(text)] == g.split(text)


def test_marks_join_letters():
    assert len(GRAMMARS["qwen_marks"].split("हिन्दी")) < len(GRAMMARS["qwen"].split("हिन्दी"))


def test_cl100k_takes_trailing_white_space_whole():
    assert GRAMMARS["cl100k"].split("a \n ") == ["a", " \n "]
    assert GRAMMARS["qwen"].split("a \n ") == ["a", " \n", " "]
    assert GRAMMARS["o200k"].split("東京OK") == ["東京", "OK"]


def test_heap_and_scan_agree(ranks):
    rng = random.Random(4)
    for _ in range(300):
        piece = bytes(rng.choice(b"abcdeinrst ") for _ in range(rng.randint(1, 60)))
        if piece not in ranks:
            assert kernel._merge_ranks_heap(piece, ranks) == kernel.merge_ranks(piece, ranks)


def test_the_compiled_merge_and_the_own_one_agree(ranks, monkeypatch):
    import sys

    merge, rng = kernel.rank_merger(ranks), random.Random(14)
    pieces = [bytes(rng.choice(b"abcdeinrst \xc3\xa9") for _ in range(rng.randint(1, 90))) for _ in range(2000)]
    assert all(merge(p) == kernel.merge_ranks(p, ranks) for p in pieces)
    monkeypatch.setitem(sys.modules, "tiktoken", None)
    assert kernel.rank_merger(ranks)(b"hello there") == merge(b"hello there")
    assert kernel.rank_merger({b"a": 0, b"b": 1, b"ab": 2})(b"abba") == [2, 1, 0]


def test_special_policies(vocabulary):
    e = Encoding("x", vocabulary, "cl100k")
    with pytest.raises(ValueError):
        e.encode("a<|endoftext|>b")
    assert 50256 in e.encode("a<|endoftext|>b", allowed_special="all")
    assert 50256 not in e.encode("a<|endoftext|>b", disallowed_special=())
    assert e.encode("<|im_start|><|im_end|>", allowed_special={"<|im_start|>", "<|im_end|>"}) == [50257, 50258]
    with pytest.raises(ValueError):
        e.encode("a", allowed_special="some")


def test_bytes_without_loss(vocabulary):
    e = Encoding("x", vocabulary, "cl100k")
    rng = random.Random(8)
    for _ in range(300):
        data = bytes(rng.randrange(256) for _ in range(rng.randint(0, 30)))
        assert e.decode_bytes(e.encode_bytes(data)) == data
    assert e.encode_bytes("é!".encode()) == e.encode_ordinary("é!")


def test_malformed_bytes_are_read_by_their_lead_bytes(vocabulary):
    """Pieces of bytes that aren't UTF-8, written by hand: a lead byte takes as many bytes
    as it promises, any other byte is the character of its number."""
    e = Encoding("x", vocabulary, "cl100k")
    for data, pieces in (
        (b"\xff\xc3Top", [b"\xff\xc3Top"]),  # two letters of Latin-1, then letters
        (b"ab \x80cd", [b"ab", b" \x80", b"cd"]),  # a control is no letter
        (b"\xe4\xb8", [b"\xe4", b"\xb8"]),  # too short: a letter and a sign
        (b"1\xc2\xb2\xb22", [b"1\xc2\xb2\xb2", b"2"]),  # digits in threes
    ):
        assert e.encode_bytes(data) == [i for p in pieces for i in e.merge(p)], data


def test_decode_policies(vocabulary):
    e = Encoding("x", vocabulary, "cl100k")
    ids = [e.ids[b"\xc3"]] + e.encode_ordinary("a�b")
    assert e.decode(ids) == "�a�b" and e.decode(ids, "ignore") == "ab"
    with pytest.raises(ValueError):
        e.decode(ids, "strict")


def test_truncation(vocabulary):
    e = Encoding("x", vocabulary, "cl100k")
    for text in texts(400, 9):
        total = e.count(text)
        for most in (0, 1, 2, 5, total, total + 3):
            cut = e.truncate(text, most)
            assert cut.total_tokens == total and text.startswith(cut.text) and cut.kept_tokens <= most
            assert cut.bytes == len(cut.text.encode()) and (most < total or cut.text == text)
            if cut.text != text:
                whole = e.decode_bytes(e.encode_ordinary(text)[:most])
                assert whole.startswith(cut.text.encode()) and len(whole) - cut.bytes < 4
    assert e.truncate("hello", 0).text == ""


def test_spans_tile(vocabulary):
    e = Encoding("x", vocabulary, "cl100k")
    for text in texts(300, 10):
        for unit, whole in (("byte", text.encode()), ("char", text)):
            ids, spans = e.offsets(text, unit)
            assert len(ids) == len(spans)
            at = 0
            for start, end in spans:
                assert start == at
                at = end
            assert at == len(whole)
    with pytest.raises(ValueError):
        e.offsets("a", "word")


def test_memos_of_two_encodings_are_apart(vocabulary, ranks):
    other = formats.Vocabulary({i: bytes([i]) for i in range(256)})
    a, b = Encoding("x", vocabulary, "cl100k"), Encoding("x", other, "cl100k")
    assert a.fingerprint != b.fingerprint
    assert b.encode_ordinary("hello hello") == list(b"hello hello") != a.encode_ordinary("hello hello")


def test_cached_encodings_differ_by_grammar(tmp_path):
    from lexloom.operators import registry

    path = public.path("byte_bpe_50k.tiktoken")
    one, two = registry.load("own", path, "cl100k"), registry.load("own", path, "o200k")
    assert one is not two and one is registry.load("own", path, "cl100k") and two.grammar_name == "o200k"


def test_other_names_for_known_encodings():
    from lexloom.operators import registry

    registry.alias("my-encoding", "qwen-marks")
    e = registry.load("my-encoding", public.path("byte_bpe_50k.tiktoken"))
    assert e.grammar_name == "qwen_marks" and e.nfc and "my-encoding" in registry.names()
    with pytest.raises(KeyError):
        registry.alias("other", "nothing")


def test_special_ties_and_subsets(vocabulary):
    v = formats.Vocabulary(vocabulary.tokens, specials=[("<a>", 50300), ("<a><b>", 50301), ("<b>", 50302)])
    e = Encoding("x", v, "cl100k")
    assert e.encode("<a><b>", allowed_special="all") == [50300, 50302]  # the first listed of equal starts
    assert e.encode("<a><b>", allowed_special={"<a><b>"}, disallowed_special=()) == [50301]
    assert e.encode("x<b><a>", allowed_special={"<b>"}, disallowed_special=())[:2] == [*e.encode_ordinary("x"), 50302]
    with pytest.raises(ValueError, match="<a>"):
        e.encode("x<b><a>", allowed_special={"<b>"})
