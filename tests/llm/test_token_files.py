import struct
import zlib

import pytest
from tokenizers import Tokenizer

from lexloom.llm import common, packing, seekable, tokens

BYTE_BPE = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.vocabulary(BYTE_BPE))


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_pieces_encode_as_the_library_does(library):
    import random

    alphabet = [" ", "  ", "\n", "a", "é", ".", "'s", "1", "\x1c", "\xa0", "<|endoftext|>", "\t", "B", "日", "́", "œ", "’", "€", "²", "\x85"]
    rng = random.Random(1)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    got = tokens.encoder(tokens.vocabulary(BYTE_BPE)).encode([*texts, None])
    assert got[-1] == b""
    for text, data in zip(texts, got):
        assert list(struct.unpack(f"<{len(data) // 4}I", data)) == ids_of(library, text), repr(text)


def test_files_hold_every_document(spark, documents, odd, library):
    rows = [*odd, (None, "no id")]
    path = tokens.vocabulary(BYTE_BPE)
    manifest = seekable.write_ids(documents(rows), common.scratch(spark, "t"), path, 2, 3)
    got = sorted(map(tuple, seekable.read_ids(spark, manifest).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, 1, 2, 3, 4, 5, 5, 6, 7, 8, 9, 10]
    start = 0
    want = {}
    for doc_id, text in rows:
        ids = ids_of(library, text) + [2]
        want[doc_id] = (len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
    for doc_id, at, size, check in got:
        assert (at, size, check) == (start, *want[doc_id])
        start += size


def test_reader_fetches_one_document(spark, documents, odd, library):
    path = tokens.vocabulary(BYTE_BPE)
    manifest = seekable.write_ids(documents(odd), common.scratch(spark, "t"), path, 2, 1)
    (name, docs, _), = manifest
    reader = seekable.Reader(name)
    assert len(reader) == docs == len(odd)
    at = reader.keys.index(9)
    assert struct.unpack(f"<{len(reader.ids(at)) // 4}I", reader.ids(at))[:-1] == tuple(ids_of(library, dict(odd)[9]))


def test_a_damaged_frame_is_noticed(tmp_path):
    path = f"{tmp_path}/x.zst"
    writer = seekable.Writer(path)
    writer.add(-(2**63), b"\1\0\0\0" * 40)
    writer.add(None, bytes(range(256)) * 4)
    writer.close()
    assert seekable.Reader(path).keys == [-(2**63), None]
    data = bytearray(open(path, "rb").read())
    data[seekable.Reader(path).offsets[1] + 40] ^= 1
    open(path, "wb").write(data)
    assert seekable.Reader(path).ids(0) == b"\1\0\0\0" * 40
    with pytest.raises(Exception):
        seekable.Reader(path).ids(1)


def test_empty_table(spark, documents):
    manifest = seekable.write_ids(documents([]), common.scratch(spark, "t"), tokens.vocabulary(BYTE_BPE), 2, 2)
    assert manifest == [] and seekable.read_ids(spark, manifest).count() == 0
    assert packing.pack(documents([]), tokens.vocabulary(BYTE_BPE), 0).count() == 0


def test_packing_places_every_id_once(documents, odd, library):
    rows = [*odd, *((100 + k, "many more words to pack here " * (k % 37)) for k in range(600))]
    got = packing.pack(documents(rows), tokens.vocabulary(BYTE_BPE), 0).collect()
    windows, pieces = {}, {}
    for r in got:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for spans in windows.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    for doc_id, text in rows:
        ids = ids_of(library, text) + [0]
        copies = 2 if doc_id == 5 else 1
        cover = sorted(pieces[doc_id])
        assert sum(p[1] for p in cover) == copies * len(ids)
        for start, length, check, total in cover:
            part = ids[start : start + length]
            assert total == len(ids) and check == zlib.crc32(struct.pack(f"<{length}I", *part))
    total = sum(r.length for r in got)
    assert total / (packing.CAPACITY * len(windows)) > 0.93


def test_differencing_is_near_even_and_grows_when_full():
    sizes = [100, 90, 80, 70, 60, 50, 40, 30, 20, 10]
    sums = [sum(sizes[k] for k in part) for part in packing.differencing(sizes, 3)]
    assert sum(sums) == 550 and max(sums) - min(sums) <= 10
    assert sorted(k for w in packing.windows([7, 7, 7], 10) for k in w) == [0, 1, 2]
    assert len(packing.windows([7, 7, 7], 10)) == 3
