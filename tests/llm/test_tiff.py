import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import tiff
from tests.llm.helpers import DOC_SCHEMA, documents, edge_texts


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_codecs_round_trip(data):
    assert tiff.unpack_bits(tiff.pack_bits(data), len(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data


def test_known_bytes():
    # The examples of the specifications.
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    assert tiff.unpack_bits(packed, 24) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    codes, bits = [256, 7, 258, 8, 8, 258, 6, 6, 257], ""
    for c in codes:
        bits += f"{c:09b}"
    bits += "0" * (-len(bits) % 8)
    assert tiff.lzw_decode(int(bits, 2).to_bytes(len(bits) // 8, "big"), 99) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
def test_pages_round_trip(compression, predictor, tile):
    rng = np.random.default_rng(1)
    pages = [rng.integers(0, 9, (37, 50)).astype(np.uint8), rng.integers(0, 256, (5, 7, 3)).astype(np.uint8)]
    for order in "<>":
        got = list(tiff.walk(tiff.encode(pages, compression, predictor, 8, tile, order)))
        assert [g[0] for g in got] == [0, 1] and (got[0][2][:, :, 0] == pages[0]).all() and (got[1][2] == pages[1]).all()


def test_broken_files(spark):
    good = tiff.encode([np.zeros((4, 4), np.uint8)])
    loop = bytearray(good)
    first = struct.unpack_from("<I", good, 4)[0]
    struct.pack_into("<I", loop, len(loop) - 4, first)
    rows = [(1, good), (2, None), (3, b"II*"), (4, bytes(loop)), (5, good[:40])]
    got = tiff.pages(spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, b in rows], "id long, data binary"), "id", "data").collect()
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append((r["page"], r["error"] is None))
    assert by == {1: [(0, True)], 2: [(None, False)], 3: [(None, False)], 4: [(0, True), (None, False)], 5: [(None, False)]}


@pytest.mark.parametrize(("tag", "value"), [(258, 16), (tiff.COMPRESSION, 7)])
def test_pages_after_a_bad_one_are_read(tag, value):
    data = bytearray(tiff.encode([np.full((4, 4), i, np.uint8) for i in range(3)]))
    at = struct.unpack_from("<I", data, 4)[0]
    entry = next(at + 2 + 12 * i for i in range(struct.unpack_from("<H", data, at)[0]) if struct.unpack_from("<H", data, at + 2 + 12 * i)[0] == tag)
    struct.pack_into("<H", data, entry + 8, value)
    got = list(tiff.walk(bytes(data)))
    assert [(g[0], g[3] is None) for g in got] == [(0, False), (1, True), (2, True)] and [int(g[2].max()) for g in got[1:]] == [1, 2]


def test_texts_come_back(spark):
    texts = edge_texts()
    rows = {r["doc_id"]: r for r in tiff.documents(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload)) and r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-32:]) and r["media_sha256"] == hashlib.sha256(tiff.stored(payload)).hexdigest()
    assert rows[7]["feature"] == rows[8]["feature"]
    assert tiff.documents(spark.createDataFrame([], DOC_SCHEMA)).count() == 0


def patched(**values):
    """A file of three pages, two of them good; the first one's tags have other values."""
    data = bytearray(tiff.encode([np.full((4, 4), i, np.uint8) for i in range(3)]))
    at = struct.unpack_from("<I", data, 4)[0]
    for i in range(struct.unpack_from("<H", data, at)[0]):
        tag, kind, n = struct.unpack_from("<HHI", data, at + 2 + 12 * i)
        if (name := f"t{tag}") in values:
            struct.pack_into("<H" if kind == 3 else "<I", data, at + 10 + 12 * i, values[name])
    return bytes(data)


@pytest.mark.parametrize("values", [{"t277": 0, "t284": 2}, {"t256": 1_000_000, "t257": 1_000_000}, {"t256": 0}, {"t257": 0}, {"t278": 0}, {"t256": 0xFFFFFFFF, "t257": 0xFFFFFFFF, "t278": 0xFFFFFFFF}, {"t277": 60_000}, {"t279": 0}, {"t273": 0xFFFFFFF0}])
def test_hostile_headers_are_rows_with_a_reason(values):
    got = list(tiff.walk(patched(**values)))
    assert [g[0] for g in got] == [0, 1, 2] and [int(g[2].max()) for g in got[1:]] == [1, 2]
    assert got[0][3] or values == {"t278": 0}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 400), st.integers(0, 255)), max_size=8))
def test_changed_bytes_never_raise(changes):
    data = bytearray(tiff.encode([np.zeros((4, 4), np.uint8), np.ones((3, 2, 3), np.uint8)], tile=(16, 16)))
    for at, value in changes:
        data[at % len(data)] = value
    for _, _, x, error in tiff.walk(bytes(data)):
        assert (x is None) == bool(error)
