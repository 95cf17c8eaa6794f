from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from quarry.llm import tiff


@given(st.binary(max_size=5000))
@settings(max_examples=60, deadline=None)
def test_codecs_round_trip(data):
    assert tiff.unpack_bits(tiff.pack_bits(data)) == data
    assert tiff.decode_lzw(tiff.encode_lzw(data)) == data


def test_lzw_through_all_widths_and_a_clear():
    data = np.random.default_rng(1).integers(0, 40, 60_000, np.uint8).tobytes()
    assert tiff.decode_lzw(tiff.encode_lzw(data)) == data


@pytest.mark.parametrize("compression", ["none", "lzw", "deflate", "packbits"])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [0, 16])
def test_pages_come_back(compression, predictor, tile):
    data = np.random.default_rng(2).integers(0, 9, 64 * 150, np.uint8).tobytes()
    media = tiff.encode(data, page_rows=70, strip_rows=32, compression=compression, predictor=predictor, tile=tile)
    found = list(tiff.pages(media))
    assert [p.height for p in found] == [70, 70, 10]
    assert b"".join(p.pixels for p in found) == data


def test_big_endian_wide_samples_in_planes():
    image = np.arange(2 * 3 * 2, dtype=">u2").reshape(2, 3, 2)  # rows, columns, samples
    planes = [np.ascontiguousarray(image[:, :, k]).tobytes() for k in (0, 1)]
    fields = [(256, 3, 1, 3 << 16), (257, 3, 1, 2 << 16), (258, 3, 1, 16 << 16), (259, 3, 1, 1 << 16), (273, 4, 2, 200), (277, 3, 1, 2 << 16), (278, 3, 1, 2 << 16), (279, 4, 2, 208), (284, 3, 1, 2 << 16)]
    out = bytearray(300)
    out[:8] = b"MM\0*" + struct.pack(">I", 8)
    out[8 : 10 + 12 * len(fields) + 4] = struct.pack(">H", len(fields)) + b"".join(struct.pack(">HHII", *f) for f in fields) + bytes(4)
    out[200:216] = struct.pack(">IIII", 240, 240 + len(planes[0]), len(planes[0]), len(planes[1]))
    out[240:] = planes[0] + planes[1]
    (page,) = tiff.pages(bytes(out))
    assert page.pixels == image.astype("<u2").tobytes()


def test_damaged_files():
    media = tiff.encode(bytes(64))
    for bad in (b"no", media[:4] + struct.pack("<I", 5) + media[8:], b"II*\0" + media[4:].replace(struct.pack("<HHII", 259, 3, 1, 8), struct.pack("<HHII", 259, 3, 1, 99))):
        with pytest.raises(ValueError):
            list(tiff.pages(bad))


def test_query_against_brute_force(make_docs, odd_texts):
    out = {r["doc_id"]: r for r in tiff.media_digests(make_docs(odd_texts)).collect()}
    assert len(out) == len(odd_texts)
    by_text = {}
    for k, text in enumerate(odd_texts):
        data = (text or "").encode()
        payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        r = out[k]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload))
        assert (r["payload_sha256"], r["tail_crc32"]) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        media = tiff.encode(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        assert by_text.setdefault(text or "", r["feature"]) == r["feature"]


def test_rows_of_pages(spark, make_docs):
    media = tiff.encode(bytes(range(64)) * 10, page_rows=4)
    df = spark.createDataFrame([(1, bytearray(media)), (2, None)], "page int, m binary")
    assert [(r["page"], r["height"]) for r in tiff.read_pages(df.withColumnRenamed("page", "k"), "k", "m").collect()] == [(0, 4), (1, 4), (2, 2)]
    assert tiff.media_digests(make_docs(["a"]).limit(0)).count() == 0


def test_a_damaged_file_does_not_end_the_job(spark):
    good = tiff.encode(bytes(range(64)) * 8, page_rows=4)
    rows = [(1, good), (2, b"no image"), (3, good[: len(good) // 2]), (4, None), (5, good)]
    found = tiff.read_pages(spark.createDataFrame(rows, "id int, media binary"), "id", "media").collect()
    assert sorted((r["id"], r["page"]) for r in found if r["error"] is None and r["id"] in (1, 5)) == [(1, 0), (1, 1), (5, 0), (5, 1)]
    assert [r["id"] for r in found if r["error"] is not None and r["page"] is None] == [2, 3]
