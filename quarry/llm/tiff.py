"""TIFF media columns: an image-directory walker with PackBits, LZW and deflate, and a lossless encoder.

``read_pages`` gives one row a page of each media value; ``encode`` stores 8-bit samples as such a file.

Defined results: null media give no rows, as do files without a directory. Of a damaged file, or one with an unknown
compression or predictor, ``read_pages`` gives the pages before the fault and a row with its ``error``; ``pages`` raises
ValueError. For ``media_digests`` a null text is an empty one, whose payload is 64 zero bytes.
Repeated rows each get their result. Only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Field type sizes, tags and compressions of the TIFF 6.0 specification.
TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 322, 323, 324, 325, 339
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
CODES = {"none": NONE, "lzw": LZW, "deflate": DEFLATE, "packbits": PACKBITS}


@dataclass(frozen=True)
class Page:
    number: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    pixels: bytes


def unpack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        head = data[i]
        if head < 128:
            out += data[i + 1 : i + 2 + head]
            i += 2 + head
        elif head > 128:
            out += data[i + 1 : i + 2] * (257 - head)
            i += 2
        else:
            i += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run > 2:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        start = i
        while i < n and i - start < 128 and not (i + 2 < n and data[i] == data[i + 1] == data[i + 2]):
            i += 1
        out.append(i - start - 1)
        out += data[start:i]
    return bytes(out)


def decode_lzw(data: bytes) -> bytes:
    """Codes are most significant bit first, and widen one code early, as TIFF has it."""
    fresh = [bytes((k,)) for k in range(256)] + [b"", b""]
    table, out, last = list(fresh), bytearray(), b""
    width, held, bits = 9, 0, 0
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = list(fresh), 9, b""
            continue
        if code < len(table):
            word = table[code]
        elif code == len(table) and last:
            word = last + last[:1]
        else:
            raise ValueError("damaged LZW data")
        out += word
        if last:
            table.append(last + word[:1])
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
        last = word
    return bytes(out)


def encode_lzw(data: bytes) -> bytes:
    out, held, bits, width = bytearray(), 0, 0, 9

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    put(256)
    table, word = {bytes((k,)): k for k in range(256)}, b""
    size = 258
    for k in range(len(data)):
        longer = word + data[k : k + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer], size = size, size + 1
        # The reader's table is one entry behind the writer's.
        if size >= 4095:
            put(256)
            table, size, width = {bytes((j,)): j for j in range(256)}, 258, 9
        elif size >= (1 << width):
            width += 1
        word = data[k : k + 1]
    if word:
        put(table[word])
        size += 1
        if size >= (1 << width) and width < 12:
            width += 1
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def unpacked(data: bytes, compression: int) -> bytes:
    if compression == NONE:
        return data
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    if compression == PACKBITS:
        return unpack_bits(data)
    if compression == LZW:
        return decode_lzw(data)
    raise ValueError(f"unknown compression {compression}")


def packed(data: bytes, compression: int) -> bytes:
    if compression == DEFLATE:
        return zlib.compress(data, 1)
    return {NONE: lambda x: x, PACKBITS: pack_bits, LZW: encode_lzw}[compression](data)


def _directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack(order + "I", data[4:8])[0], set()
    while at:
        if at in seen:
            raise ValueError("image directories form a loop")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        fields = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind not in TYPE_SIZES:
                continue
            size = TYPE_SIZES[kind] * count
            place = at + 2 + 12 * k + 8
            if size > 4:
                (place,) = struct.unpack_from(order + "I", data, place)
            if kind in (3, 4):
                fields[tag] = struct.unpack_from(f"{order}{count}{'H' if kind == 3 else 'I'}", data, place)
            else:
                fields[tag] = tuple(data[place : place + size])
        yield order, fields
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def _block(data: bytes, compression: int, predictor: int, order: str, bits: int, rows: int, width: int, samples: int) -> np.ndarray:
    """One strip or tile as rows x (width x samples), its differences summed up again."""
    kind = np.dtype(np.uint8 if bits == 8 else f"{order}u{bits // 8}")
    need = rows * width * samples * kind.itemsize
    raw = unpacked(data, compression)
    if len(raw) < need:
        raise ValueError("a strip or tile is too short")
    out = np.frombuffer(raw, kind, rows * width * samples).reshape(rows, width, samples)
    if predictor == 2:
        out = np.add.accumulate(out, axis=1, dtype=kind.newbyteorder("="))
    elif predictor != 1:
        raise ValueError(f"unknown predictor {predictor}")
    return out


def pages(data: bytes) -> Iterator[Page]:
    """Walk the image directories; the pixels come in row order, samples in native little-endian bytes."""
    try:
        yield from _pages(data)
    except (struct.error, zlib.error, IndexError, OverflowError) as e:
        raise ValueError(f"damaged file: {e}") from e


def _pages(data: bytes) -> Iterator[Page]:
    for number, (order, f) in enumerate(_directories(data)):
        if not {WIDTH, HEIGHT} <= f.keys() or not ({TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS} <= f.keys() or {STRIP_OFFSETS, STRIP_COUNTS} <= f.keys()):
            raise ValueError("an image directory lacks its size or its data")
        width, height, samples = f[WIDTH][0], f[HEIGHT][0], f.get(SAMPLES, (1,))[0]
        bits, compression, predictor = f.get(BITS, (1,))[0], f.get(COMPRESSION, (1,))[0], f.get(PREDICTOR, (1,))[0]
        if bits not in (8, 16, 32):
            raise ValueError(f"{bits} bits a sample are not supported")
        planes = samples if f.get(PLANAR, (1,))[0] == 2 else 1
        inner = samples // planes
        kind = np.dtype(f"<u{bits // 8}")
        tiled = TILE_OFFSETS in f
        bw, bh = (f[TILE_WIDTH][0], f[TILE_HEIGHT][0]) if tiled else (width, min(f.get(ROWS_PER_STRIP, (height,))[0], height) or 1)
        offsets, counts = (f[TILE_OFFSETS], f[TILE_COUNTS]) if tiled else (f[STRIP_OFFSETS], f[STRIP_COUNTS])
        across, down = -(-width // bw), -(-height // bh)
        image = np.empty((height, width, samples), kind)
        for k in range(planes * across * down):
            plane, place = divmod(k, across * down)
            y, x = place // across * bh, place % across * bw
            rows = bh if tiled else min(bh, height - y)
            got = _block(data[offsets[k] : offsets[k] + counts[k]], compression, predictor, order, bits, rows, bw, inner)
            part = got[: height - y, : width - x]
            image[y : y + part.shape[0], x : x + part.shape[1], plane * inner : (plane + 1) * inner] = part
        yield Page(number, width, height, samples, bits, compression, image.tobytes())


def encode(payload: bytes, width: int = 64, page_rows: int = 4096, strip_rows: int = 512, compression: str = "deflate", predictor: int = 2, tile: int = 0) -> bytes:
    """``payload`` (a positive multiple of ``width``) as 8-bit grey samples; a page holds ``page_rows`` rows at most."""
    code, out, link = CODES[compression], bytearray(b"II*\0\0\0\0\0"), 4
    samples = np.frombuffer(payload, np.uint8).reshape(-1, width)
    for top in range(0, len(samples), page_rows):
        image = samples[top : top + page_rows]
        if tile:
            blocks = [np.pad(b, ((0, tile - b.shape[0]), (0, tile - b.shape[1]))) for y in range(0, len(image), tile) for x in range(0, width, tile) if (b := image[y : y + tile, x : x + tile]).size]
        else:
            blocks = [image[y : y + strip_rows] for y in range(0, len(image), strip_rows)]
        offsets, counts = [], []
        for b in blocks:
            if predictor == 2:
                b = np.diff(b, axis=1, prepend=np.uint8(0))
            data = packed(b.tobytes(), code)
            offsets.append(len(out))
            counts.append(len(data))
            out += data
        if len(out) % 2:
            out.append(0)
        places = []
        for values in (offsets, counts):
            places.append(len(out) if len(values) > 1 else values[0])
            if len(values) > 1:
                out += struct.pack(f"<{len(values)}I", *values)
        fields = [(WIDTH, 4, 1, width), (HEIGHT, 4, 1, len(image)), (BITS, 3, 1, 8), (COMPRESSION, 3, 1, code), (PHOTOMETRIC, 3, 1, 1), (SAMPLES, 3, 1, 1), (PREDICTOR, 3, 1, predictor)]
        if tile:
            fields += [(TILE_WIDTH, 4, 1, tile), (TILE_HEIGHT, 4, 1, tile), (TILE_OFFSETS, 4, len(blocks), places[0]), (TILE_COUNTS, 4, len(blocks), places[1])]
        else:
            fields += [(STRIP_OFFSETS, 4, len(blocks), places[0]), (ROWS_PER_STRIP, 4, 1, strip_rows), (STRIP_COUNTS, 4, len(blocks), places[1])]
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + b"".join(struct.pack("<HHII", *x) for x in sorted(fields))
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


PAGE_SCHEMA = "page int, width int, height int, samples int, bits int, compression int, pixels binary, error string"


def read_pages(df: DataFrame, key: str, media: str) -> DataFrame:
    """``key`` and one row a page of the TIFF files in the binary column ``media``; a row with ``error`` ends a bad file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                data = batch.column(1)[row].as_py()
                if data is None:
                    continue
                found: list[Page] = []
                errors: list[str | None] = []
                try:
                    for p in pages(data):
                        found.append(p)
                        errors.append(None)
                except ValueError as e:
                    errors.append(str(e))
                read = [*found, None][: len(errors)]
                columns = [pa.array([getattr(p, n, None) for p in read], t) for n, t in (("number", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()), ("bits", pa.int32()), ("compression", pa.int32()), ("pixels", pa.binary()))]
                keys = pa.array([batch.column(0)[row].as_py()] * len(read), batch.column(0).type)
                yield pa.RecordBatch.from_arrays([keys, *columns, pa.array(errors, pa.string())], names=["key", "page", "width", "height", "samples", "bits", "compression", "pixels", "error"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(media).alias("media")).mapInArrow(run, f"key {kind}, {PAGE_SCHEMA}").withColumnRenamed("key", key)


DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def _feature(number: int, payload: bytes) -> str:
    """Pages, mean sample, and the 64-bit average hash of the columns' means."""
    columns = np.frombuffer(payload, np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    above = np.packbits(columns * 64 > columns.sum())
    return f"{number}:{columns.sum() / len(payload):.4f}:{above.tobytes().hex()}"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        ids = batch.column(0).to_pylist()
        for k in range(batch.num_rows):
            text = batch.column(1)[k].as_buffer()
            data = text.to_pybytes() if text is not None else b""
            payload = data + bytes(-len(data) % 64 if data else 64)
            media = encode(payload)
            found = list(pages(media))
            read = b"".join(p.pixels for p in found)
            rows.append((ids[k], len(data), len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-64:]), len(media), hashlib.sha256(media).hexdigest(), _feature(len(found), read)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, DIGEST.types, strict=True)], schema=DIGEST)


def media_digests(documents: DataFrame) -> DataFrame:
    """Store each text as a TIFF file, read its pages back and return what they hold."""
    slim = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return slim.mapInArrow(_digests, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
