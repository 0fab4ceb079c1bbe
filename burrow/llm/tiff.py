"""TIFF columns: a writer, a reader that walks image directories, and their DataFrame operators.

Reading handles both byte orders, chains of directories, strips and tiles, chunky
and planar samples of 1, 4, 8, 16 or 32 bits, no compression, PackBits, LZW and deflate,
and the horizontal predictor. ``tiff_pages`` emits one row per page; where a file can't be
read any further it gives one row with page -1 and the reason in ``error``, whatever is
wrong with it. What a file claims is checked before memory is taken for it: a page has at
most ``MOST_BYTES``, and a strip or tile is decoded up to the bytes it needs.

Nulls: null bytes give no page; a null text counts as an empty text. Empty
texts give a payload of one padding unit. Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format.
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_BYTES, FORMAT = 322, 323, 324, 325, 339
_SIZES = {1: "B", 3: "H", 4: "I", 16: "Q"}

#: A payload is padded with spaces to a multiple of this: a row of 64 RGB pixels.
UNIT = 192
_WIDE = 64
_PAGE_ROWS, _ROWS_A_STRIP = 8192, 512
#: Directories beyond this many mean a loop or a damaged file.
MOST_PAGES = 1 << 20
#: Bytes of a page's samples, at most.
MOST_BYTES = 1 << 28


class TiffError(ValueError):
    pass


@dataclass
class Page:
    index: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    layout: str
    pixels: np.ndarray  # height x width x samples


def packbits_decode(data: bytes, need: int = MOST_BYTES) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < need:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        j = i + 1
        while j < len(data) and j - i < 128 and data[j] == data[i]:
            j += 1
        if j - i > 1:
            out += bytes((257 - (j - i), data[i]))
        else:
            while j < len(data) and j - i < 128 and (j + 1 >= len(data) or data[j] != data[j + 1]):
                j += 1
            out += bytes((j - i - 1,)) + data[i:j]
        i = j
    return bytes(out)


def lzw_decode(data: bytes, need: int = MOST_BYTES) -> bytes:
    """Codes of 9 to 12 bits, high bit first; the width grows one code early."""
    done = 0
    base = [bytes((k,)) for k in range(256)] + [b"", b""]
    table, out, last, width = list(base), [], b"", 9
    held = bits = 0
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == 256:
            table, last, width = list(base), b"", 9
            continue
        if code == 257 or done >= need:
            break
        if not last:
            if code > 255:
                raise TiffError("LZW code out of range")
            now = table[code]
        elif code < len(table):
            now = table[code]
            table.append(last + now[:1])
        elif code == len(table):
            now = last + last[:1]
            table.append(now)
        else:
            raise TiffError("LZW code out of range")
        out.append(now)
        done += len(now)
        last = now
        width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    table, width, word = {bytes((k,)): k for k in range(256)}, 9, b""
    put(256, 9)
    for k in range(len(data)):
        longer = word + data[k : k + 1]
        if longer in table:
            word = longer
            continue
        put(table[word], width)
        table[longer] = len(table) + 2
        size = len(table) + 2
        width = 12 if size >= 2048 else 11 if size >= 1024 else 10 if size >= 512 else 9
        if size >= 4094:
            put(256, width)
            table, width = {bytes((k,)): k for k in range(256)}, 9
        word = data[k : k + 1]
    if word:
        put(table[word], width)
        size = len(table) + 3
        width = 12 if size >= 2048 else 11 if size >= 1024 else 10 if size >= 512 else 9
    put(257, width)
    if bits:
        out.append(held << 8 - bits & 255)
    return bytes(out)


def _inflate(data: bytes, need: int) -> bytes:
    try:
        return zlib.decompressobj().decompress(data, need)
    except zlib.error as e:
        raise TiffError(f"deflate: {e}") from None


_DECODERS = {NONE: lambda data, need: data[:need], PACKBITS: packbits_decode, LZW: lzw_decode, DEFLATE: _inflate, OLD_DEFLATE: _inflate}
_ENCODERS = {NONE: bytes, PACKBITS: packbits_encode, LZW: lzw_encode, DEFLATE: lambda b: zlib.compress(b, 1)}


def _differ(block: np.ndarray) -> np.ndarray:
    out = block.copy()
    out[:, 1:] -= block[:, :-1]
    return out


def encode(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, tile: tuple[int, int] | None = None, order: str = "<", strip_rows: int = _ROWS_A_STRIP) -> bytes:
    """A TIFF of the given pages, each height x width x samples of unsigned 8, 16 or 32 bits."""
    out = bytearray(struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 8))
    link = 4
    for pixels in pages:
        height, width, samples = pixels.shape
        if tile:
            (tw, th), blocks = tile, []
            for y in range(0, height, th):
                for x in range(0, width, tw):
                    block = np.zeros((th, tw, samples), pixels.dtype)
                    part = pixels[y : y + th, x : x + tw]
                    block[: part.shape[0], : part.shape[1]] = part
                    blocks.append(block)
        else:
            blocks = [pixels[y : y + strip_rows] for y in range(0, height, strip_rows)]
        at, sizes = [], []
        for block in blocks:
            block = _differ(block) if predictor == 2 else block
            data = _ENCODERS[compression](block.astype(block.dtype.newbyteorder(order)).tobytes())
            at.append(len(out))
            sizes.append(len(data))
            out += data
        out += b"\0" * (len(out) % 2)
        tags = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [pixels.dtype.itemsize * 8] * samples), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [2 if samples == 3 else 1]), (SAMPLES, 3, [samples]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])]
        tags += [(TILE_WIDTH, 4, [tile[0]]), (TILE_HEIGHT, 4, [tile[1]]), (TILE_AT, 4, at), (TILE_BYTES, 4, sizes)] if tile else [(STRIP_AT, 4, at), (STRIP_ROWS, 4, [strip_rows]), (STRIP_BYTES, 4, sizes)]
        entries = b""
        for tag, kind, values in sorted(tags):
            packed = struct.pack(f"{order}{len(values)}{_SIZES[kind]}", *values)
            if len(packed) > 4:
                where = struct.pack(order + "I", len(out))
                out += packed + b"\0" * (len(packed) % 2)
            else:
                where = packed.ljust(4, b"\0")
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + where
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries) // 12) + entries
        link = len(out)
        out += b"\0\0\0\0"
    if not pages:
        struct.pack_into(order + "I", out, 4, 0)
    return bytes(out)


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple[int, ...]], int]:
    try:
        (n,) = struct.unpack_from(order + "H", data, at)
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if (code := _SIZES.get(kind)) is None:
                continue
            where = at + 10 + 12 * k
            if struct.calcsize(code) * count > 4:
                (where,) = struct.unpack_from(order + "I", data, where)
            tags[tag] = struct.unpack_from(f"{order}{count}{code}", data, where)
        return tags, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]
    except struct.error as e:
        raise TiffError(f"directory at {at}: {e}") from None


def decode(data: bytes) -> Iterator[Page]:
    """The pages of a TIFF in the order of its directories; raises TiffError."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(bytes(data[:4]))
    if order is None:
        raise TiffError("not a TIFF")
    (at,) = struct.unpack_from(order + "I", data, 4) if len(data) >= 8 else (0,)
    seen: set[int] = set()
    while at:
        if at in seen or len(seen) >= MOST_PAGES:
            raise TiffError("directories form a loop")
        seen.add(at)
        tags, at = _directory(data, at, order)
        yield _page(data, tags, order, len(seen) - 1)


def _samples(raw: bytes, rows: int, n: int, bits: int, kind: np.dtype) -> np.ndarray:
    """Rows of n samples; those of less than a byte are packed, the high bits first, and each row begins a byte."""
    if bits >= 8:
        return np.frombuffer(raw, kind).reshape(rows, n)
    packed = np.frombuffer(raw, np.uint8).reshape(rows, -1)
    if bits == 1:
        return np.unpackbits(packed, axis=1, count=n)
    return np.stack([packed >> 4, packed & 15], axis=2).reshape(rows, -1)[:, :n]


def _page(data: bytes, tags: dict[int, tuple[int, ...]], order: str, index: int) -> Page:
    one = lambda tag, default=None: tags[tag][0] if tags.get(tag) else default
    width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    bits, compression, predictor, planar = one(BITS, 1), one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1)
    if not width or not height:
        raise TiffError("no size")
    if bits not in (1, 4, 8, 16, 32) or any(b != bits for b in tags.get(BITS, ())) or one(FORMAT, 1) != 1:
        raise TiffError(f"{bits}-bit samples of format {one(FORMAT, 1)} aren't supported")
    if compression not in _DECODERS or predictor not in (1, 2) or predictor == 2 and bits < 8:
        raise TiffError(f"compression {compression}, predictor {predictor} aren't supported")
    tiled = TILE_AT in tags
    at, sizes = (tags[TILE_AT], tags.get(TILE_BYTES)) if tiled else (tags.get(STRIP_AT), tags.get(STRIP_BYTES))
    if not at or not sizes or len(at) != len(sizes):
        raise TiffError("no strips or tiles")
    bw, bh = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(STRIP_ROWS, height), height))
    if not bw or not bh:
        raise TiffError("strips or tiles without a size")
    across, down = -(-width // bw), -(-height // bh)
    planes, each = (samples, 1) if planar == 2 else (1, samples)
    if len(at) < across * down * planes:
        raise TiffError("strips or tiles are missing")
    if width * height * samples * max(bits, 8) // 8 > MOST_BYTES or bw * bh * each * max(bits, 8) // 8 > MOST_BYTES:
        raise TiffError(f"{width} x {height} samples are too many")
    kind = np.dtype(f"u{max(bits // 8, 1)}").newbyteorder(order)
    pixels = np.empty((height, width, samples), kind.newbyteorder("="))
    for k in range(across * down * planes):
        plane, cell = divmod(k, across * down)
        y, x = cell // across * bh, cell % across * bw
        rows = bh if tiled else min(bh, height - y)
        line = -(-bw * each * bits // 8)
        need = rows * line
        raw = _DECODERS[compression](data[at[k] : at[k] + sizes[k]], need)
        if len(raw) < need:
            raise TiffError(f"block {k} has {len(raw)} of {need} bytes")
        block = _samples(raw[:need], rows, bw * each, bits, kind).reshape(rows, bw, each).astype(pixels.dtype)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=pixels.dtype)
        part = block[: height - y, : width - x]
        pixels[y : y + part.shape[0], x : x + part.shape[1], slice(None) if planar != 2 else slice(plane, plane + 1)] = part
    return Page(index, width, height, samples, bits, compression, predictor, "tiles" if tiled else "strips", pixels)


PAGES = "id long, page int, width int, height int, samples int, bits int, compression int, predictor int, layout string, pixels binary, error string"


def tiff_pages(files: DataFrame, id_col: str, bytes_col: str) -> DataFrame:
    """One row per page of each file, with its decoded samples in row order (native byte order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), *((c, pa.int32()) for c in ("page", "width", "height", "samples", "bits", "compression", "predictor")), ("layout", pa.string()), ("pixels", pa.binary()), ("error", pa.string())])
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not data.is_valid:
                    continue
                try:
                    for p in decode(data.as_py()):
                        yield pa.RecordBatch.from_pylist([{"id": key, "page": p.index, "width": p.width, "height": p.height, "samples": p.samples, "bits": p.bits, "compression": p.compression, "predictor": p.predictor, "layout": p.layout, "pixels": p.pixels.tobytes(), "error": None}], schema)
                except (TiffError, ValueError, IndexError, OverflowError, MemoryError, struct.error) as e:  # of a damaged file
                    yield pa.RecordBatch.from_pylist([{"id": key, "page": -1, "error": f"{e or type(e).__name__}"}], schema)

    return files.select(F.col(id_col).cast("long").alias("id"), F.col(bytes_col).cast("binary").alias("bytes")).mapInArrow(run, PAGES)


def text_payload(text: bytes) -> bytes:
    return text.ljust(max(1, -(-len(text) // UNIT)) * UNIT, b" ")


def text_tiff(text: bytes) -> bytes:
    """The text as rows of 64 RGB pixels, over as many pages as it needs."""
    rows = np.frombuffer(text_payload(text), np.uint8).reshape(-1, _WIDE, 3)
    return encode([rows[k : k + _PAGE_ROWS] for k in range(0, len(rows), _PAGE_ROWS)])


def feature(pages: list[Page]) -> str:
    """Pages and rows, the sums of the three channels, and one bit for each column at or above the median column."""
    columns = sum(p.pixels.sum(axis=0, dtype=np.int64) for p in pages)
    gray = columns.sum(axis=1)
    marks = np.packbits(gray >= np.median(gray)).tobytes().hex()
    return f"{len(pages)}:{sum(p.height for p in pages)}:{'-'.join(map(str, columns.sum(axis=0)))}:{marks}"


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages int"


def text_media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text as a TIFF, reads the stored bytes back page by page, and describes both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(9)]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or b""
                media = text_tiff(text)
                pages = list(decode(media))
                back = b"".join(p.pixels.tobytes() for p in pages)
                row = (key, len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(pages), len(pages))
                for c, v in zip(columns, row, strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in DIGEST.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, DIGEST)
