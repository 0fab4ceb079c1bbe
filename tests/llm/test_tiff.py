import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from burrow.llm import tiff as T
from tests.llm.odd import no_documents, odd_documents


def picture(h, w, s, kind="u1", seed=0):
    return np.random.default_rng(seed).integers(0, 7, (h, w, s)).astype(kind) * np.dtype(kind).type(9)


@pytest.mark.parametrize("compression", [T.NONE, T.LZW, T.DEFLATE, T.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 16)])
@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("kind", ["u1", "u2"])
def test_pages_come_back(compression, predictor, tile, order, kind):
    pages = [picture(37, 21, 3, kind, 1), picture(5, 40, 1, kind, 2)]
    back = list(T.decode(T.encode(pages, compression, predictor, tile, order, strip_rows=8)))
    assert [p.index for p in back] == [0, 1] and back[0].layout == ("tiles" if tile else "strips")
    for page, want in zip(back, pages):
        assert page.compression == compression and page.predictor == predictor
        assert (page.pixels == want).all()


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=6000) | st.integers(0, 9000).map(lambda n: b"ab" * n))
def test_codecs_come_back(data):
    assert T.packbits_decode(T.packbits_encode(data)) == data
    assert T.lzw_decode(T.lzw_encode(data)) == data


def test_known_streams():
    # The example of the PackBits specification.
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    assert T.packbits_decode(packed) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    # The LZW example of the TIFF specification: 7 7 7 8 8 7 7 6 6 as codes 256 7 258 8 8 258 6 6 257.
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    stream = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert list(T.lzw_decode(stream)) == [7, 7, 7, 8, 8, 7, 7, 6, 6]


def test_planar_samples():
    want = picture(4, 6, 2)
    data = bytearray(T.encode([want], T.NONE, 1))
    at = struct.unpack_from("<I", data, 4)[0]
    planes = len(data)
    data += want[:, :, 0].tobytes() + want[:, :, 1].tobytes()
    where = len(data)
    data += struct.pack("<4I", planes, planes + 24, 24, 24)
    for k in range(struct.unpack_from("<H", data, at)[0]):
        tag = struct.unpack_from("<H", data, at + 2 + 12 * k)[0]
        if tag == T.PLANAR:
            struct.pack_into("<HII", data, at + 4 + 12 * k, 3, 1, 2)
        if tag == T.STRIP_AT:
            struct.pack_into("<HII", data, at + 4 + 12 * k, 4, 2, where)
        if tag == T.STRIP_BYTES:
            struct.pack_into("<HII", data, at + 4 + 12 * k, 4, 2, where + 8)
    assert (next(T.decode(bytes(data))).pixels == want).all()


@pytest.mark.parametrize("data", [b"", b"II*\0", b"PNG", T.encode([picture(8, 8, 1)])[:-40], b"II*\0\x08\0\0\0\xff\xff"])
def test_damaged_files_raise(data):
    with pytest.raises(T.TiffError):
        list(T.decode(data)) or (_ for _ in ()).throw(T.TiffError("nothing"))


def test_a_loop_of_directories_ends():
    data = bytearray(T.encode([picture(2, 2, 1)]))
    struct.pack_into("<I", data, len(data) - 4, struct.unpack_from("<I", data, 4)[0])
    with pytest.raises(T.TiffError, match="loop"):
        list(T.decode(bytes(data)))


def test_one_row_per_page(spark):
    files = [(1, bytearray(T.encode([picture(9, 9, 3), picture(3, 3, 1)], T.LZW))), (2, bytearray(b"no")), (3, None)]
    rows = sorted(T.tiff_pages(spark.createDataFrame(files, "id long, data binary"), "id", "data").collect(), key=lambda r: (r.id, r.page))
    assert [(r.id, r.page, r.width, r.error is None) for r in rows] == [(1, 0, 9, True), (1, 1, 3, True), (2, -1, None, False)]
    assert bytes(rows[0].pixels) == picture(9, 9, 3).tobytes()


def test_digest_is_of_the_payload(spark):
    docs = odd_documents(spark)
    got = {(r.doc_id, r.n_bytes): r for r in T.text_media_digest(docs).collect()}
    for r in docs.collect():
        text = (r.text or "").encode()
        payload = text + b" " * (-len(text) % 192 if text else 192)
        g = got[r.doc_id, len(text)]
        assert (g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        media = T.text_tiff(text)
        assert (g.media_bytes, g.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert T.text_media_digest(no_documents(spark)).count() == 0
    assert len(T.text_payload(b"x" * 192)) == 192 and len(T.text_payload(b"x" * 193)) == 384


@pytest.mark.parametrize("compression", [T.NONE, T.LZW, T.DEFLATE, T.PACKBITS])
def test_any_damage_gives_rows(spark, compression):
    rng, whole = np.random.default_rng(7), T.encode([picture(30, 20, 3), picture(9, 5, 1)], compression)
    files = []
    for k in range(300):
        data = bytearray(whole)
        for at in rng.integers(0, len(data), 1 + k % 6):
            data[at] = rng.integers(256)
        files.append((k, data[: rng.integers(8, len(data) + 1)] if k % 3 == 0 else data))
    rows = T.tiff_pages(spark.createDataFrame(files, "id long, data binary").repartition(2), "id", "data").collect()
    assert {r.id for r in rows if r.page >= 0 or r.error} >= {k for k, d in files if len(d) >= 8 and struct.unpack_from("<I", d, 4)[0]}


def with_tags(data, changes):
    """The file with other values in entries of its first directory."""
    out, at = bytearray(data), struct.unpack_from("<I", data, 4)[0]
    for k in range(struct.unpack_from("<H", out, at)[0]):
        where = at + 2 + 12 * k
        if (tag := struct.unpack_from("<H", out, where)[0]) in changes:
            struct.pack_into("<HII", out, where + 2, 4, 1, changes[tag])
    return bytes(out)


def test_samples_of_less_than_a_byte():
    rng = np.random.default_rng(3)
    for bits, width in ((1, 21), (4, 7)):
        want = rng.integers(0, 1 << bits, (9, width, 1)).astype(np.uint8)
        packed = np.packbits(want[:, :, 0], axis=1) if bits == 1 else (lambda p: p[:, ::2] << 4 | p[:, 1::2])(np.pad(want[:, :, 0], ((0, 0), (0, 1))))
        for compression in (T.NONE, T.PACKBITS, T.LZW, T.DEFLATE):
            data = with_tags(T.encode([packed[:, :, None]], compression, 1), {T.WIDTH: width, T.BITS: bits})
            assert (next(T.decode(data)).pixels == want).all()


def test_claims_are_checked_before_memory_is_taken():
    data = T.encode([picture(8, 8, 1)], T.DEFLATE, 1)
    for changes in ({T.WIDTH: 1 << 31}, {T.HEIGHT: 1 << 31, T.STRIP_ROWS: 1 << 31}, {T.SAMPLES: 1 << 30}):
        with pytest.raises(T.TiffError):
            list(T.decode(with_tags(data, changes)))
    bomb = zlib.compress(bytes(1 << 20))
    assert len(T._inflate(bomb, 100)) == 100


def test_feature_equals_a_plain_count():
    text = ("some words é " * 700).encode()
    pages = list(T.decode(T.text_tiff(text)))
    payload = T.text_payload(text)
    rows = len(payload) // 192
    column = [sum(payload[192 * r + 3 * c + s] for r in range(rows) for s in range(3)) for c in range(64)]
    middle = sorted(column)
    median = (middle[31] + middle[32]) / 2
    marks = "".join("1" if x >= median else "0" for x in column)
    channels = "-".join(str(sum(payload[s::3])) for s in range(3))
    assert T.feature(pages) == f"{len(pages)}:{rows}:{channels}:{int(marks, 2):016x}"
