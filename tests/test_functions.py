"""Hashes and byte codecs."""

import random
import struct

import pytest

from palimpsest.functions import codec
from palimpsest.functions.blake3 import blake3, blake3_many, tree_root

# Published test vectors of BLAKE3 (input: i modulo 251).
VECTORS = {
    2049: "5f4d72f40d7a5f82b15ca2b2e44b1de3c2ef86c426c95c1af0b6879522563030",
    3072: "b98cb0ff3623be03326b373de6b9095218513e64f1ee2edd2525c7ad1e5cffd2",
    4096: "015094013f57a5277b59d8475c0501042c0b642e531b0a1c8f58d2163229e969",
    5121: "628bd2cb2004694adaab7bbd778a25df25c47b9d4155a55f8fbd79f2fe154cff",
}


def test_blake3_vectors():
    assert blake3(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert blake3(b"abc").hex() == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"
    for n, want in VECTORS.items():
        assert blake3(bytes(i % 251 for i in range(n))).hex() == want


def test_blake3_side_by_side():
    sizes = [0, 1, 63, 64, 65, 1023, 1024, 1025, 2048, 2049, 3072, 4097, 7000, 16_384, 70_000]
    data = [bytes((i * n) % 251 for i in range(n)) for n in sizes] * 2
    assert blake3_many(data, 20_000) == blake3_many(data) == [blake3(x) for x in data]


def test_tree_root_depends_on_everything():
    roots = {tree_root(*x) for x in [(b"d", 5, 8, [b"a"]), (b"e", 5, 8, [b"a"]), (b"d", 6, 8, [b"a"]), (b"d", 5, 9, [b"a"]), (b"d", 5, 8, [])]}
    assert len(roots) == 5


def test_varints():
    for value in [0, 1, 127, 128, 16383, 16384, 2**35, 2**64 - 1]:
        data = codec.varint(value)
        assert codec.read_varint(data + b"x", 0) == (value, len(data))
    for bad in (b"\x80", b"\xff" * 10, b"\x80" * 10):
        with pytest.raises(ValueError):
            codec.read_varint(bad, 0)


def one_by_one(data, minimum, average, maximum):
    out, start, gear = [], 0, 0
    for i, b in enumerate(data):
        gear = ((gear << 1) + int(codec.GEAR[b])) % 2**64
        n = i + 1 - start
        if n >= minimum and (n == maximum or gear & (average - 1) == 0):
            out.append(i + 1)
            start, gear = i + 1, 0
    return out if start == len(data) else [*out, len(data)]


def test_chunk_ends_equal_the_rolling_hash_byte_by_byte():
    r = random.Random(3)
    for _ in range(60):
        data = bytes(r.choice(range(r.choice([2, 7, 256]))) for _ in range(r.randint(0, 3000)))
        for average in (32, 64, 2048):
            sizes = codec.chunk_sizes(len(data), average)
            assert codec.chunk_ends(data, *sizes) == one_by_one(data, *sizes)


def edited(r, source):
    parts = []
    for _ in range(r.randint(1, 6)):
        a = r.randint(0, max(0, len(source) - 1))
        parts.append(r.choice([source[a : a + r.randint(0, 600)], r.randbytes(r.randint(0, 300)), bytes(r.randint(0, 30)), b"\7" * r.randint(0, 30)]))
    return b"".join(parts) or b"x"


def test_streams_round_trip():
    r = random.Random(5)
    for _ in range(300):
        source = r.randbytes(r.randint(1, 2500))
        target = edited(r, source)
        base, place = r.choice([0, 70_000]), r.choice([0, 70_010, 500])
        for ops in (
            codec.chunk_ops(source, target, base, 8, 32, 128),
            codec.sparse_ops(source[: len(target)], target[: len(source)], base) if min(len(source), len(target)) else [],
        ):
            size = sum(n for *_, n in ops)
            if not size:
                continue
            made = target[:size]
            stream, count = codec.encode_ops(ops, target, base, place)
            assert codec.decode_ops(stream, source, base, len(source), place, size, count) == made


def test_opcodes_by_hand():
    target = b"abcdefgh" + bytes(9) + b"\7" * 8 + b"z"
    ops = [("COPY", 100, 3), ("ADD", 0, 2), ("COPY", 5, 300), ("COPY", 400, 7), ("ADD", 8, 300)]
    body = codec.encode_ops(ops[:2], target, 100, 100)[0][8:]
    assert body == bytes([10, 0, 3, 2]) + target[:2] + b"\0"
    body = codec.encode_ops([ops[2], ops[3]], target, 0, 99)[0][8:]
    assert body == struct.pack("<BHH", 2, 5, 300) + struct.pack("<BhH", 4, 95, 7) + b"\0"
    assert codec.encode_ops([("ADD", 8, 9)], target, 0, 0)[0][8:] == bytes([9, 9, 0])
    assert codec.encode_ops([("ADD", 17, 8)], target, 0, 0)[0][8:] == bytes([8, 7, 8, 0])
    assert codec.encode_ops([("COPY", 7, 256)], target, 0, 7)[0][8:] == bytes([1, 255, 0])
    assert codec.encode_ops([("COPY", 70_000, 5)], target, 0, 7)[0][8:] == bytes([3]) + codec.varint(70_000) + bytes([5, 0])
    assert codec.encode_ops([("COPY", 0, 1), ("COPY", 5, 1)] * 40_000, target, 0, 0) is None


def test_decoder_never_crashes():
    r = random.Random(9)
    source = bytes(64)
    for _ in range(3000):
        stream = codec.OPS_MAGIC + bytes(r.choice([0, 1, 2, 3, 5, 6, 7, 8, 9, 10, 63, 64, 200]) for _ in range(r.randint(0, 12)))
        try:
            assert len(codec.decode_ops(stream, source, 0, 64, 0, 64, r.randint(0, 3))) == 64
        except ValueError:
            pass


def test_zstd_frames():
    data = b"hello " * 500
    packed = codec.compress(data, 3)
    assert codec.decompress(packed, len(data)) == data
    for bad, size in ((packed, len(data) - 1), (packed + b"x", len(data)), (packed[:-1], len(data)), (b"nonsense", 5), (packed + packed, len(data))):
        with pytest.raises(Exception):
            codec.decompress(bad, size)


def test_scores():
    assert codec.score("DELTA_ZSTD", 100, 640, 3, 1600, "apply-speed") == 100 + 96 + 100 + 10 + 512
    assert codec.score("DELTA_RAW", 100, 640, 3, 1600, "balanced") == 100 + 12 + 12
    assert codec.score("REPLACE_ZSTD", 100, 1024, 0, 0, "balanced") == 102
    assert codec.score("DELTA_ZSTD", 100, 640, 3, 1600, "patch-size") == 100


def test_options():
    from palimpsest.functions import options as o

    assert [o.parse_size(x) for x in ("12", "1k", "2 KiB", "3mb", "1G")] == [12, 1024, 2048, 3 << 20, 1 << 30]
    assert o.parse_memory("auto") is None and o.parse_memory("128MiB") == 128 << 20
    assert o.parse_window_size(" Auto ") == "auto" and o.parse_window_size("1m") == 1 << 20
    assert [o.parse_mode(x) for x in ("", " Speed", "SIZE", "balanced")] == ["balanced", "apply-speed", "patch-size", "balanced"]
    assert o.parse_verify("") == "referenced"
    for f, bad in ((o.parse_size, "x"), (o.parse_size, "1.5k"), (o.parse_size, "9999999999g"), (o.parse_memory, "1m"), (o.parse_window_size, "3m"), (o.parse_mode, "fast"), (o.parse_verify, "none")):
        with pytest.raises(ValueError):
            f(bad)
