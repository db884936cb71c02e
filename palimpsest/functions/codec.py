"""Byte codecs: varints, content-defined chunk cuts, edit operations and instruction streams."""

from __future__ import annotations

import struct

import numpy as np

from .constants import OPCODES, OPS_MAGIC

#: An edit operation: ("COPY", source offset, length) or ("ADD", target offset, length).
Op = tuple[str, int, int]


def splitmix64(n: int, seed: int = 0) -> list[int]:
    """``n`` numbers of the SplitMix64 generator."""
    out, state = [], seed
    for _ in range(n):
        state = (state + 0x9E3779B97F4A7C15) % 2**64
        z = state
        z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
        z = (z ^ (z >> 27)) * 0x94D049BB133111EB % 2**64
        out.append(z ^ (z >> 31))
    return out


#: Weights of the rolling hash, by rule; another table can be passed where one is taken.
GEAR = np.array(splitmix64(256), np.uint64)


def varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    """Value and next position; at most ten bytes, and no more than 64 bits."""
    value = 0
    for k in range(10):
        if at >= len(data):
            raise ValueError("a varint ends early")
        b = data[at]
        at += 1
        if k == 9 and b > 1:
            break
        value |= (b & 127) << (7 * k)
        if b < 128:
            return value, at
    raise ValueError("a varint is too long")


def chunk_sizes(output_size: int, average: int | None = None) -> tuple[int, int, int]:
    """Least, average and greatest chunk length for a window."""
    if average is None:
        average = 2048 if output_size < 64 << 10 else 8192 if output_size < 1 << 20 else 16384
    return average // 4, average, average * 4


def chunk_ends(data: bytes, minimum: int, average: int, maximum: int, gear: np.ndarray = GEAR) -> list[int]:
    """Ends of content-defined chunks.

    A rolling hash that shifts by one bit a byte has low bits that depend on the last few bytes
    only, so all places where a cut may fall are found at once; the least and greatest length
    are then applied over these few.  ``average`` is a power of two and ``minimum`` at least
    its number of bits.
    """
    n = len(data)
    bits = average.bit_length() - 1
    # Sums over 2, 4, 8 and 16 (or 32) last bytes; what is shifted out is not asked for.
    width, kind = (16, np.uint16) if bits <= 16 else (32, np.uint32)
    rolled = gear.astype(kind)[np.frombuffer(data, np.uint8)]
    age = 1
    while age < width and age < n:
        older = rolled
        rolled = older.copy()
        rolled[age:] += older[:-age] << kind(age)
        age *= 2
    marks = np.flatnonzero(rolled & kind(average - 1) == 0)
    out, start = [], 0
    while start < n:
        k = int(np.searchsorted(marks, start + minimum - 1))
        end = min(n, start + maximum, int(marks[k]) + 1 if k < len(marks) else n)
        out.append(end)
        start = end
    return out


def add_op(ops: list[Op], kind: str, offset: int, length: int) -> None:
    """Append an operation, or lengthen the last one where it goes on."""
    if length == 0:
        return
    if ops and ops[-1][0] == kind and ops[-1][1] + ops[-1][2] == offset:
        ops[-1] = (kind, ops[-1][1], ops[-1][2] + length)
    else:
        ops.append((kind, offset, length))


def sparse_ops(source: bytes, target: bytes, source_offset: int) -> list[Op]:
    """Operations for a target window and the source bytes at the same place: equal runs are
    copied, unequal ones added."""
    same = np.frombuffer(source, np.uint8) == np.frombuffer(target, np.uint8)
    edges = [0, *(np.flatnonzero(same[1:] != same[:-1]) + 1).tolist(), len(target)]
    ops: list[Op] = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        add_op(ops, "COPY" if same[a] else "ADD", a + source_offset if same[a] else a, b - a)
    return ops


def chunk_ops(
    source: bytes, target: bytes, source_base: int, minimum: int, average: int, maximum: int, gear: np.ndarray = GEAR
) -> list[Op]:
    """Operations from chunks of the target that also are chunks of the source span: the one
    that goes on from the last match is preferred, else the first."""
    places: dict[bytes, list[int]] = {}
    start = 0
    for end in chunk_ends(source, minimum, average, maximum, gear):
        places.setdefault(source[start:end], []).append(start)
        start = end
    ops: list[Op] = []
    preferred, start = -1, 0
    for end in chunk_ends(target, minimum, average, maximum, gear):
        found = places.get(target[start:end])
        if found:
            at = preferred if preferred in found else found[0]
            add_op(ops, "COPY", source_base + at, end - start)
            preferred = at + end - start
        else:
            add_op(ops, "ADD", start, end - start)
            preferred = -1
        start = end
    return ops


def copied(ops: list[Op]) -> int:
    return sum(n for kind, _, n in ops if kind == "COPY")


def _literal(data: bytes) -> bytes:
    n = len(data)
    if n >= 8 and data == data[:1] * n:
        if data[0] == 0:
            return bytes([OPCODES["ZERO"]]) + varint(n)
        return bytes([OPCODES["RUN_BYTE"], data[0]]) + varint(n)
    if n <= 255:
        return bytes([OPCODES["ADD_SHORT"], n]) + data
    return bytes([OPCODES["ADD_LONG"]]) + varint(n) + data


def _copy(at: int, base: int, place: int, last: int | None, n: int) -> bytes:
    if at == place and n <= 256:
        return bytes([OPCODES["COPY_SAME_SHORT"], n - 1])
    if last is not None and -(1 << 15) <= at - last < 1 << 15 and n <= 65535:
        return struct.pack("<BhH", OPCODES["COPY_DELTA_SHORT"], at - last, n)
    if 0 <= at - base <= 65535 and n <= 65535:
        return struct.pack("<BHH", OPCODES["COPY_LOCAL_SHORT"], at - base, n)
    if at >= base:
        return bytes([OPCODES["COPY_LOCAL_LONG"]]) + varint(at - base) + varint(n)
    return bytes([OPCODES["COPY_ABSOLUTE"]]) + varint(at) + varint(n)


def encode_ops(ops: list[Op], target: bytes, source_base: int, output_offset: int) -> tuple[bytes, int] | None:
    """Instruction stream and number of instructions, or None beyond 65,535 of them."""
    out = [OPS_MAGIC]
    place, last, count, i = output_offset, None, 0, 0
    while i < len(ops):
        if count == 65535:
            return None
        kind, at, n = ops[i]
        after = ops[i + 1] if i + 1 < len(ops) else None
        if kind == "COPY" and after and after[0] == "ADD" and after[2] <= 255 and at >= source_base:
            added = target[after[1] : after[1] + after[2]]
            out.append(bytes([OPCODES["COPY_ADD_PAIR"]]) + varint(at - source_base) + varint(n) + bytes([after[2]]) + added)
            place += n + after[2]
            last = at + n
            i += 1
        elif kind == "COPY":
            out.append(_copy(at, source_base, place, last, n))
            place += n
            last = at + n
        else:
            out.append(_literal(target[at : at + n]))
            place += n
            last = None
        count += 1
        i += 1
    out.append(bytes([OPCODES["END"]]))
    return b"".join(out), count


def decode_ops(
    stream: bytes, source: bytes, source_base: int, source_size: int, output_offset: int, output_size: int, instructions: int
) -> bytes:
    """Run an instruction stream; ``source`` holds ``source_size`` bytes from ``source_base``."""
    if stream[: len(OPS_MAGIC)] != OPS_MAGIC:
        raise ValueError("an instruction stream has another mark")
    at, out, made, last, count = len(OPS_MAGIC), [], 0, source_base, 0
    names = {v: k for k, v in OPCODES.items()}

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(stream):
            raise ValueError("an instruction stream ends early")
        at += n
        return stream[at - n : at]

    def number() -> int:
        nonlocal at
        value, at = read_varint(stream, at)
        return value

    def put(data: bytes) -> None:
        nonlocal made
        if not data or made + len(data) > output_size:
            raise ValueError("an instruction makes no bytes, or too many")
        out.append(data)
        made += len(data)

    def copy(place: int, n: int) -> None:
        nonlocal last
        if n <= 0 or n > output_size - made or place < source_base or place + n > source_base + source_size:
            raise ValueError("a copy leaves its source range")
        put(source[place - source_base : place - source_base + n])
        last = place + n

    while True:
        op = names.get(take(1)[0])
        if op == "END":
            break
        count += 1
        if op == "COPY_SAME_SHORT":
            copy(output_offset + made, take(1)[0] + 1)
        elif op == "COPY_LOCAL_SHORT":
            place, n = struct.unpack("<HH", take(4))
            copy(source_base + place, n)
        elif op == "COPY_LOCAL_LONG":
            place = number()
            copy(source_base + place, number())
        elif op == "COPY_DELTA_SHORT":
            delta, n = struct.unpack("<hH", take(4))
            copy(last + delta, n)
        elif op == "COPY_ABSOLUTE":
            place = number()
            copy(place, number())
        elif op == "ADD_SHORT":
            put(take(take(1)[0]))
        elif op == "ADD_LONG":
            n = number()
            if n > output_size - made:
                raise ValueError("an instruction makes too many bytes")
            put(take(n))
        elif op in ("RUN_BYTE", "ZERO"):
            byte = take(1) if op == "RUN_BYTE" else b"\0"
            n = number()
            if n > output_size - made:
                raise ValueError("an instruction makes too many bytes")
            put(byte * n)
        elif op == "COPY_ADD_PAIR":
            place = number()
            n = number()
            added = take(1)[0]
            copy(source_base + place, n)
            if added:
                put(take(added))
        else:
            raise ValueError("unknown opcode")
    if at != len(stream) or made != output_size or count != instructions:
        raise ValueError("an instruction stream does not make its window")
    return b"".join(out)


def score(kind: str, payload: int, expanded: int, instructions: int, span: int, mode: str) -> int:
    """Cost of a way to make a window; the least wins."""
    out = payload
    if mode == "apply-speed":
        if kind.startswith("DELTA"):
            out += 32 * instructions + span // 16
        if kind.endswith("ZSTD"):
            out += expanded // 64 + 512
    elif mode == "balanced":
        if kind.startswith("DELTA"):
            out += 4 * instructions + span // 128
        if kind.endswith("ZSTD"):
            out += expanded // 512
    return out


def compress(data: bytes, level: int) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True).compress(data)


def zstd_bound(expanded: int) -> int:
    return expanded + expanded // 128 + 4096


def decompress(data: bytes, expanded: int) -> bytes:
    """One frame without a dictionary, of ``expanded`` bytes."""
    import zstandard

    if len(data) > zstd_bound(expanded):
        raise ValueError("a compressed payload is larger than its bound")
    info = zstandard.get_frame_parameters(data)
    if info.dict_id or info.content_size not in (expanded, zstandard.CONTENTSIZE_UNKNOWN):
        raise ValueError("a frame has a dictionary or another size")
    if info.window_size > 1 << min(30, max(10, (max(1, expanded) - 1).bit_length())) and info.content_size != expanded:
        raise ValueError("a frame needs too large a window")
    reader = zstandard.ZstdDecompressor(max_window_size=1 << 30).decompressobj()
    out = reader.decompress(data)
    if not reader.eof or reader.unused_data or len(out) != expanded:
        raise ValueError("a payload is not one whole frame")
    return out
