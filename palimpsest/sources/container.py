"""The container of a patch: a prefix, payloads, a binary index and a footer.

``encode_index`` and ``decode_index`` turn an index into plain rows and back; ``write`` streams
payloads in container order into a new file that takes the place of the old one only when it
is whole; ``ContainerSource`` is a Spark data source that reads the index of each container in
the driver, as for Parquet footers, and payload ranges in the tasks.
"""

from __future__ import annotations

import io
import os
import struct
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from palimpsest.functions.blake3 import blake3, tree_root
from palimpsest.functions.constants import (
    CODECS,
    FOOTER_SIZE,
    FORMAT_VERSION,
    IDENTITY_CHUNK,
    KINDS,
    MARKS,
    MAX_COMMENT,
    MAX_FILES,
    MAX_FINE_PER_FILE,
    MAX_INDEX,
    MAX_PATH,
    MAX_WINDOWS,
    MODES,
    PREFIX_SIZE,
    WINDOW_SIZE,
    WINDOW_SIZES,
)

REVERSE, FINE = 1, 2
DOMAIN = b"PLMP-BLAKE3-TREE-V1\0"
_WINDOW = struct.Struct("<QIBBHQIIQIIHH32s4x")
_NAMES = {v: k for k, v in KINDS.items()}
_CODECS = {v: k for k, v in CODECS.items()}
WINDOW_FIELDS = (
    "output_offset", "output_size", "kind", "codec", "flags", "payload_offset", "payload_size", "expanded_size", "source_offset",
    "source_size", "source_first_chunk", "source_chunk_count", "instruction_count", "digest",
)


class ContainerError(ValueError):
    """A container breaks a rule of its format."""


@dataclass
class File:
    path: str
    source_size: int = 0
    target_size: int = 0
    source_digest: bytes = bytes(32)
    target_digest: bytes = bytes(32)
    window_size: int = 256 << 10
    chunk_size: int = IDENTITY_CHUNK
    source_chunks: list[bytes] = field(default_factory=list)
    target_chunks: list[bytes] = field(default_factory=list)
    forward: list[dict] = field(default_factory=list)
    reverse: list[dict] = field(default_factory=list)
    source_band: int = 0
    target_band: int = 0
    source_fine: list[tuple[int, bytes]] = field(default_factory=list)
    target_fine: list[tuple[int, bytes]] = field(default_factory=list)


@dataclass
class Header:
    files: list[File]
    created_ns: int = 0
    level: int = 3
    mode: str = "balanced"
    window_size: int = 256 << 10
    comment: str = ""
    creator: tuple[str, str, str, str] = ("", "", "", "")
    library: str = "1.5.7"
    reverse: bool = False

    @property
    def flags(self) -> int:
        return (REVERSE if self.reverse else 0) | (FINE if any(f.source_fine or f.target_fine for f in self.files) else 0)


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ContainerError(what)


def pack_window(w: dict) -> bytes:
    values = dict(w, kind=KINDS[w["kind"]], codec=CODECS[w["codec"]])
    return _WINDOW.pack(*(values[name] for name in WINDOW_FIELDS))


def unpack_window(data: bytes) -> dict:
    _need(len(data) == WINDOW_SIZE and data[-4:] == bytes(4), "reserved bytes of a window are not zero")
    w = dict(zip(WINDOW_FIELDS, _WINDOW.unpack(data), strict=True))
    _need(w["kind"] in _NAMES, "unknown window kind")
    _need(w["codec"] in _CODECS, "unknown codec")
    return w | {"kind": _NAMES[w["kind"]], "codec": _CODECS[w["codec"]]}


class _Out(io.BytesIO):
    def put(self, layout: str, *values: object) -> None:
        self.write(struct.pack("<" + layout, *values))

    def text(self, value: str, layout: str) -> None:
        raw = value.encode()
        self.put(layout, len(raw))
        self.write(raw)


class _In:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def left(self) -> int:
        return len(self.data) - self.at

    def take(self, n: int) -> bytes:
        _need(0 <= n <= self.left(), "an index ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def get(self, layout: str) -> tuple:
        s = struct.Struct("<" + layout)
        return s.unpack(self.take(s.size))

    def text(self, layout: str, most: int) -> str:
        (n,) = self.get(layout)
        _need(n <= most, "a string is too long")
        try:
            return self.take(n).decode()
        except UnicodeDecodeError:
            raise ContainerError("a string is not UTF-8") from None


def chunk_count(size: int) -> int:
    return -(-size // IDENTITY_CHUNK)


def check_path(path: str) -> None:
    """The rules of a portable path (see ``palimpsest.operators.paths.path_ok``)."""
    parts = path.split("/")
    ok = 0 < len(path.encode()) <= MAX_PATH and "\0" not in path and "\\" not in path
    _need(ok and all(p and not p.endswith((" ", ".")) and ":" not in p for p in parts), f"path {path!r} is not portable")


def _check_fine(size: int, band: int, table: list[tuple[int, bytes]]) -> None:
    _need(bool(table) or band == 0, "an empty table declares a band size")
    if table:
        _need(band in (64 << 10, 256 << 10, 1 << 20) and len(table) <= MAX_FINE_PER_FILE, "a band size or table is not allowed")
        order = [i for i, _ in table]
        _need(all(a < b for a, b in zip(order, order[1:], strict=False)), "band indexes do not rise")
        _need(order[-1] < -(-size // band), "a band lies beyond its file")


def check_windows(windows: list[dict], output: int, source: int, window_size: int) -> None:
    _need(len(windows) <= MAX_WINDOWS and bool(windows) == bool(output), "windows and output size disagree")
    at = 0
    for w in windows:
        _need(w["output_offset"] == at and 0 < w["output_size"] <= min(window_size, output - at), "a window leaves a gap or its file")
        _need(window_reason(w, source) is None, f"a window breaks a rule: {window_reason(w, source)}")
        at += w["output_size"]
    _need(at == output, "windows end before their file")


def window_reason(w: dict, source: int) -> str | None:
    """The rule a window breaks, or None (the rules of ``palimpsest.operators.layout``)."""
    kind, size, paid, grown = w["kind"], w["output_size"], w["payload_size"], w["expanded_size"]
    moves, delta = kind in ("SAME", "COPY"), kind.startswith("DELTA")
    sized = {"SAME": (0, 0), "COPY": (0, 0), "REPLACE_RAW": (size, size), "REPLACE_ZSTD": (paid, size), "ZERO": (0, size), "RUN": (1, size)}
    rules = {
        "flags": w["flags"] == 0,
        "codec": w["codec"] == ("zstd" if kind.endswith("ZSTD") else "none"),
        "payload": (paid, grown) == sized.get(kind, (paid, grown if kind == "DELTA_ZSTD" else paid)),
        "no payload": paid > 0 and grown > 0 if delta or kind == "REPLACE_ZSTD" else True,
        "stream bound": not delta or grown <= 2 * size + (1 << 20),
        "zstd bound": not kind.endswith("ZSTD") or paid <= grown + grown // 128 + 4096,
        "instructions": (w["instruction_count"] > 0) == delta,
        "source": w["source_size"] == size if moves else (w["source_size"] > 0) == delta,
        "place": kind != "SAME" or w["source_offset"] == w["output_offset"],
        "range": w["source_offset"] + w["source_size"] <= source,
    }
    first = w["source_offset"] // IDENTITY_CHUNK
    count = -(-(w["source_offset"] + w["source_size"]) // IDENTITY_CHUNK) - first
    rules["chunks"] = (
        (w["source_first_chunk"], w["source_chunk_count"]) == (first, count)
        if moves or delta
        else w["source_offset"] == w["source_first_chunk"] == w["source_chunk_count"] == 0
    )
    return next((name for name, good in rules.items() if not good), None)


def check_header(h: Header) -> None:
    from palimpsest.operators.paths import collision_key

    _need(-131072 <= h.level <= 22 and h.mode in MODES and h.window_size in WINDOW_SIZES, "level, mode or window size")
    _need(len(h.comment.encode()) <= MAX_COMMENT and 0 < len(h.files) <= MAX_FILES, "comment or number of files")
    seen: set[str] = set()
    for f in h.files:
        check_path(f.path)
        key = collision_key(f.path)
        _need(key not in seen, f"path {f.path!r} collides with another")
        seen.add(key)
        _need(f.window_size in WINDOW_SIZES and f.chunk_size == IDENTITY_CHUNK, "window or chunk size of a file")
        _need(max(f.source_size, f.target_size) < 1 << 63, "a file is too large")
        _need(len(f.source_chunks) == chunk_count(f.source_size) and len(f.target_chunks) == chunk_count(f.target_size), "number of chunk digests")
        check_windows(f.forward, f.target_size, f.source_size, f.window_size)
        if h.reverse:
            check_windows(f.reverse, f.source_size, f.target_size, f.window_size)
        else:
            _need(not f.reverse, "reverse windows without the flag")
        _check_fine(f.source_size, f.source_band, f.source_fine)
        _check_fine(f.target_size, f.target_band, f.target_fine)


def encode_index(h: Header, marks: dict[str, bytes] = MARKS) -> bytes:
    check_header(h)
    out = _Out()
    out.write(marks["index"])
    out.put("IIqiB3xII", FORMAT_VERSION, h.flags, h.created_ns, h.level, MODES.index(h.mode), h.window_size, len(h.files))
    out.text(h.comment, "I")
    for value in (*h.creator, h.library):
        out.text(value, "H")
    for f in h.files:
        out.text(f.path, "I")
        out.put("QQ32s32sII", f.source_size, f.target_size, f.source_digest, f.target_digest, f.window_size, f.chunk_size)
        out.put("IIII", len(f.source_chunks), len(f.target_chunks), len(f.forward), len(f.reverse))
        out.write(b"".join([*f.source_chunks, *f.target_chunks, *map(pack_window, f.forward), *map(pack_window, f.reverse)]))
    if h.flags & FINE:
        out.write(marks["fine"])
        out.put("II", 1, len(h.files))
        for f in h.files:
            out.put("IIII", f.source_band, f.target_band, len(f.source_fine), len(f.target_fine))
            for index, digest in (*f.source_fine, *f.target_fine):
                out.put("Q32s", index, digest)
    data = out.getvalue()
    _need(len(data) <= MAX_INDEX, "an index is too large")
    return data


def decode_index(data: bytes, marks: dict[str, bytes] = MARKS) -> Header:
    """The header of an index.  Counts are checked against what is left before anything is read."""
    r = _In(data)
    _need(r.take(8) == marks["index"], "another mark at the start of the index")
    version, flags, created, level, mode, reserved, window, n = r.get("IIqiB3sII")
    _need(version == FORMAT_VERSION and flags & ~(REVERSE | FINE) == 0 and reserved == bytes(3), "version, flags or reserved bytes")
    _need(mode < len(MODES) and 0 < n <= MAX_FILES, "mode or number of files")
    comment = r.text("I", MAX_COMMENT)
    *creator, library = [r.text("H", 65535) for _ in range(5)]
    files = []
    for _ in range(n):
        f = File(r.text("I", MAX_PATH))
        f.source_size, f.target_size, f.source_digest, f.target_digest, f.window_size, f.chunk_size = r.get("QQ32s32sII")
        counts = r.get("IIII")
        _need(counts[:2] == (chunk_count(f.source_size), chunk_count(f.target_size)) and max(counts[2:]) <= MAX_WINDOWS, "counts of a file")
        _need(32 * (counts[0] + counts[1]) + WINDOW_SIZE * (counts[2] + counts[3]) <= r.left(), "tables are larger than the index")
        f.source_chunks, f.target_chunks = ([r.take(32) for _ in range(k)] for k in counts[:2])
        f.forward, f.reverse = ([unpack_window(r.take(WINDOW_SIZE)) for _ in range(k)] for k in counts[2:])
        files.append(f)
    if flags & FINE:
        _need(r.take(8) == marks["fine"] and r.get("II") == (1, n), "the table of fine digests")
        for f in files:
            f.source_band, f.target_band, a, b = r.get("IIII")
            _need(40 * (a + b) <= r.left(), "fine digests are larger than the index")
            f.source_fine, f.target_fine = ([r.get("Q32s") for _ in range(k)] for k in (a, b))
    _need(r.left() == 0, "bytes after the index")
    h = Header(files, created, level, MODES[mode], window, comment, tuple(creator), library, bool(flags & REVERSE))
    _need(h.flags == flags, "flags and tables disagree")
    check_header(h)
    return h


def check_coverage(h: Header, index_offset: int) -> None:
    """Payloads cover the bytes between prefix and index once."""
    at = PREFIX_SIZE
    ranges = sorted(
        (w["payload_offset"], w["payload_size"]) for f in h.files for w in (*f.forward, *f.reverse) if w["payload_size"]
    )
    for start, n in ranges:
        _need(start == at, "payloads leave a gap or overlap")
        at += n
    _need(at == index_offset, "bytes before the index belong to no payload")


def read_header(read_at: Callable[[int, int], bytes], size: int, marks: dict[str, bytes] = MARKS) -> tuple[Header, int]:
    """Header and index offset of a container, from ranged reads: prefix, footer and index."""
    _need(size >= PREFIX_SIZE + FOOTER_SIZE, "a container is too short")
    mark, flags, rest = struct.unpack("<8sI4s", read_at(0, PREFIX_SIZE))
    _need(mark == marks["prefix"] and rest == bytes(4), "another mark at the start")
    mark, offset, n, digest, tail, rest = struct.unpack("<8sQQ32sI4s", read_at(size - FOOTER_SIZE, FOOTER_SIZE))
    _need(mark == marks["footer"] and rest == bytes(4), "another mark at the end")
    _need(n <= MAX_INDEX and PREFIX_SIZE <= offset and offset + n == size - FOOTER_SIZE, "an index out of place")
    data = read_at(offset, n)
    _need(blake3(data) == digest, "the index does not have its digest")
    h = decode_index(data, marks)
    _need(flags == tail == h.flags, "flags of prefix, index and footer disagree")
    check_coverage(h, offset)
    return h, offset


def verify_trees(h: Header, domain: bytes = DOMAIN) -> None:
    for f in h.files:
        for size, chunks, digest in ((f.source_size, f.source_chunks, f.source_digest), (f.target_size, f.target_chunks, f.target_digest)):
            _need(tree_root(domain, size, IDENTITY_CHUNK, chunks) == digest, f"the root digest of {f.path!r} is another")


def open_container(path: str, marks: dict[str, bytes] = MARKS, domain: bytes = DOMAIN) -> tuple[Header, int]:
    with open(path, "rb") as f:
        def read_at(at: int, n: int) -> bytes:
            f.seek(at)
            data = f.read(n)
            _need(len(data) == n, "a read came up short")
            return data

        h, offset = read_header(read_at, os.fstat(f.fileno()).st_size, marks)
    verify_trees(h, domain)
    return h, offset


def publish(temp: str, path: str) -> None:
    """Let a whole file take the place of another, which is restored if that fails."""
    backup = f"{path}.bak-{uuid.uuid4().hex}"
    had = os.path.lexists(path)
    if had:
        os.rename(path, backup)
    try:
        os.rename(temp, path)
    except OSError:
        if had:
            os.rename(backup, path)
        raise
    if had:
        os.unlink(backup)


def write(path: str, header: Header, payloads: Iterable[bytes], marks: dict[str, bytes] = MARKS) -> int:
    """Write a container and return its index offset.

    ``payloads`` come in container order, those of windows without one left out; offsets are
    filled in.  The file is made beside its place and renamed at the end.
    """
    windows = [w for f in header.files for w in (*f.forward, *f.reverse)]
    temp = f"{path}.tmp-{uuid.uuid4().hex}"
    try:
        with open(temp, "xb") as out:
            out.write(struct.pack("<8sI4x", marks["prefix"], header.flags))
            given: Iterator[bytes] = iter(payloads)
            at = PREFIX_SIZE
            for w in windows:
                w["payload_offset"] = at if w["payload_size"] else 0
                if w["payload_size"]:
                    data = next(given)
                    _need(len(data) == w["payload_size"], "a payload has another size")
                    out.write(data)
                    at += len(data)
            index = encode_index(header, marks)
            out.write(index)
            out.write(struct.pack("<8sQQ32sI4x", marks["footer"], at, len(index), blake3(index), header.flags))
            out.flush()
            os.fsync(out.fileno())
        publish(temp, path)
    finally:
        if os.path.exists(temp):
            os.unlink(temp)
    return at


class _Range(InputPartition):
    def __init__(self, path: str, rows: list[tuple]) -> None:
        self.path, self.rows = path, rows


_SCHEMA = (
    "file_idx int, path string, dir string, window_idx long, output_offset long, output_size long, kind string, codec string, "
    "payload binary, payload_size long, expanded_size long, source_offset long, source_size long, instruction_count int, digest binary"
)


class _Reader(DataSourceReader):
    def __init__(self, path: str, per_task: int) -> None:
        self.path, self.per_task = path, per_task

    def partitions(self) -> list[_Range]:
        header, _ = open_container(self.path)
        rows = [
            (i, f.path, side, k, w)
            for i, f in enumerate(header.files)
            for side, windows in (("forward", f.forward), ("reverse", f.reverse))
            for k, w in enumerate(windows)
        ]
        return [_Range(self.path, rows[k : k + self.per_task]) for k in range(0, len(rows), self.per_task)] or [_Range(self.path, [])]

    def read(self, partition: _Range) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            for i, path, side, k, w in partition.rows:
                payload = None
                if w["payload_size"]:
                    f.seek(w["payload_offset"])
                    payload = f.read(w["payload_size"])
                yield (
                    i, path, side, k, w["output_offset"], w["output_size"], w["kind"], w["codec"], payload, w["payload_size"],
                    w["expanded_size"], w["source_offset"], w["source_size"], w["instruction_count"], w["digest"],
                )


class ContainerSource(DataSource):
    """``spark.read.format("patch").load(path)``: the windows of a container, with payloads.

    Option ``windowsPerTask`` (4096) says how many windows one task reads.
    """

    @classmethod
    def name(cls) -> str:
        return "patch"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema: object) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("windowsPerTask", 4096)))
