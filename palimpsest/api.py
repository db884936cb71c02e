"""Creating, reading, inspecting and applying patches."""

from __future__ import annotations

import os
import shutil
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.blake3 import blake3, tree_root
from palimpsest.functions.constants import IDENTITY_CHUNK
from palimpsest.operators import apply, delta, inspect, verify
from palimpsest.operators.windows import window_size_of
from palimpsest.operators.journal import Fold, Journal, is_entry_safe
from palimpsest.sources import container
from palimpsest.sources.container import ContainerSource, File, Header
from palimpsest.sources.ranges import ByteRanges, stable_open


def register(spark: SparkSession) -> None:
    """Make the data sources ``patch`` and ``byteranges`` known."""
    spark.dataSource.register(ContainerSource)
    spark.dataSource.register(ByteRanges)


def read_pairs(spark: SparkSession, paths: list[tuple[str, str]], base: str) -> DataFrame:
    """``pair_id, path, source, target`` of (source file, target file) pairs; ``path`` is the
    source's under ``base``.  For files that fit in a cell."""
    named = [(i, os.path.relpath(s, base).replace(os.sep, "/"), s, t) for i, (s, t) in enumerate(paths)]
    for _, _, *both in named:
        for at in both:
            stable_open(at).close()
    rows = spark.createDataFrame(named, "pair_id long, path string, s string, t string")
    for column, name in (("s", "source"), ("t", "target")):
        files = spark.read.format("binaryFile").load(sorted({os.path.abspath(x[2 if column == "s" else 3]) for x in named}))
        files = files.select(F.regexp_replace("path", "^file:/*", "/").alias(f"{column}_path"), F.col("content").alias(name))
        spots = spark.createDataFrame([(i, os.path.abspath(s if column == "s" else t)) for i, _, s, t in named], f"pair_id long, {column}_path string")
        # Spark lists no empty file, so what it has no row for is empty: all of them were opened above.
        rows = rows.join(spots.join(files, f"{column}_path", "left").drop(f"{column}_path"), "pair_id")
    empty = F.unhex(F.lit(""))
    return rows.select("pair_id", "path", F.coalesce("source", empty).alias("source"), F.coalesce("target", empty).alias("target"))


def _tree(rows: DataFrame, column: str) -> DataFrame:
    """``pair_id, size, chunks`` with the BLAKE3 digests of identity chunks."""
    files = rows.select(F.col("pair_id").alias("file_id"), F.col(column).alias("content"))
    chunks = verify.chunk_digests(files, digest=verify.blake3_256).groupBy("file_id").agg(
        F.array_sort(F.collect_list(F.struct("chunk_idx", "digest"))).alias("c")
    )
    sized = files.select("file_id", F.length("content").cast("long").alias("size")).join(chunks, "file_id", "left")
    return sized.select(F.col("file_id").alias("pair_id"), "size", F.transform("c", lambda x: x["digest"]).alias("chunks"))


def create_patch(pairs: DataFrame, path: str, options: delta.Options | None = None, reverse: bool = False, comment: str = "") -> Header:
    """Build all windows of ``pairs(pair_id, path, source, target)`` and write the container.

    The window size is that of ``options``; where it is "auto", that of each file's larger side.
    Building is distributed; the payloads are streamed through the driver in container order.
    """
    options = options or delta.Options()
    files: dict[int, File] = {}
    for r in pairs.select("pair_id", "path").collect():  # a container has at most 2^18 files
        files[r.pair_id] = File(r.path)
    for column in ("source", "target"):
        for r in _tree(pairs, column).toLocalIterator():
            f = files[r.pair_id]
            chunks = [bytes(c) for c in r.chunks or ()]
            setattr(f, f"{column}_size", r["size"])
            setattr(f, f"{column}_chunks", chunks)
            setattr(f, f"{column}_digest", tree_root(container.DOMAIN, r["size"], IDENTITY_CHUNK, chunks))
    for f in files.values():
        largest = max(f.source_size, f.target_size)
        f.window_size = window_size_of(largest) if options.window_size == "auto" else int(options.window_size)
    given = [(0, pairs)] + ([(1, apply.reversed_pairs(pairs))] if reverse else [])
    built = None
    for side, rows in given:
        each = delta.build_windows(rows.drop("path"), options)
        digests = _window_digests(rows, sorted({f.window_size for f in files.values()}))
        each = each.join(digests, ["pair_id", "output_offset", "output_size"]).withColumn("side", F.lit(side))
        built = each if built is None else built.unionByName(each)
    ordered = built.orderBy("pair_id", "side", "window_idx").persist()
    try:
        for r in ordered.drop("payload").toLocalIterator():
            first = r.source_offset // IDENTITY_CHUNK if r.source_size else 0
            last = -(-(r.source_offset + r.source_size) // IDENTITY_CHUNK) if r.source_size else 0
            w = dict(
                output_offset=r.output_offset, output_size=r.output_size, kind=r.kind, codec=r.codec, flags=0, payload_offset=0,
                payload_size=r.payload_size, expanded_size=r.expanded_size, source_offset=r.source_offset, source_size=r.source_size,
                source_first_chunk=first, source_chunk_count=last - first, instruction_count=r.instruction_count, digest=bytes(r.digest),
            )
            (files[r.pair_id].reverse if r.side else files[r.pair_id].forward).append(w)
        header = Header(
            [files[k] for k in sorted(files)], created_ns=time.time_ns(), level=options.level, mode=options.mode,
            window_size=max((f.window_size for f in files.values()), default=window_size_of(0)), comment=comment, reverse=reverse,
        )
        paid = ordered.where("payload_size > 0").select("payload").toLocalIterator()
        container.write(path, header, (bytes(r.payload) for r in paid))
    finally:
        ordered.unpersist()
    return header


def _window_digests(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """``pair_id, output_offset, output_size, digest`` of the windows of every file at each of a
    few sizes; equal ranges have equal digests, whatever the size they were cut by."""
    out = None
    for size in sizes:
        cut = verify.chunk_digests(rows.select(F.col("pair_id").alias("file_id"), F.col("target").alias("content")), size, verify.blake3_256)
        cut = cut.select(F.col("file_id").alias("pair_id"), F.col("offset").alias("output_offset"), F.col("length").alias("output_size"), "digest")
        out = cut if out is None else out.unionByName(cut)
    return out.distinct() if len(sizes) > 1 else out


def read_patch(spark: SparkSession, path: str) -> DataFrame:
    """The windows of a container."""
    register(spark)
    return spark.read.format("patch").load(path)


def inspect_patch(spark: SparkSession, path: str, root: str) -> DataFrame:
    """Which state the files under ``root`` are in (see ``operators.inspect``)."""
    header, _ = container.open_container(path)
    expected = [(0, f.path, f.source_digest.hex(), f.target_digest.hex(), header.reverse) for f in header.files]
    installed = []
    for f in header.files:
        at = os.path.join(root, f.path)
        if os.path.lexists(at):
            regular = os.path.isfile(at) and not os.path.islink(at)
            installed.append((0, f.path, regular, file_root(at).hex() if regular else None))
    return inspect.inspect(
        spark.createDataFrame(expected, "patch_id long, path string, source_digest string, target_digest string, has_reverse boolean"),
        spark.createDataFrame(installed, "patch_id long, path string, regular boolean, digest string"),
    )


def file_root(path: str) -> bytes:
    """The root digest of a file, read chunk by chunk."""
    chunks, size = [], 0
    with open(path, "rb") as f:
        while data := f.read(IDENTITY_CHUNK):
            chunks.append(blake3(data))
            size += len(data)
    return tree_root(container.DOMAIN, size, IDENTITY_CHUNK, chunks)


def apply_patch(spark: SparkSession, path: str, root: str, direction: str = "forward", verify_source: bool = True) -> list[str]:
    """Rebuild the files under ``root`` and let them take the place of the old ones, all or none.

    Every rebuilt file must have its root digest before any is replaced; replacements are
    recorded in a journal, and undone in reverse order if one fails.
    """
    recover(root)
    header, _ = container.open_container(path)
    if direction == "reverse" and not header.reverse:
        raise ValueError("the patch has no reverse windows")
    files = header.files
    want = {i: f.target_digest if direction == "forward" else f.source_digest for i, f in enumerate(files)}
    have = {i: f.source_digest if direction == "forward" else f.target_digest for i, f in enumerate(files)}
    if verify_source:
        for i, f in enumerate(files):
            if file_root(os.path.join(root, f.path)) != have[i]:
                raise ValueError(f"{f.path} is not in the state that the patch starts from")
    spots = spark.createDataFrame([(i, os.path.abspath(os.path.join(root, f.path))) for i, f in enumerate(files)], "pair_id long, at string")
    read = spark.read.format("binaryFile").load(sorted({os.path.abspath(os.path.join(root, f.path)) for f in files}))
    read = read.select(F.regexp_replace("path", "^file:/*", "/").alias("at"), F.col("content").alias("source"))
    windows = read_patch(spark, path).where(F.col("dir") == direction).withColumn("pair_id", F.col("file_idx").cast("long"))
    groups = apply.join_groups(apply.decode_windows(windows, spots.join(read, "at", "left"))).orderBy("pair_id", "group")
    temps = {i: os.path.join(root, os.path.dirname(f.path), f".tmp-{uuid.uuid4().hex}") for i, f in enumerate(files)}
    try:
        for temp in temps.values():
            open(temp, "xb").close()
        for r in groups.toLocalIterator():  # one 8 MiB group at a time, in order
            with open(temps[r.pair_id], "ab") as out:
                out.write(r.bytes)
        for i, f in enumerate(files):
            if file_root(temps[i]) != want[i]:
                raise ValueError(f"{f.path} was not rebuilt as the patch says")
            shutil.copymode(os.path.join(root, f.path), temps[i])
        commit(root, [(f.path, os.path.relpath(temps[i], root)) for i, f in enumerate(files)])
    finally:
        for temp in temps.values():
            if os.path.exists(temp):
                os.unlink(temp)
    return [f.path for f in files]


def recover(root: str) -> int:
    """Finish or undo the commits under ``root`` that were interrupted; returns how many there were.

    After a commit record backups go; before it, what has a backup is restored from it, entries
    from the last to the first, and temporary files go.  A journal that breaks the rules, or names
    files outside of its entries' folders, is an error, and nothing is done.
    """
    names = sorted(x for x in os.listdir(root) if x.startswith(".journal-"))
    for name in names:
        log, fold = os.path.join(root, name), Fold()
        for record in Journal.read(log):
            fold.add(record)
        entries = fold.known["entries"]
        if not entries or not all(is_entry_safe(e) for e in entries):
            raise ValueError(f"{name} is not a journal that can be recovered")
        at = lambda e, c: os.path.join(root, e[c])
        for e in entries if fold.known["committed"] else reversed(entries):
            if os.path.lexists(at(e, "backup")):
                if fold.known["committed"]:
                    os.unlink(at(e, "backup"))
                else:
                    os.replace(at(e, "backup"), at(e, "path"))
            if os.path.lexists(at(e, "temp")):
                os.unlink(at(e, "temp"))
        os.unlink(log)
    return len(names)


def commit(root: str, replacements: list[tuple[str, str]]) -> None:
    """Replace files by their temporaries, with a journal; undo all if one fails."""
    entries = [{"path": p, "temp": t, "backup": os.path.join(os.path.dirname(p), f".bak-{uuid.uuid4().hex}")} for p, t in replacements]
    log = os.path.join(root, f".journal-{uuid.uuid4().hex}")
    journal, done = Journal(log, entries), []
    try:
        for i, e in enumerate(entries):
            done.append(e)
            if os.path.lexists(os.path.join(root, e["path"])):
                os.rename(os.path.join(root, e["path"]), os.path.join(root, e["backup"]))
            journal.move(i, "backed-up")
            os.rename(os.path.join(root, e["temp"]), os.path.join(root, e["path"]))
            journal.move(i, "replaced")
    except OSError:
        for e in reversed(done):
            if os.path.lexists(os.path.join(root, e["backup"])):
                os.replace(os.path.join(root, e["backup"]), os.path.join(root, e["path"]))
        os.unlink(log)
        raise
    journal.commit()
    for e in entries:
        if os.path.lexists(os.path.join(root, e["backup"])):
            os.unlink(os.path.join(root, e["backup"]))
    os.unlink(log)
