"""Containers and round trips through files."""

import os
import random
import struct

import pytest

from palimpsest import api
from palimpsest.operators import delta
from palimpsest.sources import container


def files(folder, contents):
    os.makedirs(folder, exist_ok=True)
    for name, data in contents.items():
        at = os.path.join(folder, name)
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(at, "wb") as f:
            f.write(data)


def load(folder, name):
    with open(os.path.join(folder, name), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def versions():
    r = random.Random(7)
    old = {"bin/a.exe": r.randbytes(700_000), "b.bin": bytes(i * 29 % 251 for i in range(300_000)), "same": b"x" * 1000, "empty": b"", "grow": b"ab" * 5}
    a = bytearray(old["bin/a.exe"])
    for i in range(0, len(a), 1000):
        a[i] ^= 165
    new = {"bin/a.exe": bytes(a), "b.bin": b"INSERTED" + old["b.bin"][:200_000], "same": old["same"], "empty": b"now full", "grow": b""}
    return old, new


def make(spark, tmp_path, versions, **kw):
    old, new = versions
    files(tmp_path / "old", old)
    files(tmp_path / "new", new)
    pairs = api.read_pairs(spark, [(str(tmp_path / "old" / n), str(tmp_path / "new" / n)) for n in old], str(tmp_path / "old"))
    path = str(tmp_path / "p.patch")
    api.create_patch(pairs, path, reverse=True, **kw)
    return path


def test_round_trip(spark, tmp_path, versions):
    old, new = versions
    path = make(spark, tmp_path, versions, comment="round trip")
    root = tmp_path / "old"
    state = api.inspect_patch(spark, path, str(root)).first()
    assert state.state == "forward-ready" and state.can_forward
    api.apply_patch(spark, path, str(root))
    assert {n: load(root, n) for n in new} == new
    assert api.inspect_patch(spark, path, str(root)).first().state == "reverse-ready"
    api.apply_patch(spark, path, str(root), "reverse")
    assert {n: load(root, n) for n in old} == old
    assert not [n for _, _, names in os.walk(root) for n in names if n.startswith(".")]


def test_window_size_of_each_file(spark, tmp_path, versions):
    """"auto" is decided file by file; a size that is given holds for all."""
    old, new = (dict(x) for x in versions)
    old["large"], new["large"] = random.Random(8).randbytes(1_300_000), random.Random(8).randbytes(1_200_000) + b"end"
    path = make(spark, tmp_path, (old, new), options=delta.Options())
    header, _ = container.open_container(path)
    assert {f.path: f.window_size for f in header.files}["large"] == 512 << 10 and header.files[0].window_size == 256 << 10
    api.apply_patch(spark, path, str(tmp_path / "old"))
    assert {n: load(tmp_path / "old", n) for n in new} == new
    path = make(spark, tmp_path, (old, new), options=delta.Options(window_size=1 << 20))
    assert {f.window_size for f in container.open_container(path)[0].files} == {1 << 20}


def test_wrong_source_changes_nothing(spark, tmp_path, versions):
    path = make(spark, tmp_path, versions)
    root = tmp_path / "old"
    files(root, {"b.bin": b"other"})
    with pytest.raises(ValueError, match="not in the state"):
        api.apply_patch(spark, path, str(root))
    assert load(root, "bin/a.exe") == versions[0]["bin/a.exe"]
    assert api.inspect_patch(spark, path, str(root)).first().state == "invalid-files"


def test_container_rules(spark, tmp_path, versions):
    path = make(spark, tmp_path, versions)
    header, offset = container.open_container(path)
    assert header.reverse and [f.path for f in header.files] == list(versions[0])
    assert container.decode_index(container.encode_index(header)) == header
    raw = bytearray(load(tmp_path, "p.patch"))

    def broken(change):
        data = bytearray(raw)
        change(data)
        with open(tmp_path / "broken", "wb") as f:
            f.write(data)
        with pytest.raises(ValueError):
            container.open_container(str(tmp_path / "broken"))

    broken(lambda d: d.__setitem__(8, 0))  # flags of the prefix disagree
    broken(lambda d: d.__setitem__(0, 0))  # another mark
    broken(lambda d: d.__setitem__(offset + 20, d[offset + 20] ^ 1))  # the index has another digest
    broken(lambda d: d.__delitem__(slice(-1, None)))
    broken(lambda d: d.__setitem__(slice(offset + 36, offset + 40), struct.pack("<I", (1 << 18) + 1)))


def test_index_decoder_never_crashes():
    good = container.File("a", 4, 4, source_chunks=[bytes(32)], target_chunks=[bytes(32)])
    good.forward = [dict(zip(container.WINDOW_FIELDS, (0, 4, "SAME", "none", 0, 0, 0, 0, 0, 4, 0, 1, 0, bytes(32)), strict=True))]
    data = container.encode_index(container.Header([good]))
    assert container.decode_index(data).files == [good]
    r = random.Random(1)
    for _ in range(2000):
        bad = bytearray(data)
        for _ in range(r.randint(1, 4)):
            bad[r.randrange(len(bad))] = r.randrange(256)
        bad = bytes(bad[: r.randint(0, len(bad))] if r.random() < 0.3 else bad)
        try:
            container.decode_index(bad)
        except container.ContainerError:
            pass


def test_publish_and_commit_restore(tmp_path):
    files(tmp_path, {"one": b"1", "two": b"2", ".tmp-1": b"new 1"})
    with pytest.raises(OSError):
        api.commit(str(tmp_path), [("one", ".tmp-1"), ("two", ".tmp-missing")])
    assert load(tmp_path, "one") == b"1" and load(tmp_path, "two") == b"2"


def test_byte_ranges(spark, tmp_path):
    files(tmp_path, {"big": bytes(range(256)) * 100})
    api.register(spark)
    rows = spark.read.format("byteranges").option("rangeSize", 10_000).load(str(tmp_path / "big")).orderBy("offset").collect()
    assert [r.offset for r in rows] == [0, 10_000, 20_000]
    assert b"".join(bytes(r.bytes) for r in rows) == bytes(range(256)) * 100
    os.symlink(tmp_path / "big", tmp_path / "link")
    with pytest.raises(Exception, match="regular"):
        spark.read.format("byteranges").load(str(tmp_path / "link")).count()


def test_kinds_by_mode(spark):
    r = random.Random(3)
    base = r.randbytes(4096)
    rows = [
        (0, base, base), (1, base, bytes(4096)), (2, base, b"\7" * 4096), (3, base, b"new" + base), (4, base, r.randbytes(4096)),
        (5, base, base[:100] + b"!" + base[101:]), (6, None, b"hello"), (7, base, None), (8, base, base[64:] + base[:64]),
    ]
    pairs = spark.createDataFrame(rows, "pair_id long, source binary, target binary")
    from palimpsest.operators import apply
    import hashlib

    for mode in ("balanced", "apply-speed", "patch-size"):
        for size, cdc in ((256, 32), (1024, 64), (4096, None)):
            built = delta.build_windows(pairs, delta.Options(size, mode=mode, cdc=cdc, cdc_gate=64))
            back = {x.pair_id: x.sha256 for x in apply.rebuild(built, pairs.select("pair_id", "source")).collect()}
            assert back == {i: hashlib.sha256(t or b"").hexdigest() for i, _, t in rows}
    kinds = {(x.pair_id, x.kind) for x in delta.build_windows(pairs, delta.Options(4096)).select("pair_id", "kind").collect()}
    assert {(0, "SAME"), (1, "ZERO"), (2, "RUN"), (4, "REPLACE_RAW"), (6, "REPLACE_RAW")} <= kinds
    assert (5, "DELTA_RAW") in kinds and not [k for i, k in kinds if i == 7]


def test_command_line(spark, tmp_path, versions, capsys):
    from palimpsest.__main__ import main

    old, new = versions
    files(tmp_path / "old", old)
    files(tmp_path / "new", new)
    pairs = [a for n in old for a in ("--file-pair", f"{tmp_path}/old/{n}::{tmp_path}/new/{n}")]
    patch = str(tmp_path / "p")
    assert main(["create", *pairs, "--output", patch, "--reverse"]) == 0
    assert main(["inspect", "--patch", patch, "--root", str(tmp_path / "old")]) == 0
    assert "forward-ready" in capsys.readouterr().out
    assert main(["apply", "--patch", patch, "--root", str(tmp_path / "old")]) == 0
    assert {n: load(tmp_path / "old", n) for n in new} == new
    assert main(["apply", "--patch", patch, "--root", str(tmp_path / "old")]) == 1
    assert main(["create", "--output", patch]) == 1
    assert main(["nonsense"]) == 2
