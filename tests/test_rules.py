"""Rules of windows, paths, lists, journals and plans."""

import json
import os

import pytest

from palimpsest.functions.constants import FINE_BANDS, FINE_ENTRY_BYTES, FINE_PENALTY, IDENTITY_CHUNK
from palimpsest.operators import inspect, journal, layout, paths, verify
from palimpsest.plans import fixtures as fx
from palimpsest.sources.container import check_path, window_reason


def test_audit_agrees_with_the_container(spark):
    rows = layout.window_audit(fx.audit_windows(spark)).collect()
    for r in rows:
        w = r.asDict()
        if w["kind"] in fx._KINDS:
            assert (window_reason(w, w["input_size"]) is None) == (r.reason is None), r
        else:
            assert r.reason == "kind", r
        assert r.reason is None or "," in r.name, r
    assert {r.reason for r in rows} >= {
        None, "flags", "kind", "codec", "payload", "source size", "source offset", "stream bound", "zstd bound", "expanded size", "instructions",
        "source of none", "source range", "source chunks",
    }


def test_paths_agree_with_the_container(spark):
    for r in fx.paths(spark).select("path", paths.path_ok("path").alias("ok")).collect():
        try:
            check_path(r.path)
            assert r.ok, r
        except ValueError:
            assert not r.ok, r


def test_collisions(spark):
    given = ["Data/É.TXT", "data/é.txt", "other", "STRASSE", "straße"]
    got = {r.n for r in paths.collisions(spark.createDataFrame([(p,) for p in given], "path string")).collect()}
    assert got == {2} and paths.collision_key(given[0]) == paths.collision_key(given[1])


def test_common_base(spark):
    rows = [(g, "/".join(["r", "s", "t"][: g % 4] + [f"u{k}"] * (k % 3) + [f"v{k}"])) for g in range(8) for k in range(g % 5 + 1)]
    want = {}
    for g, path in rows:
        folders = path.split("/")[:-1]
        want[g] = os.path.commonprefix([want.get(g, folders), folders])
    got = {r.g: r.base for r in paths.common_base(spark.createDataFrame(rows, "g int, path string"), "g").collect()}
    assert got == {g: "/".join(x) for g, x in want.items()}


def test_pair_lists(spark, tmp_path):
    assert paths.parse_pair_list('[{"target":"/new/q","source":"old/p"}, {"source":"/s","target":"t"}]', "/at") == [("/at/old/p", "/new/q"), ("/s", "/at/t")]
    for i, bad in fx.PAIR_LISTS:
        if bad.count("{") != 1 or "source" not in bad or "target" not in bad:
            if bad.count("{") < 2:
                with pytest.raises(ValueError):
                    paths.parse_pair_list(bad)
    (tmp_path / "pairs.json").write_text(json.dumps([{"source": "a", "target": "b"}]))
    got = paths.pairs_from_json(spark, str(tmp_path / "pairs.json")).first()
    assert got.source.endswith("/a") and got.target.endswith("/b")
    assert paths.pairs_from_flags(spark, ["old::new::x"]).first().target == "new::x"
    for bad in ([], ["a"], ["::b"], ["a:: "]):
        with pytest.raises(ValueError):
            paths.pairs_from_flags(spark, bad)


def test_lists_agree_with_the_parser(spark):
    def plain(text):
        try:
            return len(paths.parse_pair_list(text))
        except ValueError:
            return 0

    got = {r.list_id: (r.n, r.ok) for r in paths.pair_lists_ok(fx.pair_lists(spark)).collect()}
    assert got == {i: (plain(t), plain(t) > 0) for i, t in fx.PAIR_LISTS} and sum(ok for _, ok in got.values()) > 8


def test_journal_fold_agrees_with_windows(spark):
    rows = fx.journal(spark, spark.range(1, 300).withColumnRenamed("id", "o_orderkey")).cache()
    want, states = {}, {}
    for name in {r.journal for r in rows.collect()}:
        fold, error = journal.Fold(), None
        for r in sorted((r for r in rows.collect() if r.journal == name), key=lambda r: r.seq):
            try:
                fold.add(r.asDict(recursive=True))
            except ValueError:
                error = r.seq
                break
        want[name] = error
        if error is None:
            states |= {(name, i): (e["state"], fold.known["committed"]) for i, e in enumerate(fold.known["entries"], 1)}
    assert {r.journal: r.error_seq for r in journal.audit(rows).collect()} == want and None in want.values() and 3 in want.values()
    assert {(r.journal, r.entry): (r.state, r.committed) for r in journal.replay(rows).collect()} == states


def test_journal_file(spark, tmp_path):
    path = str(tmp_path / "j")
    j = journal.Journal(path, [{"path": "a", "temp": ".tmp-a", "backup": ".bak-a"}, {"path": "b", "temp": ".tmp-b", "backup": ".bak-b"}])
    j.move(0, "backed-up")
    j.move(0, "replaced")
    with open(path, "a") as f:
        f.write('{"version": 2, "kind": "com')
    records = journal.Journal.read(path)
    assert len(records) == 3
    rows = [("j", i, r["version"], r["kind"], r.get("state"), r.get("entry"), [tuple(e[k] for k in ("path", "temp", "backup", "state")) for e in r["entries"]] if "entries" in r else None) for i, r in enumerate(records)]
    got = {r.path: r.action for r in journal.recovery(spark.createDataFrame(rows, journal.SCHEMA), spark.createDataFrame([("j", ".bak-a")], "journal string, path string")).collect()}
    assert got == {"a": "restore-backup", "b": "remove-temp"}
    # A crash between a rename and its record: the backup counts, not the state.
    both = spark.createDataFrame([("j", ".bak-a"), ("j", ".bak-b")], "journal string, path string")
    assert {r.path: (r.action, r.turn) for r in journal.recovery(spark.createDataFrame(rows, journal.SCHEMA), both).collect()} == {"a": ("restore-backup", 1), "b": ("restore-backup", 0)}
    with pytest.raises(ValueError):
        j.move(0, "gone")


def test_interrupted_commits_recover(tmp_path):
    """A crash after any step of a commit leaves the old files or the new ones, none lost."""
    from palimpsest import api

    names = ["a", "d/b"]
    for steps in range(8):
        root = tmp_path / str(steps)
        (root / "d").mkdir(parents=True)
        for n in names:
            (root / n).write_text("old")
        entries = [{"path": n, "temp": os.path.join(os.path.dirname(n), ".tmp-1"), "backup": os.path.join(os.path.dirname(n), ".bak-1")} for n in names]
        for e in entries:
            (root / e["temp"]).write_text("new")
        j, done = journal.Journal(str(root / ".journal-x"), entries), 0
        for i, e in enumerate(entries):
            for step in (
                lambda e=e: os.rename(root / e["path"], root / e["backup"]), lambda i=i: j.move(i, "backed-up"),
                lambda e=e: os.rename(root / e["temp"], root / e["path"]), lambda i=i: j.move(i, "replaced"),
            ):
                if done < steps or steps == 7:
                    step()
                done += 1
        if steps == 7:
            j.commit()
        assert api.recover(str(root)) == 1 and api.recover(str(root)) == 0
        assert {(root / n).read_text() for n in names} == {"new" if steps == 7 else "old"}
        assert sorted(x.name for x in root.rglob("*") if x.is_file()) == ["a", "b"]


@pytest.mark.parametrize("mode", sorted(FINE_BANDS))
def test_fine_plans_against_brute_force(spark, mode):
    def touched(f, size, band):
        spans = [(at, n) for g, kind, at, n in fx.PLAN_WINDOWS if g == f and kind.startswith("DELTA") and n]
        found = {k for at, n in spans for k in range(at // band, (at + n - 1) // band + 1)}
        return len(found), sum(min(band, size - k * band) for k in found)

    want = {}
    for f, size in fx.PLAN_FILES:
        _, whole = touched(f, size, IDENTITY_CHUNK)
        ways = []
        for order, band in enumerate(FINE_BANDS[mode]):
            n, covered = touched(f, size, band)
            table = n * FINE_ENTRY_BYTES
            if n and covered + table * FINE_PENALTY[mode] < whole and whole - covered >= max(1 << 18, 2 * table):
                ways.append((covered + table * FINE_PENALTY[mode], order, band, n, covered, whole))
        if ways:
            want[f] = min(ways)[2:]
    got = verify.plan_fine(fx.plan_files(spark), fx.plan_windows(spark), mode).collect()
    assert {r.file_id: (r.band_size, r.n_bands, r.fine_bytes, r.canonical_bytes) for r in got} == want
    assert 10 < len(want) < len(fx.PLAN_FILES)


def test_estimate_and_identity(spark):
    sizes = [(71 * k, 13 * k * k) for k in range(9)]
    got = inspect.estimate(spark.createDataFrame(sizes, "source_size long, target_size long"), reverse=True).first()
    assert got.work_bytes == sum(map(sum, sizes)) and got.total_bytes == got.work_bytes + got.output_bytes
    a = spark.sql("SELECT * FROM VALUES ('x', 1L, timestamp'2020-01-01'), ('y', 2L, timestamp'2020-01-01'), ('z', 3L, timestamp'2020-01-01') t(path, length, modificationTime)")
    b = spark.sql("SELECT * FROM VALUES ('x', 1L, timestamp'2020-01-01'), ('y', 9L, timestamp'2020-01-01'), ('w', 3L, timestamp'2020-01-01') t(path, length, modificationTime)")
    assert {r.path: r.change for r in inspect.stable(a, b).collect()} == {"y": "changed", "z": "removed", "w": "added"}


def test_preflight_of_every_mixture(spark):
    """Up to three files in each of the states a file can be in, against the rules in words."""
    import itertools

    def state(files):
        if "absent" in files:
            return "missing-files"
        if {"folder", "neither"} & set(files):
            return "invalid-files"
        old, new = (all(f in (x, "both") for f in files) for x in ("old", "new"))
        return "bidirectional-ready" if old and new else "forward-ready" if old else "reverse-ready" if new else "mixed-files"

    kinds = ("old", "new", "both", "neither", "absent", "folder")
    cases = [c for n in (1, 2, 3) for c in itertools.product(kinds, repeat=n)]
    expected, installed = [], []
    for i, files in enumerate(cases):
        for k, f in enumerate(files):
            expected.append((i, f"f{k}", "o", "o" if f == "both" else "n", True))
            if f != "absent":
                installed.append((i, f"f{k}", f != "folder", {"old": "o", "both": "o", "new": "n"}.get(f, "?")))
    got = inspect.inspect(
        spark.createDataFrame(expected, "patch_id long, path string, source_digest string, target_digest string, has_reverse boolean"),
        spark.createDataFrame(installed, "patch_id long, path string, regular boolean, digest string"),
    ).collect()
    assert {r.patch_id: r.state for r in got} == {i: state(c) for i, c in enumerate(cases)}
