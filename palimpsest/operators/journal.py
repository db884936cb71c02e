"""Journals of a commit: appending records, and what recovery has to do."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATES = ("prepared", "backed-up", "replaced")
ENTRY = "struct<path:string,temp:string,backup:string,state:string>"
SCHEMA = f"journal string, seq int, version int, kind string, state string, entry long, entries array<{ENTRY}>"


def _records(records: DataFrame) -> DataFrame:
    """Each record with ``n`` (its entries), ``epoch`` (the ``seq`` of the snapshot it builds on)
    and ``ok``: whether it may follow those before it, if these are all right themselves.

    Windows are over one journal, whose size the format bounds.
    """
    zero = lambda c, v: F.coalesce(F.col(c), F.lit(v)).alias(c)
    given = records.select(
        "journal", "seq", zero("version", 0), zero("kind", ""), zero("state", ""), zero("entry", 0), F.coalesce(F.size("entries"), F.lit(0)).alias("n"), "entries"
    )
    snapshot = (F.col("entry") == 0) & (F.col("n") > 0) & (
        ((F.col("version") == 1) & (F.col("kind") == "")) | ((F.col("version") == 2) & (F.col("kind") == "snapshot"))
    )
    before = Window.partitionBy("journal").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    base = F.struct("version", "n", F.expr("size(filter(entries, e -> e.state = 'replaced'))").alias("replaced"))
    out = given.withColumn("snapshot", snapshot).select(
        "*", F.max(F.when(F.col("snapshot"), F.col("seq"))).over(before).alias("epoch"), F.last(F.when(F.col("snapshot"), base), True).over(before).alias("base")
    )
    was = out.where("snapshot").select("journal", F.col("seq").alias("epoch"), F.posexplode("entries").alias("at", "e"))
    was = was.select("journal", "epoch", (F.col("at") + 1).cast("long").alias("entry"), F.col("e.state").alias("was"))
    out = out.drop("entries").join(was, ["journal", "epoch", "entry"], "left")
    last = F.lag("state").over(Window.partitionBy("journal", "epoch", "kind", "entry").orderBy("seq"))
    moved = F.sum(F.when((F.col("kind") == "entry") & (F.col("state") == "replaced"), 1).otherwise(0)).over(
        Window.partitionBy("journal", "epoch").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    )
    out = out.withColumn("now", F.coalesce(last, F.col("was"))).withColumn("moved", moved)
    follows = (F.col("version") == 2) & (F.col("base.version") == 2) & (F.col("n") == 0)
    step = ((F.col("now") == "prepared") & (F.col("state") == "backed-up")) | ((F.col("now") == "backed-up") & (F.col("state") == "replaced"))
    entry = follows & (F.col("kind") == "entry") & F.col("entry").between(1, F.col("base.n")) & step
    commit = follows & (F.col("kind") == "commit") & (F.col("entry") == 0) & (F.col("state") == "")
    commit = commit & (F.col("base.replaced") + F.col("moved") == F.col("base.n"))
    return out.withColumn("ok", F.col("snapshot") | F.coalesce(entry, F.lit(False)) | F.coalesce(commit, F.lit(False)))


def audit(records: DataFrame) -> DataFrame:
    """``journal, valid, error_seq``: a journal is valid if every record may follow those before it.

    It starts with a snapshot: of version 2 and that kind, or of version 1 and without a kind, with
    entries.  On one of version 2 follow moves of single entries, counted from 1, from prepared to
    backed-up to replaced; a commit once all are replaced; or another snapshot.
    """
    wrong = F.min(F.when(~F.col("ok"), F.col("seq")))
    return _records(records).groupBy("journal").agg(wrong.isNull().alias("valid"), wrong.alias("error_seq"))


def replay(records: DataFrame) -> DataFrame:
    """The last state of each entry of the valid journals: ``journal, entry, path, temp, backup,
    state, committed``; entries count from 1."""
    checked = _records(records)
    good = checked.groupBy("journal").agg(F.bool_and("ok").alias("valid"), F.max("epoch").alias("epoch")).where("valid").drop("valid")
    mine = checked.join(good, ["journal", "epoch"])
    last = mine.where("kind = 'entry'").groupBy("journal", "entry").agg(F.max_by("state", "seq").alias("now"))
    done = mine.groupBy("journal").agg(F.bool_or((F.col("kind") == "commit") | (F.col("snapshot") & (F.col("state") == "committed"))).alias("committed"))
    entries = records.join(good, "journal").where("seq = epoch").select("journal", F.posexplode("entries").alias("at", "e"))
    entries = entries.select("journal", (F.col("at") + 1).cast("long").alias("entry"), "e.*")
    return entries.join(last, ["journal", "entry"], "left").join(done, "journal").select(
        "journal", "entry", "path", "temp", "backup", F.coalesce("now", "state").alias("state"), "committed"
    )


def recovery(records: DataFrame, files: DataFrame) -> DataFrame:
    """``journal, entry, path, action, turn``: what makes the files of valid journals whole again.

    ``files(journal, path)`` are the files that exist.  After a commit backups are removed.  Before
    it, what has a backup is restored from it, whatever its state says: a crash may have come
    between a rename and its record.  Entries are undone from the last to the first (``turn``
    counts from 0), and each loses its temporary file.
    """
    there = files.select("journal", F.col("path").alias("backup"), F.lit(True).alias("there")).distinct()
    action = F.when(F.col("committed"), "remove-backup").when(F.col("there"), "restore-backup").otherwise("remove-temp")
    turn = F.count("*").over(Window.partitionBy("journal")) - F.col("entry")
    return replay(records).join(there, ["journal", "backup"], "left").select("journal", "entry", "path", action.alias("action"), turn.cast("long").alias("turn"))


class Fold:
    """The same rules, record by record: of one journal in a file or a stream."""

    def __init__(self, known: dict | None = None) -> None:
        self.known = known or {"version": 0, "entries": [], "committed": False}

    def add(self, record: dict) -> None:
        known, state = self.known, record.get("state") or ""
        kind, entry, entries = record.get("kind") or "", record.get("entry") or 0, record.get("entries") or []
        version = record.get("version") or 0
        if (version, kind) in ((1, ""), (2, "snapshot")) and entry == 0 and entries:
            known.update(version=version, entries=[dict(e) for e in entries], committed=state == "committed")
            return
        if version != 2 or known["version"] != 2 or entries:
            raise ValueError("a record that does not follow from a snapshot")
        if kind == "entry":
            if not 1 <= entry <= len(known["entries"]):
                raise ValueError("a move of an entry that there is not")
            if (known["entries"][entry - 1]["state"], state) not in (("prepared", "backed-up"), ("backed-up", "replaced")):
                raise ValueError("a move between states that do not follow each other")
            known["entries"][entry - 1]["state"] = state
        elif kind == "commit":
            if entry or state or any(e["state"] != "replaced" for e in known["entries"]):
                raise ValueError("a commit before every entry was replaced")
            known["committed"] = True
        else:
            raise ValueError("a record of an unknown kind")


def is_entry_safe(entry: dict, temp_prefix: str = ".tmp-", backup_prefix: str = ".bak-") -> bool:
    """``entry_safe`` of one entry, whose path must stay below its root."""
    path = entry["path"]
    if not path or path.startswith("/") or any(x in ("", ".", "..") for x in path.split("/")):
        return False
    folder = os.path.dirname(path)
    return all(
        os.path.dirname(entry[c]) == folder and os.path.basename(entry[c]).startswith(prefix)
        for c, prefix in (("temp", temp_prefix), ("backup", backup_prefix))
    )


def entry_safe(path: str, temp: str, backup: str, temp_prefix: str = ".tmp-", backup_prefix: str = ".bak-"):
    """Whether temp and backup lie in the directory of the path, under the expected names."""
    folder = lambda c: f"regexp_extract({c}, '^(.*/)?[^/]*$', 1)"
    name = lambda c: f"regexp_extract({c}, '([^/]*)$', 1)"
    return F.expr(
        f"{folder(path)} = {folder(temp)} AND {folder(path)} = {folder(backup)} "
        f"AND startswith({name(temp)}, '{temp_prefix}') AND startswith({name(backup)}, '{backup_prefix}')"
    )


class Journal:
    """Append-only records of one commit, one JSON object a line."""

    def __init__(self, path: str, entries: list[dict]) -> None:
        self.path = path
        self._append({"version": 2, "kind": "snapshot", "state": "prepared", "entries": [e | {"state": "prepared"} for e in entries]})

    def _append(self, record: dict) -> None:
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(json.dumps(record) + "\n")
            f.flush()
            os.fsync(f.fileno())

    def move(self, entry: int, state: str) -> None:
        """Entry number ``entry``, from 0, is now in ``state``; records count from 1."""
        if state not in STATES:
            raise ValueError(f"state must be one of {STATES}")
        self._append({"version": 2, "kind": "entry", "entry": entry + 1, "state": state})

    def commit(self) -> None:
        self._append({"version": 2, "kind": "commit"})

    @staticmethod
    def read(path: str) -> list[dict]:
        """All whole records; a cut last line is left out once there is one before it."""
        out = []
        with open(path, encoding="utf-8") as f:
            for line in f:
                try:
                    out.append(json.loads(line))
                except ValueError:
                    if not out:
                        raise
                    break
        return out
