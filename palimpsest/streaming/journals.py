"""Journals as they are written: the ordered fold of ``operators.journal`` over a stream."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palimpsest.operators.journal import Fold

OUTPUT = "journal string, entry long, path string, state string, committed boolean, valid boolean"


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Records of one journal in order of ``seq``; the state is what is known so far, and records
    that come before their snapshot, or out of order, wait in it."""
    known = json.loads(state.get[0]) if state.exists else {"next": 0, "bad": False, "fold": Fold().known, "waiting": {}}
    for batch in batches:
        for r in batch.to_dict("records"):
            entries = r["entries"]
            known["waiting"][str(int(r["seq"]))] = {
                "version": int(r["version"]),
                "kind": r["kind"],
                "state": r["state"],
                "entry": None if pd.isna(r["entry"]) else int(r["entry"]),
                "entries": None if entries is None else [dict(e.asDict() if hasattr(e, "asDict") else e) for e in entries],
            }
    while (record := known["waiting"].pop(str(known["next"]), None)) is not None:
        known["next"] += 1
        if not known["bad"]:
            try:
                Fold(known["fold"]).add(record)
            except ValueError:
                known["bad"] = True
    state.update((json.dumps(known),))
    fold = known["fold"]
    rows = [(key[0], i, e["path"], e["state"], fold["committed"], not known["bad"]) for i, e in enumerate(fold["entries"], 1)]
    yield pd.DataFrame(rows, columns=["journal", "entry", "path", "state", "committed", "valid"])


def replay_stream(records: DataFrame) -> DataFrame:
    """After each batch, the state of every entry of the journals that it had records of; a journal
    with a record that may not follow is not ``valid`` any more, and stays as it was before it.

    ``records`` is a stream with the columns of ``operators.journal.SCHEMA``.
    """
    return records.groupBy("journal").applyInPandasWithState(_fold, OUTPUT, "known string", "update", GroupStateTimeout.NoTimeout)
