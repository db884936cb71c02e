"""Paths: what a container may hold, which collide, their common directory, and lists of pairs."""

from __future__ import annotations

import json
import os
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from palimpsest.functions.constants import MAX_PATH


def path_ok(path: str) -> Column:
    """Whether a path is relative, clean and portable: forward slashes, no ``.`` or ``..``, no
    component that ends in a space or a full stop or has a colon, no NUL, at most 1 MiB."""
    return F.coalesce(
        F.expr(f"""
        length({path}) > 0 AND octet_length({path}) <= {MAX_PATH}
        AND instr({path}, char(0)) = 0 AND instr({path}, '\\\\') = 0 AND NOT startswith({path}, '/')
        AND forall(split({path}, '/', -1), c -> c <> '' AND NOT endswith(c, ' ') AND NOT endswith(c, '.') AND instr(c, ':') = 0)"""),
        F.lit(False),
    )


def collision_key(path: str) -> str:
    """What paths have in common that one file system may take for the same."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", os.path.normpath(path).replace("\\", "/")).casefold())


def collisions(paths: DataFrame) -> DataFrame:
    """``collision_key, n, first_path`` of the ``paths(path)`` that collide."""

    @F.pandas_udf(StringType())
    def key(path: pd.Series) -> pd.Series:
        return path.map(collision_key, na_action="ignore")

    each = paths.select("path", key("path").alias("collision_key")).groupBy("collision_key")
    return each.agg(F.count("*").alias("n"), F.min("path").alias("first_path")).where("n > 1")


def common_base(paths: DataFrame, group: str) -> DataFrame:
    """``group, base``: the deepest directory that holds all files of a group.

    What the least and the greatest directory share (by components) all others share, so two
    partially aggregated extremes are enough.
    """
    parts = F.split("path", "/", -1)
    folder = F.slice(parts, 1, F.size(parts) - 1)
    ends = paths.groupBy(group).agg(F.min(folder).alias("a"), F.max(folder).alias("b"))
    same = F.expr("""
        filter(sequence(0, least(size(a), size(b))), n -> forall(sequence(0, n), i -> i = 0 OR get(a, i - 1) = get(b, i - 1)))""")
    return ends.select(group, F.array_join(F.slice("a", 1, F.array_max(same)), "/").alias("base"))


def pairs_from_flags(spark: SparkSession, flags: list[str]) -> DataFrame:
    """``source, target`` of values like ``old::new``; both sides must not be blank."""
    rows = spark.createDataFrame([(x,) for x in flags], "flag string")
    parts = F.split("flag", "::", 2)
    out = rows.select(F.trim(F.get(parts, F.lit(0))).alias("source"), F.trim(F.get(parts, F.lit(1))).alias("target"))
    if not flags or not out.where("coalesce(source, '') = '' OR coalesce(target, '') = ''").isEmpty():
        raise ValueError("a pair is two paths with :: between them")
    return out


def parse_pair_list(text: str, folder: str = "") -> list[tuple[str, str]]:
    """Strictly an array of objects with ``source`` and ``target``, neither blank; relative paths
    are taken from ``folder``."""
    if len(text.encode()) > 16 << 20:
        raise ValueError("a list of pairs is at most 16 MiB")
    rows = json.loads(text)
    if not isinstance(rows, list) or not rows:
        raise ValueError("a list of pairs is an array that isn't empty")
    out = []
    for row in rows:
        if not isinstance(row, dict) or set(row) != {"source", "target"} or not all(isinstance(x, str) and x.strip() for x in row.values()):
            raise ValueError("a pair has a source and a target, and nothing else")
        out.append((os.path.join(folder, row["source"]), os.path.join(folder, row["target"])))
    return out


def pairs_from_json(spark: SparkSession, path: str) -> DataFrame:
    """``source, target`` from a JSON file that Spark can read."""
    text = spark.read.text(path, wholetext=True).first()[0]
    return spark.createDataFrame(parse_pair_list(text, os.path.dirname(path)), "source string, target string")


def pair_lists_ok(lists: DataFrame) -> DataFrame:
    """``list_id, n, ok`` of JSON texts in ``lists(list_id, text)``: the rules of
    ``parse_pair_list`` as expressions, for many lists at once (a key given twice is an error
    here).

    The parser stops after the first value, so each text stands before a key that it can't
    contain, its own hash; what follows the list would keep the parser from that key.
    """
    mark = F.sha2("text", 256)
    given = lists.select("list_id", mark.alias("mark"), F.concat(F.lit('{"v":'), "text", F.lit(',"'), mark, F.lit('":1}')).alias("text"))
    given = given.select("list_id", "mark", F.expr("try_variant_get(try_parse_json(text), '$', 'map<string,variant>')").alias("m"))
    given = given.select("list_id", F.expr("map_contains_key(m, mark) AND size(m) = 2").alias("whole"), F.expr("try_variant_get(m['v'], '$', 'array<variant>')").alias("rows"))
    good = F.expr("""
        coalesce(whole AND size(rows) > 0 AND forall(rows, r -> schema_of_variant(r) = 'OBJECT<source: STRING, target: STRING>'
          AND trim(try_variant_get(r, '$.source', 'string')) <> '' AND trim(try_variant_get(r, '$.target', 'string')) <> ''), false)""")
    return given.select("list_id", F.when(good, F.size("rows")).otherwise(0).cast("long").alias("n"), good.alias("ok"))
