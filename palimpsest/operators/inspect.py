"""Preflight: which state installed files are in, and what can be applied to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def file_states(expected: DataFrame, installed: DataFrame) -> DataFrame:
    """``expected(patch_id, path, source_digest, target_digest, has_reverse)`` and
    ``installed(patch_id, path, regular, digest)`` as one row per expected file, with ``missing``,
    ``is_source``, ``is_target`` and ``issue`` (not-regular or hash-mismatch)."""
    rows = expected.join(installed, ["patch_id", "path"], "left")
    missing = F.col("regular").isNull()
    bad = ~missing & ~F.coalesce("regular", F.lit(False))
    source = ~missing & ~bad & F.coalesce(F.col("digest") == F.col("source_digest"), F.lit(False))
    target = ~missing & ~bad & F.coalesce(F.col("digest") == F.col("target_digest"), F.lit(False))
    issue = F.when(bad, "not-regular").when(~missing & ~source & ~target, "hash-mismatch")
    return rows.select(
        "patch_id", "path", "has_reverse", missing.alias("missing"), source.alias("is_source"), target.alias("is_target"), issue.alias("issue")
    )


def inspect(expected: DataFrame, installed: DataFrame) -> DataFrame:
    """One row per patch: ``patch_id, state, can_forward, can_reverse, n_missing, n_issues``."""
    each = file_states(expected, installed).groupBy("patch_id").agg(
        F.count(F.when(F.col("missing"), 1)).alias("n_missing"),
        F.count("issue").alias("n_issues"),
        F.bool_and("is_source").alias("all_source"),
        F.bool_and("is_target").alias("all_target"),
        F.bool_or("is_source").alias("some_source"),
        F.bool_or("is_target").alias("some_target"),
        F.bool_and("has_reverse").alias("has_reverse"),
    )
    forward = F.col("all_source")
    reverse = F.col("all_target") & F.col("has_reverse")
    state = (
        F.when(F.col("n_missing") > 0, "missing-files")
        .when(forward & reverse, "bidirectional-ready")
        .when(forward, "forward-ready")
        .when(reverse, "reverse-ready")
        .when(F.col("some_source") & F.col("some_target") & (F.col("n_issues") == 0), "mixed-files")
        .otherwise("invalid-files")
    )
    return each.select("patch_id", state.alias("state"), forward.alias("can_forward"), reverse.alias("can_reverse"), "n_missing", "n_issues")


def estimate(sizes: DataFrame, reverse: bool = False) -> DataFrame:
    """``work_bytes, output_bytes, total_bytes`` needed to create a patch over
    ``sizes(source_size, target_size)``; a sum beyond 64 bits is an error."""
    s, t = F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("target_size"), F.lit(0))
    sums = sizes.agg(s.cast("long").alias("s"), t.cast("long").alias("t"))
    output = "t + t div 4 + 67108864" + " + s + s div 4" * reverse
    return sums.selectExpr("s + t AS work_bytes", f"{output} AS output_bytes", f"s + t + {output} AS total_bytes")


def stable(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths whose identity (length, modification time) differs between two listings, with
    ``change``: changed, removed or added."""
    a = before.select("path", F.struct("length", "modificationTime").alias("a"))
    b = after.select("path", F.struct("length", "modificationTime").alias("b"))
    change = F.when(F.col("b").isNull(), "removed").when(F.col("a").isNull(), "added").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, "path", "full").select("path", change.alias("change")).where("change IS NOT NULL")
