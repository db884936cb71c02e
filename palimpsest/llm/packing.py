"""Packing into length buckets that waste the least padding.

The bucket boundaries are optimal for the histogram of all lengths: dynamic programming over
the distinct lengths finds the ``n_buckets`` boundaries with the least total padding, in time
proportional to buckets times lengths (the costs form lines, so a lower hull replaces the
inner search).  The histogram that reaches the driver has one row for each distinct length;
n distinct lengths take n^2 / 2 tokens at least, so 10^13 tokens have less than five million.

Inside a bucket documents follow each other by doc_id and are cut into batches of as many as
the token budget holds at the bucket's length.  Ranks come from counts of sorted ranges, so no
bucket is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, stash

N_BUCKETS = 16
TOKEN_BUDGET = 65_536


def boundaries(histogram: dict[int, int], n_buckets: int = N_BUCKETS) -> list[int]:
    """At most ``n_buckets`` bucket lengths, ascending, that minimise total padding."""
    lengths = sorted(x for x, n in histogram.items() if n > 0)
    if not lengths:
        return []
    m = len(lengths)
    count, total = [0] * (m + 1), [0] * (m + 1)  # documents and tokens among the first i lengths
    for i, x in enumerate(lengths):
        count[i + 1] = count[i] + histogram[x]
        total[i + 1] = total[i] + histogram[x] * x
    best: list[int | None] = [0] + [None] * m  # least padding of the first i lengths
    back: list[list[int]] = []
    for _ in range(min(n_buckets, m)):
        new: list[int | None] = [None] * (m + 1)
        came = [0] * (m + 1)
        hull: list[tuple[int, int, int]] = []  # lines (slope, offset, i), slopes falling
        at = 0
        for j in range(1, m + 1):
            if best[j - 1] is not None:
                line = (-count[j - 1], best[j - 1] + total[j - 1], j - 1)
                while len(hull) >= 2 and _useless(hull[-2], hull[-1], line):
                    hull.pop()
                hull.append(line)
                at = min(at, len(hull) - 1)
            if not hull:
                continue
            x = lengths[j - 1]
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                at += 1
            slope, offset, i = hull[at]
            new[j], came[j] = slope * x + offset + x * count[j] - total[j], i
        best = new
        back.append(came)
    out, j = [], m
    for came in reversed(back):
        out.append(lengths[j - 1])
        j = came[j]
    return out[::-1]


def _useless(a: tuple, b: tuple, c: tuple) -> bool:
    """Whether line b is nowhere below both a and c (slopes fall from a to c)."""
    return (c[1] - a[1]) * (a[0] - b[0]) <= (b[1] - a[1]) * (a[0] - c[0])


def word_tokens(text: Column) -> Column:
    """Words of a text and one token for its end."""
    return (F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")) + 1).cast("long")


def pack(lengths: DataFrame, n_buckets: int = N_BUCKETS, token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """``lengths(doc_id, n_tokens)``, with ids that don't repeat, as ``doc_id, n_tokens,
    bucket int, bucket_tokens long, batch long, slot int``.

    ``bucket`` counts from 0 by length, ``batch`` from 0 in each bucket, ``slot`` from 0 in each
    batch; a batch of a bucket longer than the budget holds one document.
    """
    if n_buckets < 1 or token_budget < 1:
        raise ValueError("n_buckets and token_budget must be positive")
    spark = lengths.sparkSession
    rows = stash(lengths.select("doc_id", "n_tokens"), "lengths")
    counted = rows.groupBy("n_tokens").agg(F.count("*").alias("n")).toPandas()
    histogram = dict(zip(counted["n_tokens"].tolist(), counted["n"].tolist(), strict=True))
    ends = boundaries(histogram, n_buckets)
    if not ends:
        ends = [1]
    bucket = F.lit(len(ends) - 1)
    for k in range(len(ends) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= ends[k], k).otherwise(bucket)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = stash(
        rows.withColumn("bucket", bucket.cast("int"))
        .repartitionByRange(parts, "bucket", "doc_id")
        .withColumn("part", F.spark_partition_id()),
        "ranges",
    )
    sizes = ranged.groupBy("bucket", "part").agg(F.count("*").alias("n"))
    order = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("bucket", "part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    ranked = ranged.withColumn("i", F.row_number().over(Window.partitionBy("bucket", "part").orderBy("doc_id")))
    # One row for each range and bucket: at most `parts` + `n_buckets` of them.
    ranked = ranked.join(F.broadcast(before), ["bucket", "part"]).withColumn("rank", F.col("before") + F.col("i") - 1)
    lengths_of = F.element_at(F.array(*(F.lit(x).cast("long") for x in ends)), F.col("bucket") + 1)
    fit = F.greatest(F.floor(F.lit(token_budget) / F.col("bucket_tokens")), F.lit(1)).cast("long")
    return ranked.withColumn("bucket_tokens", lengths_of).select(
        "doc_id",
        "n_tokens",
        "bucket",
        "bucket_tokens",
        F.floor(F.col("rank") / fit).cast("long").alias("batch"),
        (F.col("rank") % fit).cast("int").alias("slot"),
    )


def pack_documents(docs: DataFrame, n_buckets: int = N_BUCKETS, token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """``pack`` over the words of whole texts; null and empty texts have the end token alone.

    An empty table gives an empty result.
    """
    return pack(documents(docs).select("doc_id", word_tokens(F.col("text")).alias("n_tokens")), n_buckets, token_budget)
