"""The registered queries of the engine: each applies operators to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import apply, delta, inspect, journal, layout, paths, verify
from palimpsest.operators import windows as win
from palimpsest.plans import fixtures
from palimpsest.plans.pairs import derived_pairs

#: Windows of the derived pairs: documents are small, so are their windows.
SMALL = 256
CHUNK_WINDOW, CHUNK_AVERAGE = 1024, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived_pairs(table(spark, sf_dir, "documents"))


def window_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = win.classify(win.windows(pairs(spark, sf_dir), SMALL))
    return rows.groupBy("edit", "kind").agg(F.count("*").alias("n_windows"), F.sum("output_size").alias("n_bytes"))


def auto_window_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select((F.col("o_orderkey") * F.col("o_orderkey") * 37).alias("size"))
    return rows.groupBy(win.auto_window_size(F.col("size")).cast("long").alias("window_size")).agg(
        F.count("*").alias("n_files"), F.max("size").alias("largest")
    )


def window_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = win.windows(pairs(spark, sf_dir), SMALL)
    first, n = win.source_chunks(F.col("span_offset"), F.col("span_size"))
    return rows.groupBy("edit").agg(
        F.count("*").alias("n_windows"),
        F.sum("span_size").alias("span_bytes"),
        F.sum("span_offset").alias("span_offsets"),
        F.sum(n).alias("n_chunks"),
        F.max(first).alias("last_chunk"),
        F.countDistinct("pair_id", win.output_group(F.col("output_offset"))).alias("n_groups"),
        F.count("same").alias("n_sparse_eligible"),
    )


def output_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of the order table's made-up file sizes, at their automatic size, by group."""
    rows = table(spark, sf_dir, "orders").where("o_orderkey > 0").select("o_orderkey", (F.col("o_orderkey") * 4099).alias("size"))
    rows = rows.withColumn("w", win.auto_window_size(F.col("size")))
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.col("w").cast("long")))
    each = rows.select("o_orderkey", "size", "w", at.alias("output_offset"))
    size = F.least(F.col("w"), F.col("size") - F.col("output_offset"))
    return each.groupBy(win.output_group(F.col("output_offset")).alias("output_group")).agg(F.count("*").alias("n_windows"), F.sum(size).alias("n_bytes"))


def clone_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = win.classify(win.windows(pairs(spark, sf_dir), SMALL))
    return win.clone_eligible(rows, min_size=1024).select("pair_id", "source_size", "target_size", "same_bytes", "clone")


def _sparse(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = win.windows(pairs(spark, sf_dir), SMALL, halo=True)
    return rows, delta.operations(rows)


def sparse_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ops = _sparse(spark, sf_dir)
    return ops.groupBy("pair_id", "op").agg(F.count("*").alias("n_ops"), F.sum("length").alias("n_bytes"), F.max("length").alias("longest"))


def sparse_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, ops = _sparse(spark, sf_dir)
    sizes = delta.encoded_sizes(ops, rows)
    return sizes.select("pair_id", "window_idx", "stream_size", "instructions", "copied")


def _choice(mode: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows, ops = _sparse(spark, sf_dir)
        sizes = delta.encoded_sizes(ops, rows)
        changed = win.classify(rows).where("kind = 'CHANGED'").select("pair_id", "window_idx", "output_size", "span_size")
        chosen = delta.choose(changed.join(sizes, ["pair_id", "window_idx"], "left"), mode)
        return chosen.groupBy("choice").agg(
            F.count("*").alias("n_windows"), F.sum("payload_size").cast("long").alias("payload_bytes"), F.sum("output_size").alias("n_bytes")
        )

    return query


def chunk_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = win.windows(pairs(spark, sf_dir), CHUNK_WINDOW)
    each = delta.chunk_table(rows, CHUNK_AVERAGE)
    return each.groupBy("pair_id").agg(
        F.count("*").alias("n_chunks"),
        F.max("chunk_length").alias("longest"),
        F.min("chunk_length").alias("shortest"),
        F.sum(F.col("chunk_offset") * (F.col("window_idx") + 1)).alias("offset_sum"),
    )


def chunk_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = delta.Options(CHUNK_WINDOW, cdc=CHUNK_AVERAGE, cdc_gate=128)
    rows = win.windows(pairs(spark, sf_dir), CHUNK_WINDOW, halo=True)
    ops = delta.operations(rows, "chunks", options)
    return ops.groupBy("pair_id", "op").agg(F.count("*").alias("n_ops"), F.sum("length").alias("n_bytes"))


def _built(spark: SparkSession, sf_dir: str, zstd: bool = False) -> tuple[DataFrame, DataFrame]:
    given = pairs(spark, sf_dir)
    return given, delta.build_windows(given, delta.Options(SMALL, zstd=zstd, cdc=0))


def window_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, built = _built(spark, sf_dir)
    return built.groupBy("edit", "kind").agg(
        F.count("*").alias("n_windows"), F.sum("payload_size").alias("payload_bytes"), F.sum("output_size").alias("n_bytes"),
        F.sum("instruction_count").alias("instructions"),
    )


def window_build_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = pairs(spark, sf_dir)
    built = delta.build_windows(given, delta.Options(CHUNK_WINDOW, cdc=CHUNK_AVERAGE, cdc_gate=128))
    return built.groupBy("edit", "kind").agg(F.count("*").alias("n_windows"), F.sum("output_size").alias("n_bytes"))


def apply_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    given, built = _built(spark, sf_dir, zstd=True)
    return apply.rebuild(built, given.select("pair_id", "source"))


def apply_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = pairs(spark, sf_dir)
    built = delta.build_windows(given, delta.Options(CHUNK_WINDOW, cdc=CHUNK_AVERAGE, cdc_gate=128, mode="patch-size"))
    return apply.rebuild(built, given.select("pair_id", "source"))


def apply_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = apply.reversed_pairs(pairs(spark, sf_dir))
    built = delta.build_windows(given, delta.Options(SMALL, mode="apply-speed", cdc=0))
    return apply.rebuild(built, given.select("pair_id", "source"))


def payload_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, built = _built(spark, sf_dir)
    rows = built.select(
        F.floor(F.col("pair_id") / 64).cast("long").alias("patch_id"), F.col("pair_id").alias("file_idx"), F.lit("forward").alias("dir"),
        "window_idx", "payload_size",
    )
    placed = layout.payload_offsets(rows)
    return placed.groupBy("patch_id").agg(
        F.sum("payload_size").alias("payload_bytes"), F.max(F.col("payload_offset") + F.col("payload_size")).alias("index_offset"),
        F.sum("payload_offset").alias("offset_sum"),
    )


def payload_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.coverage(fixtures.payloads(spark), fixtures.index_offsets(spark))


def window_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.contiguity(fixtures.window_sets(spark), fixtures.window_set_sizes(spark))


def window_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.window_audit(fixtures.audit_windows(spark)).select("name", F.coalesce("reason", F.lit("ok")).alias("reason"))


def path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.paths(spark).select("path", paths.path_ok("path").alias("ok"))


def path_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "part").select(F.concat(F.lit("Data/"), F.initcap("p_type"), F.lit(".txt")).alias("path"))
    given = given.unionByName(given.select(F.upper("path").alias("path")))
    return paths.collisions(given).select("collision_key", "n", "first_path")


def common_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(
        "n_regionkey", F.concat_ws("/", F.lit("world"), F.concat(F.lit("r"), F.col("n_regionkey") % 3), F.when(F.col("n_regionkey") % 2 == 0, F.lit("all")).otherwise(F.col("n_name")), "n_name").alias("path")
    )
    return paths.common_base(n, "n_regionkey")


def pair_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.pair_lists_ok(fixtures.pair_lists(spark))


def preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected, installed = installation(pairs(spark, sf_dir))
    return inspect.inspect(expected, installed)


def installation(given: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What patches of eight files expect, and files in the old, the new, another or no state."""
    rows = given.select(
        F.floor(F.col("pair_id") / 8).cast("long").alias("patch_id"), F.col("pair_id").cast("string").alias("path"), "pair_id",
        F.sha2("source", 256).alias("source_digest"), F.sha2("target", 256).alias("target_digest"),
    )
    expected = rows.select("patch_id", "path", "source_digest", "target_digest", (F.col("patch_id") % 3 != 0).alias("has_reverse"))
    how = F.col("patch_id") % 7
    digest = (
        F.when(how == 0, F.col("source_digest"))
        .when(how == 1, F.col("target_digest"))
        .when(how == 2, F.when(F.col("pair_id") % 2 == 0, F.col("source_digest")).otherwise(F.col("target_digest")))
        .when((how == 3) & (F.col("pair_id") % 8 == 1), F.sha2(F.lit("other"), 256))
        .otherwise(F.col("source_digest"))
    )
    there = rows.where(~((how == 4) & (F.col("pair_id") % 8 == 5)))
    regular = ~((how == 5) & (F.col("pair_id") % 8 == 2))
    return expected, there.select("patch_id", "path", regular.alias("regular"), digest.alias("digest"))


def create_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = pairs(spark, sf_dir).select(F.length("source").cast("long").alias("source_size"), F.length("target").cast("long").alias("target_size"))
    return inspect.estimate(sizes, reverse=True)


def fine_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for mode in ("balanced", "apply-speed", "patch-size"):
        plan = verify.plan_fine(fixtures.plan_files(spark), fixtures.plan_windows(spark), mode).withColumn("mode", F.lit(mode))
        out = plan if out is None else out.unionByName(plan)
    return out


def fine_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.cap_fine(fixtures.fine_tables(spark))


def referenced_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, built = _built(spark, sf_dir)
    files = pairs(spark, sf_dir).select(F.col("pair_id").alias("file_id"), F.length("source").cast("long").alias("file_size"))
    rows = built.withColumnRenamed("pair_id", "file_id")
    return verify.referenced(files, rows, 1024)


def chunk_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 of 1 KiB chunks of old texts, against those of the new ones."""
    given = pairs(spark, sf_dir)
    want = verify.chunk_digests(given.select(F.col("pair_id").alias("file_id"), F.col("source").alias("content")), 1024)
    have = verify.chunk_digests(given.select(F.col("pair_id").alias("file_id"), F.col("target").alias("content")), 1024)
    both = want.join(have.select("file_id", "chunk_idx", F.col("digest").alias("other")), ["file_id", "chunk_idx"], "left")
    wrong = F.coalesce(F.col("digest") != F.col("other"), F.lit(True))
    return both.groupBy("file_id").agg(F.count("*").alias("n_chunks"), F.count(F.when(wrong, 1)).alias("n_mismatches"))


def band_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = pairs(spark, sf_dir)
    named = lambda c: verify.chunk_digests(given.select(F.col("pair_id").alias("file_id"), F.col(c).alias("content")), 1024).withColumnRenamed("chunk_idx", "band_index")
    rows = win.windows(given, SMALL).select(F.col("pair_id").alias("file_id"), "window_idx", F.col("span_offset").alias("source_offset"), F.col("span_size").alias("source_size"))
    table_of = named("source").where("band_index % 4 <> 3")
    return verify.verify_windows(rows, table_of, named("target"), 1024).groupBy("file_id", "verdict").agg(F.count("*").alias("n_windows"))


def tree_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = pairs(spark, sf_dir).select(F.col("pair_id").alias("file_id"), F.col("target").alias("content"))
    return verify.tree_digests(given, 1024)


def blake3_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("b"))
    return given.select("doc_id", F.lower(F.hex(verify.blake3_256("b"))).alias("digest"))


def _journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.journal(spark, spark.read.parquet(f"{sf_dir}/orders.parquet"))


def journal_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.audit(_journal(spark, sf_dir))


def journal_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.replay(_journal(spark, sf_dir)).select("journal", "entry", "path", "state", "committed")


def journal_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.recovery(_journal(spark, sf_dir), fixtures.backups(spark.read.parquet(f"{sf_dir}/orders.parquet")))


def journal_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _journal(spark, sf_dir).where("entries IS NOT NULL").select("journal", "seq", F.posexplode("entries").alias("entry", "e"))
    rows = rows.select("journal", "seq", (F.col("entry") + 1).cast("long").alias("entry"), "e.*")
    return rows.select("journal", "seq", "entry", journal.entry_safe("path", "temp", "backup").alias("safe"))


def kind_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extra: bytes by edit and kind, with totals."""
    rows = win.classify(win.windows(pairs(spark, sf_dir), SMALL))
    return rows.rollup("edit", "kind").agg(F.sum("output_size").alias("n_bytes"), F.grouping_id().cast("long").alias("level"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "window_kinds": window_kinds,
    "auto_window_sizes": auto_window_sizes,
    "window_geometry": window_geometry,
    "output_groups": output_groups,
    "clone_eligible": clone_eligible,
    "sparse_runs": sparse_runs,
    "sparse_streams": sparse_streams,
    "choice_balanced": _choice("balanced"),
    "choice_apply_speed": _choice("apply-speed"),
    "choice_patch_size": _choice("patch-size"),
    "chunk_cuts": chunk_cuts,
    "chunk_matches": chunk_matches,
    "window_build": window_build,
    "window_build_zstd": window_build_zstd,
    "apply_forward": apply_forward,
    "apply_chunked": apply_chunked,
    "apply_reverse": apply_reverse,
    "payload_layout": payload_layout,
    "payload_coverage": payload_coverage,
    "window_contiguity": window_contiguity,
    "window_audit": window_audit,
    "path_rules": path_rules,
    "path_collisions": path_collisions,
    "common_base": common_base,
    "pair_lists": pair_lists,
    "preflight": preflight,
    "create_estimate": create_estimate,
    "fine_plans": fine_plans,
    "fine_cap": fine_cap,
    "referenced_bands": referenced_bands,
    "chunk_verification": chunk_verification,
    "band_verification": band_verification,
    "tree_roots": tree_roots,
    "blake3_digests": blake3_digests,
    "journal_audit": journal_audit,
    "journal_states": journal_states,
    "journal_recovery": journal_recovery,
    "journal_safety": journal_safety,
    "kind_rollup": kind_rollup,
}
