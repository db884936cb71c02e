"""Small fixed tables for rules that no document shows, as rows and as SQL values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIB = 1 << 20

_AUDIT = "name string, kind string, codec string, flags int, output_offset long, output_size long, payload_size long, expanded_size long, source_offset long, source_size long, source_first_chunk long, source_chunk_count int, instruction_count int, input_size long"
_FIELDS = ("kind", "codec", "flags", "output_offset", "output_size", "payload_size", "expanded_size", "source_offset", "source_size", "source_first_chunk", "source_chunk_count", "instruction_count", "input_size")
_KINDS = ("SAME", "COPY", "DELTA_RAW", "DELTA_ZSTD", "REPLACE_RAW", "REPLACE_ZSTD", "ZERO", "RUN")


def _descriptor(kind: str, turn: int) -> dict:
    """A descriptor of this kind that breaks no rule; ``turn`` varies its place and sizes."""
    chunk = 8 * MIB
    size, place = 300 + 77 * turn, 5000 * turn * turn
    moves, delta, packed = kind in ("SAME", "COPY"), kind.startswith("DELTA"), kind.endswith("ZSTD")
    span = size if moves else 3 * size if delta else 0
    at = place if kind == "SAME" else turn * chunk - turn * 40 if moves or delta else 0
    grown = 0 if moves else 60 + turn if delta else size
    paid = {"REPLACE_RAW": size, "RUN": 1}.get(kind, grown - 20 if packed else grown if delta else 0)
    first = at // chunk
    count = -(-(at + span) // chunk) - first if span else 0
    values = (kind, "zstd" if packed else "none", 0, place, size, paid, grown, at, span, first, count, 3 + turn if delta else 0, at + span + place + 9)
    return dict(zip(_FIELDS, values, strict=True))


def audit_rows() -> list[tuple]:
    """Every kind in three forms without fault, and each with each of its fields changed: to
    nothing, by one either way, doubled, beyond any bound; and to every other kind and codec."""
    rows = []
    for kind in _KINDS:
        for turn in range(3):
            good = _descriptor(kind, turn)
            rows.append((f"{kind} {turn}", *good.values()))
            changed = [("kind", x) for x in (*_KINDS, "MOVE", "")] + [("codec", x) for x in ("none", "zstd")]
            changed += [(f, x) for f in _FIELDS[2:] for x in (0, good[f] - 1, good[f] + 1, 2 * good[f], 1 << 28)]
            seen = {(f, good[f]) for f in _FIELDS}
            for field, x in changed:
                if (field, x) not in seen and (isinstance(x, str) or x >= 0):
                    seen.add((field, x))
                    rows.append((f"{kind} {turn}, {field} {x}", *(good | {field: x}).values()))
    return rows


#: (set, index, offset, size) and (set, total, window size).
WINDOW_SETS = [
    ("good", 0, 0, 10), ("good", 1, 10, 10), ("good", 2, 20, 5), ("late", 0, 1, 9), ("gap", 0, 0, 10), ("gap", 1, 11, 9),
    ("overlap", 0, 0, 10), ("overlap", 1, 9, 10), ("zero_size", 0, 0, 0), ("zero_size", 1, 0, 10), ("large", 0, 0, 20),
    ("short", 0, 0, 10), ("of_empty", 0, 0, 1),
]
WINDOW_SET_SIZES = [
    ("good", 25, 10), ("late", 10, 10), ("gap", 20, 10), ("overlap", 19, 10), ("zero_size", 10, 10), ("large", 20, 10),
    ("short", 12, 10), ("of_empty", 0, 10), ("empty", 0, 10), ("missing", 5, 10),
]
PAYLOADS = [
    ("good", 16, 4), ("good", 20, 6), ("good", 0, 0), ("gap", 17, 4), ("overlap", 16, 4), ("overlap", 19, 4), ("trailing", 16, 4), ("past", 16, 9),
]
INDEX_OFFSETS = [("good", 26), ("gap", 21), ("overlap", 23), ("trailing", 21), ("past", 24), ("none", 16), ("none_but_bytes", 17)]
PATHS = [
    "bin/game.exe", "a", "a/b/c.txt", "", "/abs", "a//b", "a/", "./a", "a/../b", "..", ".", "a\\b", "a:b", "dir /x", "dir./x", "x.", "x ",
    "é/ü.txt", "a/.hidden", "...", "a/.../b", "CON:1",
]
def _pair_lists() -> list[tuple[int, str]]:
    """Lists from a small grammar: every value form on either side, keys missing or too many, and
    what may stand around a list."""
    values = ['"x/y"', '" "', '""', "7", "null", '["x"]', '{"x":"y"}', "true", '"ü]"']
    objects = [f'{{"source":{a},"target":{b}}}' for a in values for b in values]
    objects += ['{"source":"p"}', '{"target":"p"}', "{}", '{"source":"p","target":"q","more":1}', '{"source":"p","goal":"q"}', '"p"', "5", "null", "[]"]
    good = '{"target":"q","source":"p"}'
    lists = [f"[{x}]" for x in objects] + [f"[{good}, {x}]" for x in objects] + [f"[{x},{good}]" for x in objects[::7]]
    around = ["{}", " {} ", "{} []", "{} x", "{}]", "{}] [", "{}, {}", "[{}]", "{},", "x{}", '{}"', '{},"v":1}}', "{}{}"]
    lists += [w.replace("{}", f"[{good}]") for w in around] + ["[]", "", " ", "nonsense", good, f"[{good},]", f"[{good}", '"a"', "[[]]"]
    return list(enumerate(lists))


PAIR_LISTS = _pair_lists()
def _plans() -> tuple[list[tuple], list[tuple]]:
    """(file, size) and (file, kind, source offset, source size): files of many sizes, each with up
    to eleven ranges at a step of its own, some of them twice or over each other."""
    files, ranges = [], []
    for f in range(60):
        size = (f * 37 % 101) * MIB + f * 1021 * (f % 3)
        files.append((f, size))
        step = ((1 << 16) + 11, 700_001, 5 * MIB, 9 * MIB + 1, 20 * MIB)[f % 5]
        for j in range(f % 12):
            at, n = j * step % max(size, 1), (1 + j * f % 7) * ((1 << 14) + 3) << (f % 4)
            if size:
                ranges.append((f, ("DELTA_RAW", "DELTA_ZSTD", "COPY", "SAME")[(f + j * j) % 4], at, min(n, size - at)))
    return files, ranges


PLAN_FILES, PLAN_WINDOWS = _plans()
FINE_TABLES = [("p", 0, (1 << 19) - 1), ("p", 1, 2), ("p", 2, 1), ("q", 0, 5), ("q", 1, 1 << 19), ("q", 2, 7), ("r", 0, 1 << 20)]
#: Journals of one commit for each order: ``n`` entries that are backed up and replaced one after
#: the other and then committed, cut off anywhere, most with one record that breaks a rule.  The
#: entries of a snapshot follow from ``n_entries`` and ``entry_state``.  For Spark and DuckDB alike;
#: ``{seqs}`` makes a row for each of 0 to 7.
JOURNAL_RECORDS = """
SELECT j AS journal, seq,
  CASE WHEN seq = 0 AND m IN (8, 9) THEN 1 WHEN seq = 1 AND m = 6 THEN 9 ELSE 2 END AS version,
  CASE WHEN seq = 0 AND m = 9 THEN '' WHEN seq = 0 OR (seq = 2 AND m = 11) THEN 'snapshot' WHEN seq = 3 AND m = 10 THEN 'rename'
    WHEN seq = 2 * n + 1 OR (seq = 2 AND m = 5) THEN 'commit' ELSE 'entry' END AS kind,
  CASE WHEN seq = 0 THEN 'prepared' WHEN seq = 2 * n + 1 OR (seq = 2 AND m IN (5, 11)) THEN '' WHEN seq = 2 AND m = 4 THEN 'unknown'
    WHEN seq % 2 = 1 AND NOT (seq = 1 AND m = 1) THEN 'backed-up' ELSE 'replaced' END AS state,
  CASE WHEN seq = 0 AND m = 7 THEN 5 WHEN seq = 3 AND m = 3 THEN n + 1 WHEN seq = 0 OR seq = 2 * n + 1 OR (seq = 2 AND m IN (2, 5, 11)) THEN 0
    ELSE CAST(floor((seq + 1) / 2.0) AS BIGINT) END AS entry,
  CASE WHEN seq = 0 OR (seq = 2 AND m = 11) THEN n ELSE 0 END AS n_entries,
  CASE WHEN seq = 0 AND m <> 9 THEN 'prepared' WHEN j % 2 = 0 THEN 'replaced' ELSE 'backed-up' END AS entry_state
FROM (SELECT o_orderkey AS j, 1 + o_orderkey % 3 AS n, o_orderkey % 13 AS m, seq FROM {seqs}) x
WHERE seq <= 2 * n + 1 AND seq <= j % 11 AND NOT (seq = 0 AND m = 12)
"""


def journal(spark: SparkSession, orders: DataFrame) -> DataFrame:
    """``JOURNAL_RECORDS`` with the entries of snapshots."""
    numbered = orders.select("o_orderkey", F.explode(F.expr("sequence(0L, 7L)")).alias("seq"))
    flat = spark.sql(JOURNAL_RECORDS.replace("{seqs}", "{numbered}"), numbered=numbered)
    entries = F.expr("""
        CASE WHEN n_entries > 0 THEN transform(sequence(1, n_entries), k -> named_struct(
          'path', concat('d', k, '/f'), 'temp', concat('d', k, '/.tmp-', k),
          'backup', concat(CASE WHEN journal % 5 = 0 AND k = 2 THEN 'x' ELSE concat('d', k) END, '/.bak-', k), 'state', entry_state)) END""")
    return flat.select(F.col("journal").cast("string").alias("journal"), F.col("seq").cast("int").alias("seq"), F.col("version").cast("int").alias("version"), "kind", "state", F.col("entry").cast("long").alias("entry"), entries.alias("entries"))


def backups(orders: DataFrame) -> DataFrame:
    """``journal, path`` of the backups that exist."""
    of = orders.select(F.col("o_orderkey").alias("j"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k")).where("(j + k) % 4 <> 0")
    name = F.expr("concat(CASE WHEN j % 5 = 0 AND k = 2 THEN 'x' ELSE concat('d', k) END, '/.bak-', k)")
    return of.select(F.col("j").cast("string").alias("journal"), name.alias("path"))


def audit_windows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(audit_rows(), _AUDIT)


def window_sets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(WINDOW_SETS, "set_id string, window_idx int, output_offset long, output_size long")


def window_set_sizes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(WINDOW_SET_SIZES, "set_id string, output_size long, window_size long")


def payloads(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PAYLOADS, "patch_id string, payload_offset long, payload_size long")


def index_offsets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(INDEX_OFFSETS, "patch_id string, index_offset long")


def paths(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p,) for p in PATHS], "path string")


def pair_lists(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PAIR_LISTS, "list_id long, text string")


def plan_files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PLAN_FILES, "file_id long, file_size long")


def plan_windows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PLAN_WINDOWS, "file_id long, kind string, source_offset long, source_size long")


def fine_tables(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FINE_TABLES, "patch_id string, file_idx int, n_bands long")


def sql_values(rows: list[tuple], names: str) -> str:
    """Rows as a SQL table expression."""
    def literal(x: object) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).lower()
        if isinstance(x, int):
            return f"CAST({x} AS BIGINT)"
        return "'" + str(x).replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") v({names})"
