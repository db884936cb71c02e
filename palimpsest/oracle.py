"""DuckDB SQL for the engine's queries, written over hex strings of the same texts."""

from __future__ import annotations

from palimpsest.functions.codec import GEAR
from palimpsest.plans import fixtures as fx
from palimpsest.queries import CHUNK_AVERAGE, CHUNK_WINDOW, SMALL

PAIRS = """
base AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
pairs AS (
  SELECT d.doc_id AS pair_id, CAST(d.doc_id % 8 AS INTEGER) AS edit, hex(encode(d.text)) AS s,
    CASE d.doc_id % 8
      WHEN 0 THEN hex(encode(d.text))
      WHEN 1 THEN hex(encode(replace(d.text, 'a', 'b')))
      WHEN 2 THEN hex(encode('INSERTED-' || d.text))
      WHEN 3 THEN hex(encode(coalesce(n.text, (SELECT arg_min(text, doc_id) FROM base))))
      WHEN 4 THEN hex(encode(left(d.text, length(d.text) // 2)))
      WHEN 5 THEN repeat('78', strlen(d.text))
      WHEN 6 THEN repeat('00', strlen(d.text))
      ELSE hex(encode(d.text || d.text)) END AS t
  FROM base d LEFT JOIN base n ON n.doc_id = d.doc_id + 1)
"""


def windows(w: int) -> str:
    return f"""
{PAIRS},
cut AS (
  SELECT pair_id, edit, length(s) // 2 AS m, length(t) // 2 AS n, s, t, i AS window_idx, i * {w} AS off
  FROM (SELECT *, unnest(range(0, (length(t) // 2 + {w - 1}) // {w})) AS i FROM pairs)),
sized AS (SELECT *, least({w}, n - off) AS size FROM cut),
win AS (
  SELECT pair_id, edit, window_idx, off, size, m,
    CASE WHEN greatest(off - {w}, 0) < m THEN greatest(off - {w}, 0) ELSE 0 END AS span_offset,
    greatest(least(m, off + size + {w}) - greatest(off - {w}, 0), 0) AS span_size,
    substr(t, off * 2 + 1, size * 2) AS tw,
    CASE WHEN off + size <= m THEN substr(s, off * 2 + 1, size * 2) END AS sw,
    substr(s, greatest(off - {w}, 0) * 2 + 1, greatest(least(m, off + size + {w}) - greatest(off - {w}, 0), 0) * 2) AS span
  FROM sized),
kinds AS (
  SELECT *, CASE WHEN tw = repeat(left(tw, 2), size) THEN CASE WHEN left(tw, 2) = '00' THEN 'ZERO' ELSE 'RUN' END
                 WHEN sw = tw THEN 'SAME' ELSE 'CHANGED' END AS kind FROM win)
"""


AUTO = """CASE WHEN size < 1048576 THEN 262144 WHEN size <= 16777216 THEN 524288 WHEN size <= 134217728 THEN 1048576
  WHEN size <= 1073741824 THEN 2097152 ELSE 4194304 END"""

RUNS = f"""
{windows(SMALL)},
bytes AS (
  SELECT pair_id, window_idx, off, span_offset, tw, i, substr(tw, 2 * i + 1, 2) = substr(sw, 2 * i + 1, 2) AS same
  FROM (SELECT *, unnest(range(0, size)) AS i FROM kinds WHERE kind = 'CHANGED' AND sw IS NOT NULL)),
runs AS (
  SELECT pair_id, window_idx, any_value(off) AS off, any_value(span_offset) AS base, any_value(tw) AS tw, same, min(i) AS a, count(*) AS n
  FROM (SELECT *, i - row_number() OVER (PARTITION BY pair_id, window_idx, same ORDER BY i) AS g FROM bytes)
  GROUP BY pair_id, window_idx, same, g)
"""

VARINT = lambda v: f"CASE WHEN {v} < 128 THEN 1 WHEN {v} < 16384 THEN 2 ELSE 3 END"

STREAMS = f"""
{RUNS},
near AS (
  SELECT *, lead(n) OVER w AS next_n, lag(same) OVER w AS after_copy FROM runs WINDOW w AS (PARTITION BY pair_id, window_idx ORDER BY a)),
sized_ops AS (
  SELECT *, NOT same AND after_copy IS NOT NULL AND n <= 255 AS paired, same AND next_n <= 255 AS pair FROM near),
streams AS (
  SELECT pair_id, window_idx,
    9 + sum(CASE WHEN paired THEN 0
      WHEN pair THEN 2 + {VARINT('(off + a - base)')} + {VARINT('n')} + next_n
      WHEN same THEN 2
      WHEN n >= 8 AND substr(tw, 2 * a + 1, 2 * n) = repeat(substr(tw, 2 * a + 1, 2), n)
        THEN CASE WHEN substr(tw, 2 * a + 1, 2) = '00' THEN 1 ELSE 2 END + {VARINT('n')}
      WHEN n <= 255 THEN 2 + n ELSE 1 + {VARINT('n')} + n END) AS stream_size,
    sum(CASE WHEN paired THEN 0 ELSE 1 END) AS instructions,
    sum(CASE WHEN same THEN n ELSE 0 END) AS copied
  FROM sized_ops GROUP BY pair_id, window_idx)
"""


def choice(mode: str) -> str:
    extra = {"balanced": "4 * instructions + span_size // 128", "apply-speed": "32 * instructions + span_size // 16", "patch-size": "0"}[mode]
    return f"""WITH {STREAMS},
picked AS (
  SELECT k.size, coalesce(x.copied >= k.size // 8 AND x.stream_size + {extra} < k.size, false) AS delta, x.stream_size
  FROM kinds k LEFT JOIN streams x USING (pair_id, window_idx) WHERE k.kind = 'CHANGED')
SELECT CASE WHEN delta THEN 'DELTA_RAW' ELSE 'REPLACE_RAW' END AS choice, count(*) AS n_windows,
  CAST(sum(CASE WHEN delta THEN stream_size ELSE size END) AS BIGINT) AS payload_bytes, CAST(sum(size) AS BIGINT) AS n_bytes
FROM picked GROUP BY 1"""


_BITS = CHUNK_AVERAGE.bit_length() - 1
_MIN, _MAX = CHUNK_AVERAGE // 4, CHUNK_AVERAGE * 4
_GEAR = ", ".join(f"('{b:02X}', {int(GEAR[b]) % CHUNK_AVERAGE})" for b in range(256))


def chunks(given: str, key: str, data: str) -> str:
    """CTEs that end in ``{given}_chunks(key, c, start, length)``: marks by a sliding sum, cuts by
    recursion."""
    return f"""
{given}_b AS (SELECT {key}, i, g.v FROM (SELECT {key}, {data} AS d, unnest(range(0, length({data}) // 2)) AS i FROM {given}) x
  JOIN gear g ON g.b = substr(x.d, 2 * x.i + 1, 2)),
{given}_m AS (SELECT {key}, i FROM (
    SELECT {key}, i, ({' + '.join(f"coalesce(lag(v, {j}) OVER w, 0) * {1 << j}" for j in range(_BITS))}) % {CHUNK_AVERAGE} AS h
    FROM {given}_b WINDOW w AS (PARTITION BY {key} ORDER BY i)) WHERE h = 0),
{given}_marks AS (SELECT {key}, list(i ORDER BY i) AS marks FROM {given}_m GROUP BY {key}),
{given}_n AS (SELECT {key}, length({data}) // 2 AS n, coalesce(marks, []) AS marks FROM {given} LEFT JOIN {given}_marks USING ({key})),
{given}_chunks AS (
  SELECT {key}, n, marks, 0 AS c, 0 AS start,
    least(n, {_MAX}, coalesce(list_min(list_filter(marks, lambda x: x >= {_MIN - 1})) + 1, n)) AS stop FROM {given}_n WHERE n > 0
  UNION ALL
  SELECT {key}, n, marks, c + 1, stop,
    least(n, stop + {_MAX}, coalesce(list_min(list_filter(marks, lambda x: x >= stop + {_MIN - 1})) + 1, n)) FROM {given}_chunks WHERE stop < n)
"""


CUTS = f"""
WITH RECURSIVE gear(b, v) AS (VALUES {_GEAR}),
{windows(CHUNK_WINDOW)},
tgt AS (SELECT pair_id, window_idx, tw FROM kinds),
{chunks('tgt', 'pair_id, window_idx', 'tw')}
SELECT pair_id, count(*) AS n_chunks, max(stop - start) AS longest, min(stop - start) AS shortest,
  CAST(sum(start * (window_idx + 1)) AS BIGINT) AS offset_sum
FROM tgt_chunks GROUP BY pair_id
"""

MATCHES = f"""
WITH RECURSIVE gear(b, v) AS (VALUES {_GEAR}),
{windows(CHUNK_WINDOW)},
tgt AS (SELECT pair_id, window_idx, tw FROM kinds WHERE kind = 'CHANGED'),
src AS (SELECT pair_id, window_idx, span FROM kinds WHERE kind = 'CHANGED'),
{chunks('tgt', 'pair_id, window_idx', 'tw')},
{chunks('src', 'pair_id, window_idx', 'span')},
places AS (
  SELECT pair_id, window_idx, substr(span, 2 * start + 1, 2 * (stop - start)) AS b, list(start ORDER BY start) AS found_at
  FROM src_chunks JOIN src USING (pair_id, window_idx) GROUP BY 1, 2, 3),
found AS (
  SELECT c.pair_id, c.window_idx, c.c, c.stop - c.start AS n, p.found_at
  FROM tgt_chunks c JOIN tgt t USING (pair_id, window_idx)
  LEFT JOIN places p ON p.pair_id = c.pair_id AND p.window_idx = c.window_idx AND p.b = substr(t.tw, 2 * c.start + 1, 2 * (c.stop - c.start))),
fold AS (
  SELECT pair_id, window_idx, c, n, found_at[1] AS place FROM found WHERE c = 0
  UNION ALL
  SELECT f.pair_id, f.window_idx, f.c, f.n, CASE WHEN list_contains(f.found_at, p.place + p.n) THEN p.place + p.n ELSE f.found_at[1] END
  FROM fold p JOIN found f ON f.pair_id = p.pair_id AND f.window_idx = p.window_idx AND f.c = p.c + 1),
steps AS (
  SELECT *, CASE WHEN lag(n) OVER w IS NULL THEN 1
      WHEN place IS NULL THEN CASE WHEN lag(place) OVER w IS NULL THEN 0 ELSE 1 END
      WHEN lag(place) OVER w + lag(n) OVER w = place THEN 0 ELSE 1 END AS new
  FROM fold WINDOW w AS (PARTITION BY pair_id, window_idx ORDER BY c))
SELECT pair_id, CASE WHEN place IS NULL THEN 'ADD' ELSE 'COPY' END AS op, CAST(sum(new) AS BIGINT) AS n_ops, CAST(sum(n) AS BIGINT) AS n_bytes
FROM steps GROUP BY 1, 2
"""

def _built() -> str:
    """CTEs that end in ``built``: kind and payload of every window, without zstd and chunks."""
    return f"""{STREAMS},
built AS (
  SELECT k.*, CASE WHEN k.kind <> 'CHANGED' THEN k.kind
      WHEN coalesce(x.copied >= k.size // 8 AND x.stream_size + 4 * x.instructions + k.span_size // 128 < k.size, false) THEN 'DELTA_RAW'
      ELSE 'REPLACE_RAW' END AS made, x.stream_size, x.instructions
  FROM kinds k LEFT JOIN streams x USING (pair_id, window_idx)),
paid AS (
  SELECT *, CASE made WHEN 'RUN' THEN 1 WHEN 'DELTA_RAW' THEN stream_size WHEN 'REPLACE_RAW' THEN size ELSE 0 END AS payload FROM built)
"""


def _shas(side: str) -> str:
    return f"""WITH {PAIRS} SELECT pair_id, CAST(length({side}) // 2 AS BIGINT) AS size, sha256(unhex({side})) AS sha256 FROM pairs"""


def _values(rows: list, names: str) -> str:
    return fx.sql_values(rows, names)


AUDIT_NAMES = "name, kind, codec, flags, output_offset, output_size, payload_size, expanded_size, source_offset, source_size, source_first_chunk, source_chunk_count, instruction_count, input_size"
WINDOW_AUDIT = f"""
WITH w AS (SELECT *, kind IN ('DELTA_RAW', 'DELTA_ZSTD') AS is_delta, kind IN ('DELTA_ZSTD', 'REPLACE_ZSTD') AS is_zstd,
    kind IN ('SAME', 'COPY') AS is_copy FROM {_values(fx.audit_rows(), AUDIT_NAMES)}),
rules AS (
  SELECT name, unnest([
    CASE WHEN flags <> 0 THEN 'flags' END,
    CASE WHEN NOT is_delta AND NOT is_zstd AND NOT is_copy AND kind NOT IN ('REPLACE_RAW', 'ZERO', 'RUN') THEN 'kind' END,
    CASE WHEN (codec = 'zstd') <> is_zstd THEN 'codec' END,
    CASE WHEN is_copy AND payload_size + expanded_size > 0 THEN 'payload' END,
    CASE WHEN is_copy AND source_size <> output_size THEN 'source size' END,
    CASE WHEN kind = 'SAME' AND source_offset <> output_offset THEN 'source offset' END,
    CASE WHEN is_delta AND payload_size * expanded_size = 0 THEN 'payload' END,
    CASE WHEN kind = 'DELTA_RAW' AND expanded_size <> payload_size THEN 'payload' END,
    CASE WHEN is_delta AND expanded_size > 2 * output_size + 1048576 THEN 'stream bound' END,
    CASE WHEN is_zstd AND payload_size > expanded_size + expanded_size // 128 + 4096 THEN 'zstd bound' END,
    CASE WHEN is_delta AND source_size = 0 THEN 'source size' END,
    CASE WHEN payload_size <> CASE kind WHEN 'REPLACE_RAW' THEN output_size WHEN 'ZERO' THEN 0 WHEN 'RUN' THEN 1
                              WHEN 'REPLACE_ZSTD' THEN greatest(payload_size, 1) ELSE payload_size END THEN 'payload' END,
    CASE WHEN NOT is_delta AND NOT is_copy AND expanded_size <> output_size THEN 'expanded size' END,
    CASE WHEN is_delta <> (instruction_count > 0) THEN 'instructions' END,
    CASE WHEN NOT is_delta AND NOT is_copy AND source_offset + source_size + source_first_chunk + source_chunk_count > 0 THEN 'source of none' END,
    CASE WHEN source_offset + source_size > input_size THEN 'source range' END,
    CASE WHEN source_size > 0 AND (source_first_chunk <> source_offset // 8388608
      OR source_chunk_count <> (source_offset + source_size + 8388607) // 8388608 - source_offset // 8388608) THEN 'source chunks' END]) AS reason,
    unnest(range(0, 17)) AS rule FROM w)
SELECT name, coalesce(arg_min(reason, rule) FILTER (WHERE reason IS NOT NULL), 'ok') AS reason FROM rules GROUP BY name
"""


def _fine(mode: str, bands: tuple[int, ...], penalty: int) -> str:
    def touched(band: int) -> str:
        return f"""SELECT file_id, count(*) AS n, sum(greatest(least({band}, file_size - b * {band}), 0)) AS bytes FROM (
          SELECT DISTINCT w.file_id, f.file_size, unnest(range(w.source_offset // {band}, (w.source_offset + w.source_size - 1) // {band} + 1)) AS b
          FROM deltas w JOIN files f USING (file_id)) GROUP BY file_id"""

    each = " UNION ALL ".join(f"SELECT *, {band} AS band, {i} AS o FROM ({touched(band)})" for i, band in enumerate(bands))
    return f"""
  SELECT file_id, band AS band_size, n AS n_bands, CAST(bytes AS BIGINT) AS fine_bytes, CAST(canonical AS BIGINT) AS canonical_bytes, '{mode}' AS mode
  FROM (SELECT x.*, c.bytes AS canonical, row_number() OVER (PARTITION BY x.file_id ORDER BY x.bytes + x.n * 40 * {penalty}, x.o) AS r
        FROM ({each}) x JOIN ({touched(8 << 20)}) c USING (file_id)
        WHERE x.n <= 419430 AND x.bytes + x.n * 40 * {penalty} < c.bytes AND c.bytes - x.bytes >= 262144 AND c.bytes - x.bytes >= x.n * 80)
  WHERE r = 1"""


FINE_PLANS = f"""
WITH files AS (SELECT * FROM {_values(fx.PLAN_FILES, 'file_id, file_size')}),
deltas AS (SELECT * FROM {_values(fx.PLAN_WINDOWS, 'file_id, kind, source_offset, source_size')} WHERE kind LIKE 'DELTA%')
{_fine('balanced', (256 << 10, 1 << 20), 4)} UNION ALL {_fine('apply-speed', (64 << 10, 256 << 10, 1 << 20), 1)}
UNION ALL {_fine('patch-size', (1 << 20,), 16)}
"""

FINE_CAP = f"""
WITH RECURSIVE t AS (SELECT * FROM {_values(fx.FINE_TABLES, 'patch_id, file_idx, n_bands')}),
fold AS (
  SELECT patch_id, file_idx, n_bands, n_bands <= 524288 AS kept, CASE WHEN n_bands <= 524288 THEN n_bands ELSE 0 END AS total FROM t WHERE file_idx = 0
  UNION ALL
  SELECT t.patch_id, t.file_idx, t.n_bands, f.total + t.n_bands <= 524288, f.total + CASE WHEN f.total + t.n_bands <= 524288 THEN t.n_bands ELSE 0 END
  FROM fold f JOIN t ON t.patch_id = f.patch_id AND t.file_idx = f.file_idx + 1)
SELECT patch_id, CAST(file_idx AS INTEGER) AS file_idx, n_bands, kept FROM fold
"""

#: The fold of journals, one record after the other: ``st`` has the state of each entry, ``ver`` the
#: version of the last snapshot, ``bad`` the first record that may not follow.
JOURNAL = f"""
WITH RECURSIVE r AS ({fx.JOURNAL_RECORDS.replace("{seqs}", "(SELECT o_orderkey, unnest(range(8)) AS seq FROM orders)")}),
q AS (SELECT *, row_number() OVER (PARTITION BY journal ORDER BY seq) AS i FROM r),
fold AS (
  SELECT DISTINCT journal, CAST(0 AS BIGINT) AS i, 0 AS ver, CAST([] AS VARCHAR[]) AS st, false AS done, CAST(NULL AS BIGINT) AS bad FROM r
  UNION ALL
  SELECT journal, i, CASE WHEN op = 'S' THEN version ELSE ver END,
    CASE WHEN op = 'S' THEN list_transform(range(n_entries), lambda x: entry_state)
      WHEN op = 'E' THEN list_concat(list_concat(st[1:entry - 1], [state]), st[entry + 1:]) ELSE st END,
    CASE WHEN op = 'S' THEN state = 'committed' WHEN op = 'C' THEN true ELSE done END,
    CASE WHEN op = 'X' THEN seq END
  FROM (SELECT f.journal, q.i, q.version, q.state, q.entry, q.n_entries, q.entry_state, q.seq, f.ver, f.st, f.done,
      CASE WHEN q.n_entries > 0 AND q.entry = 0 AND (q.version = 1 AND q.kind = '' OR q.version = 2 AND q.kind = 'snapshot') THEN 'S'
        WHEN q.version <> 2 OR f.ver <> 2 OR q.n_entries > 0 THEN 'X'
        WHEN q.kind = 'entry' AND q.entry >= 1 AND q.entry <= len(f.st) AND (f.st[q.entry] || '>' || q.state) IN ('prepared>backed-up', 'backed-up>replaced') THEN 'E'
        WHEN q.kind = 'commit' AND q.entry = 0 AND q.state = '' AND len(list_filter(f.st, lambda x: x <> 'replaced')) = 0 THEN 'C'
        ELSE 'X' END AS op
    FROM fold f JOIN q ON q.journal = f.journal AND q.i = f.i + 1 WHERE f.bad IS NULL)),
ended AS (SELECT journal, max(bad) AS bad, arg_max(st, i) AS st, arg_max(done, i) AS done FROM fold GROUP BY journal),
replayed AS (SELECT journal, unnest(range(1, len(st) + 1)) AS entry, unnest(st) AS state, done AS committed, len(st) AS n FROM ended WHERE bad IS NULL)
"""

PREFLIGHT = f"""
WITH {PAIRS},
x AS (SELECT pair_id, pair_id // 8 AS patch_id, sha256(unhex(s)) AS sd, sha256(unhex(t)) AS td, (pair_id // 8) % 7 AS how, pair_id % 8 AS k FROM pairs),
y AS (SELECT *, how = 4 AND k = 5 AS missing, how = 5 AND k = 2 AS irregular,
    CASE WHEN how = 1 THEN td WHEN how = 2 AND pair_id % 2 = 1 THEN td WHEN how = 3 AND k = 1 THEN sha256('other') ELSE sd END AS d FROM x),
z AS (SELECT *, NOT missing AND NOT irregular AND d = sd AS s1, NOT missing AND NOT irregular AND d = td AS t1 FROM y),
g AS (SELECT patch_id, count(*) FILTER (WHERE missing) AS n_missing, count(*) FILTER (WHERE NOT missing AND NOT s1 AND NOT t1) AS n_issues,
    bool_and(s1) AS a, bool_and(t1) AND patch_id % 3 <> 0 AS b, bool_or(s1) AND bool_or(t1) AS mixed FROM z GROUP BY patch_id)
SELECT patch_id, CASE WHEN n_missing > 0 THEN 'missing-files' WHEN a AND b THEN 'bidirectional-ready' WHEN a THEN 'forward-ready'
    WHEN b THEN 'reverse-ready' WHEN mixed AND n_issues = 0 THEN 'mixed-files' ELSE 'invalid-files' END AS state,
  a AS can_forward, b AS can_reverse, n_missing, n_issues FROM g
"""


def _digests(side: str, name: str) -> str:
    return f"""{name} AS (SELECT pair_id AS file_id, c AS chunk_idx, sha256(unhex(substr({side}, c * 2048 + 1, 2048))) AS d
  FROM (SELECT *, unnest(range(0, (length({side}) // 2 + 1023) // 1024)) AS c FROM pairs))"""


ORACLE_SQL: dict[str, str] = {
    "window_kinds": f"WITH {windows(SMALL)} SELECT edit, kind, count(*) AS n_windows, CAST(sum(size) AS BIGINT) AS n_bytes FROM kinds GROUP BY 1, 2",
    "auto_window_sizes": f"""
SELECT CAST({AUTO} AS BIGINT) AS window_size, count(*) AS n_files, max(size) AS largest
FROM (SELECT o_orderkey * o_orderkey * 37 AS size FROM orders) GROUP BY 1""",
    "window_geometry": f"""
WITH {windows(SMALL)}
SELECT edit, count(*) AS n_windows, CAST(sum(span_size) AS BIGINT) AS span_bytes, CAST(sum(span_offset) AS BIGINT) AS span_offsets,
  CAST(sum(CASE WHEN span_size = 0 THEN 0 ELSE (span_offset + span_size + 8388607) // 8388608 - span_offset // 8388608 END) AS BIGINT) AS n_chunks,
  CAST(max(CASE WHEN span_size = 0 THEN 0 ELSE span_offset // 8388608 END) AS BIGINT) AS last_chunk,
  count(DISTINCT (pair_id, off // 8388608)) AS n_groups, count(sw) AS n_sparse_eligible
FROM kinds GROUP BY edit""",
    "output_groups": f"""
SELECT off // 8388608 AS output_group, count(*) AS n_windows, CAST(sum(least(w, size - off)) AS BIGINT) AS n_bytes
FROM (SELECT size, w, unnest(range(0, size, w)) AS off FROM (
  SELECT size, {AUTO} AS w FROM (SELECT o_orderkey * 4099 AS size FROM orders WHERE o_orderkey > 0))) GROUP BY 1""",
    "clone_eligible": f"""
WITH {windows(SMALL)},
g AS (SELECT pair_id, max(m) AS source_size, sum(size) AS target_size, sum(CASE WHEN kind = 'SAME' THEN size ELSE 0 END) AS same_bytes FROM kinds GROUP BY 1)
SELECT pair_id, source_size, CAST(target_size AS BIGINT) AS target_size, CAST(same_bytes AS BIGINT) AS same_bytes,
  source_size = target_size AND target_size >= 1024 AND same_bytes * 100 >= target_size * 90 AS clone FROM g""",
    "sparse_runs": f"""WITH {RUNS}
SELECT pair_id, CASE WHEN same THEN 'COPY' ELSE 'ADD' END AS op, count(*) AS n_ops, CAST(sum(n) AS BIGINT) AS n_bytes, max(n) AS longest
FROM runs GROUP BY 1, 2""",
    "sparse_streams": f"""WITH {STREAMS}
SELECT pair_id, window_idx, CAST(stream_size AS BIGINT) AS stream_size, CAST(instructions AS BIGINT) AS instructions, CAST(copied AS BIGINT) AS copied
FROM streams""",
    "choice_balanced": choice("balanced"),
    "choice_apply_speed": choice("apply-speed"),
    "choice_patch_size": choice("patch-size"),
    "chunk_cuts": CUTS,
    "chunk_matches": MATCHES,
    "window_build": f"""WITH {_built()}
SELECT edit, made AS kind, count(*) AS n_windows, CAST(sum(payload) AS BIGINT) AS payload_bytes, CAST(sum(size) AS BIGINT) AS n_bytes,
  CAST(sum(CASE WHEN made = 'DELTA_RAW' THEN instructions ELSE 0 END) AS BIGINT) AS instructions FROM paid GROUP BY 1, 2""",
    "apply_forward": _shas("t"),
    "apply_chunked": _shas("t"),
    "apply_reverse": _shas("s"),
    "payload_layout": f"""WITH {_built()},
placed AS (SELECT pair_id // 64 AS patch_id, payload,
    CASE WHEN payload > 0 THEN 16 + coalesce(sum(payload) OVER (PARTITION BY pair_id // 64 ORDER BY pair_id, window_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE 0 END AS placed_at FROM paid)
SELECT patch_id, CAST(sum(payload) AS BIGINT) AS payload_bytes, CAST(max(placed_at + payload) AS BIGINT) AS index_offset, CAST(sum(placed_at) AS BIGINT) AS offset_sum
FROM placed GROUP BY 1""",
    "payload_coverage": f"""
WITH p AS (SELECT * FROM {_values(fx.PAYLOADS, 'patch_id, a, n')} WHERE n > 0), i AS (SELECT * FROM {_values(fx.INDEX_OFFSETS, 'patch_id, stop')}),
g AS (SELECT patch_id, bool_and(a = want) AS good, max(a + n) AS last
  FROM (SELECT *, coalesce(lag(a + n) OVER (PARTITION BY patch_id ORDER BY a, n), 16) AS want FROM p) GROUP BY 1)
SELECT patch_id, CASE WHEN good IS NULL THEN stop = 16 ELSE good AND last = stop END AS ok FROM i LEFT JOIN g USING (patch_id)""",
    "window_contiguity": f"""
WITH w AS (SELECT * FROM {_values(fx.WINDOW_SETS, 'set_id, i, a, n')}), s AS (SELECT * FROM {_values(fx.WINDOW_SET_SIZES, 'set_id, total, size')}),
g AS (SELECT set_id, bool_and(a = want AND n > 0 AND n <= size) AS good, sum(n) AS n
  FROM (SELECT w.*, s.size, coalesce(lag(a + n) OVER (PARTITION BY set_id ORDER BY i), 0) AS want FROM w JOIN s USING (set_id)) GROUP BY 1)
SELECT set_id, CASE WHEN good IS NULL THEN total = 0 ELSE good AND n = total END AS ok FROM s LEFT JOIN g USING (set_id)""",
    "window_audit": WINDOW_AUDIT,
    "path_rules": f"""
SELECT path, path <> '' AND left(path, 1) <> '/' AND strpos(path, '\\') = 0
  AND len(list_filter(string_split(path, '/'), lambda c: c = '' OR right(c, 1) IN (' ', '.') OR strpos(c, ':') > 0)) = 0 AS ok
FROM {_values([(p,) for p in fx.PATHS], 'path')}""",
    "path_collisions": """
WITH p AS (SELECT 'Data/' || array_to_string(list_transform(string_split(p_type, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') || '.txt' AS path FROM part),
twice AS (SELECT path FROM p UNION ALL SELECT upper(path) FROM p)
SELECT lower(path) AS collision_key, count(*) AS n, min(path) AS first_path FROM twice GROUP BY 1 HAVING count(*) > 1""",
    "common_base": """
WITH n AS (SELECT n_regionkey, 'world/r' || (n_regionkey % 3) || '/' || CASE WHEN n_regionkey % 2 = 0 THEN 'all' ELSE n_name END AS folder, n_name FROM nation)
SELECT n_regionkey, CASE WHEN count(DISTINCT folder) = 1 THEN min(folder) ELSE 'world/r' || (n_regionkey % 3) END AS base FROM n GROUP BY n_regionkey""",
    # DuckDB takes a comma before a closing bracket, which JSON does not have.
    "pair_lists": f"""
WITH t AS (SELECT list_id, CASE WHEN json_valid(text) AND NOT regexp_matches(text, ',[ ]*[]}}]') THEN CAST(text AS JSON) END AS j FROM {_values(fx.PAIR_LISTS, 'list_id, text')}),
x AS (SELECT list_id, CASE WHEN json_type(j) = 'ARRAY' THEN CAST(j AS JSON[]) ELSE [] END AS items FROM t),
y AS (SELECT list_id, len(items) AS n, len(list_filter(items, lambda r: json_type(r) = 'OBJECT' AND len(json_keys(r)) = 2
    AND json_type(r, '$.source') = 'VARCHAR' AND json_type(r, '$.target') = 'VARCHAR' AND trim(coalesce(r->>'source', '')) <> '' AND trim(coalesce(r->>'target', '')) <> '')) AS good FROM x)
SELECT list_id, CAST(CASE WHEN n > 0 AND good = n THEN n ELSE 0 END AS BIGINT) AS n, n > 0 AND good = n AS ok FROM y""",
    "preflight": PREFLIGHT,
    "create_estimate": f"""
WITH {PAIRS}, x AS (SELECT sum(length(s) // 2) AS s, sum(length(t) // 2) AS t FROM pairs)
SELECT CAST(s + t AS BIGINT) AS work_bytes, CAST(t + t // 4 + 67108864 + s + s // 4 AS BIGINT) AS output_bytes,
  CAST(s + t + t + t // 4 + 67108864 + s + s // 4 AS BIGINT) AS total_bytes FROM x""",
    "fine_plans": FINE_PLANS,
    "fine_cap": FINE_CAP,
    "referenced_bands": f"""WITH {_built()}
SELECT file_id, count(*) AS n_bands, CAST(sum(greatest(least(1024, m - b * 1024), 0)) AS BIGINT) AS n_bytes FROM (
  SELECT DISTINCT pair_id AS file_id, m, unnest(range(span_offset // 1024, (span_offset + span_size - 1) // 1024 + 1)) AS b
  FROM built WHERE made = 'DELTA_RAW') GROUP BY 1""",
    "chunk_verification": f"""
WITH {PAIRS}, {_digests('s', 'want')}, {_digests('t', 'have')}
SELECT w.file_id, count(*) AS n_chunks, count(*) FILTER (WHERE h.d IS NULL OR h.d <> w.d) AS n_mismatches
FROM want w LEFT JOIN have h USING (file_id, chunk_idx) GROUP BY 1""",
    "band_verification": f"""
WITH {windows(SMALL)}, {_digests('s', 'want')}, {_digests('t', 'have')},
refs AS (SELECT pair_id AS file_id, window_idx, unnest(range(span_offset // 1024, (span_offset + span_size - 1) // 1024 + 1)) AS chunk_idx FROM kinds WHERE span_size > 0),
seen AS (SELECT r.file_id, r.window_idx, w.d IS NOT NULL AS listed, w.d IS NOT NULL AND (h.d IS NULL OR h.d <> w.d) AS wrong
  FROM refs r LEFT JOIN (SELECT * FROM want WHERE chunk_idx % 4 <> 3) w USING (file_id, chunk_idx) LEFT JOIN have h USING (file_id, chunk_idx)),
v AS (SELECT file_id, window_idx, CASE WHEN bool_or(wrong) THEN 'mismatch' WHEN bool_and(listed) THEN 'verified' ELSE 'fallback' END AS verdict FROM seen GROUP BY 1, 2)
SELECT file_id, verdict, count(*) AS n_windows FROM v GROUP BY 1, 2""",
    "tree_roots": f"""
WITH {PAIRS}, {_digests('t', 'c')},
g AS (SELECT file_id, count(*) AS n, string_agg(d, ',' ORDER BY chunk_idx) AS ds FROM c GROUP BY 1)
SELECT p.pair_id AS file_id, CAST(length(p.t) // 2 AS BIGINT) AS size, coalesce(g.n, 0) AS n_chunks,
  sha256('PLMP-SHA256-TREE-V1|' || (length(p.t) // 2) || '|1024|' || coalesce(g.n, 0) || '|' || coalesce(g.ds, '')) AS root
FROM pairs p LEFT JOIN g ON g.file_id = p.pair_id""",
    "journal_audit": f"{JOURNAL} SELECT CAST(journal AS VARCHAR) AS journal, bad IS NULL AS valid, CAST(bad AS INTEGER) AS error_seq FROM ended",
    "journal_states": f"{JOURNAL} SELECT CAST(journal AS VARCHAR) AS journal, entry, 'd' || entry || '/f' AS path, state, committed FROM replayed",
    "journal_recovery": f"""{JOURNAL}
SELECT CAST(journal AS VARCHAR) AS journal, entry, 'd' || entry || '/f' AS path,
  CASE WHEN committed THEN 'remove-backup' WHEN (journal + entry) % 4 <> 0 THEN 'restore-backup' ELSE 'remove-temp' END AS action,
  CAST(n - entry AS BIGINT) AS turn FROM replayed""",
    "journal_safety": f"""{JOURNAL}
SELECT CAST(journal AS VARCHAR) AS journal, CAST(seq AS INTEGER) AS seq, entry, NOT (journal % 5 = 0 AND entry = 2) AS safe
FROM (SELECT journal, seq, unnest(range(1, n_entries + 1)) AS entry FROM r)""",
}
