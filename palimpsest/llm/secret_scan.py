"""Secret scans with DataFrame operations only: patterns, then character Markov models.

Three patterns find assignments, access keys and long hexadecimal strings.  Two first-order
Markov models over characters, one of random strings and one of ordinary identifiers, then
judge every other long token: it is a secret if its log-likelihood ratio exceeds a threshold.

The models are trained from labelled samples: the values that the patterns found are samples
of random strings (label 1), identifiers of documents without any such value are samples of
ordinary ones (label 0).  Identifiers come from a bounded sample of documents, those with the
least hash of doc_id (``training_documents``); random strings come from all documents.
Their pair counts, at most 2 x 65 x 65 numbers, are all that reaches the driver.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, split, stash

ASSIGN = (
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
TOKEN = r"[A-Za-z0-9+/_-]{16,}"
KINDS = ("assign", "access", "hex", "random")
#: Identifiers as they occur in ordinary text and code.
IDENTIFIER = r"(?<![A-Za-z0-9+/_-])[A-Za-z][A-Za-z_]{7,}(?![A-Za-z0-9+/_-])"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
SMOOTHING = 20.0
#: Log odds that a token must reach; about one random string among a million tokens.
THRESHOLD = math.log(1e6)
TRAINING_DOCUMENTS = 20_000


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _found(kind: int, quick: str, pattern: str, group: int, ok: str) -> str:
    """SQL of an array with all matches of one kind: the gap before each, its length, the
    value and whether it counts."""
    p = _sql(pattern)
    return f"""
      CASE WHEN text RLIKE {_sql(quick)} THEN
        transform(arrays_zip(regexp_extract_all(text, {p}, 0), regexp_extract_all(text, {p}, {group}),
                             transform(split(text, {p}, -1), x -> length(x))),
          (x, i) -> named_struct('kind', {kind}, 'i', i, 'gap', x.`2`, 'n', coalesce(length(x.`0`), 0), 'value', x.`1`,
                                 'ok', coalesce({ok}, false)))
      END"""


def matches(docs: DataFrame) -> DataFrame:
    """``doc_id, kind int, start int, end int, value``: pattern matches (kinds 0 to 2) and all
    long tokens (kind 3), in code points, of the whole texts."""
    arrays = [
        _found(0, r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", ASSIGN, 2, "length(x.`1`) >= 12"),
        _found(1, r"AKIA[A-Z0-9]{14}", ACCESS, 0, "length(x.`0`) >= 18"),
        _found(2, HEX, HEX, 0, "x.`0` IS NOT NULL"),
        _found(3, TOKEN, TOKEN, 0, "x.`0` IS NOT NULL"),
    ]
    each = docs.select(
        "doc_id", F.explode(F.expr("concat(" + ", ".join(f"coalesce({a}, array())" for a in arrays) + ")")).alias("x")
    ).select("doc_id", "x.*")
    before = Window.partitionBy("doc_id", "kind").orderBy("i")
    start = F.sum(F.col("gap") + F.col("n")).over(before) - F.col("n")
    return (
        each.withColumn("start", start.cast("int"))
        .where("ok")
        .select("doc_id", "kind", "start", (F.col("start") + F.col("n")).cast("int").alias("end"), "value")
    )


def _codes(value: str) -> str:
    """SQL of the array of character codes, 0 for what is not in the alphabet."""
    return f"transform(split({value}, ''), c -> instr('{ALPHABET}', c))"


def _pair_counts(samples: DataFrame) -> DataFrame:
    """``label, pair, n`` of ``samples(label, value)``; equal samples are counted first."""
    each = samples.groupBy("label", "value").agg(F.count("*").alias("n"))
    each = each.select("label", "n", F.expr(_codes("value")).alias("c"))
    pairs = F.expr("zip_with(slice(c, 1, size(c) - 1), slice(c, 2, size(c)), (a, b) -> a * 65 + b)")
    return (
        each.where("size(c) > 1")
        .select("label", "n", F.explode(pairs).alias("pair"))
        .groupBy("label", "pair")
        .agg(F.sum("n").alias("n"))
    )


def train(docs: DataFrame, found: DataFrame, training_documents: int = TRAINING_DOCUMENTS) -> list[float]:
    """By pair of character codes, ``log P(b | a, random) - log P(b | a, ordinary)``.

    Without samples of a class its model is the uniform one.
    """
    random = found.where("kind < 3").select(F.lit(1).alias("label"), "value")
    sample = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(training_documents)
    clean = docs.join(F.broadcast(sample), "doc_id", "left_semi").where(
        ~F.col("text").rlike(r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{14}|[0-9a-f]{16}")
    )
    words = clean.select(
        F.lit(0).alias("label"), F.explode(F.expr(f"regexp_extract_all(text, {_sql(IDENTIFIER)}, 0)")).alias("value")
    )
    counts = [[0.0] * (65 * 65) for _ in range(2)]
    for label, pair, n in _pair_counts(random.unionByName(words)).collect():
        counts[label][pair] += n
    ordinary, strange = (_transitions(c) for c in counts)
    return [round(math.log(q) - math.log(p), 6) for p, q in zip(ordinary, strange, strict=True)]


def _transitions(counts: list[float]) -> list[float]:
    """By pair of codes the probability of the second after the first.  What a first character
    says little about is taken from how frequent the second is after any (Dirichlet smoothing
    with weight ``SMOOTHING``), and that from the uniform distribution."""
    total = sum(counts)
    single = [(sum(counts[b::65]) + 0.5) / (total + 0.5 * 65) for b in range(65)]
    out = []
    for a in range(65):
        row = counts[a * 65 : a * 65 + 65]
        seen = sum(row)
        out += [(n + SMOOTHING * p) / (seen + SMOOTHING) for n, p in zip(row, single, strict=True)]
    return out


def log_ratio(value: str, model: list[float]) -> Column:
    """The log-likelihood ratio of a token column under a trained model."""
    table = F.from_json(F.lit(json.dumps(model)), "array<double>")
    ratios = F.zip_with(
        F.expr(f"slice(c, 1, size(c) - 1)"), F.expr("slice(c, 2, size(c))"), lambda a, b: F.get(table, a * 65 + b)
    )
    return F.aggregate(ratios, F.lit(0.0), lambda s, x: s + x)


def secrets(
    docs: DataFrame, threshold: float = THRESHOLD, training_documents: int = TRAINING_DOCUMENTS
) -> DataFrame:
    """``doc_id, kind int, start int, end int``: all secret spans, code points, end exclusive.

    Spans of the patterns stay as they are; a token that the models judge random is added as
    kind 3 where it overlaps none of them.
    """
    texts = documents(docs)
    found = stash(matches(texts), "matches")
    model = train(texts, found, training_documents)
    scored = found.withColumn("c", F.expr(f"CASE WHEN kind = 3 THEN {_codes('value')} END")).withColumn(
        "random", F.when(F.col("kind") == 3, log_ratio("value", model) > threshold).otherwise(True)
    )
    order = Window.partitionBy("doc_id").orderBy("start", "kind", "end")
    base = F.col("kind") < 3
    before = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    return (
        scored.where("random")
        .select("doc_id", "kind", "start", "end", before.alias("b"), after.alias("a"))
        .where(base | ((F.coalesce("b", F.lit(0)) <= F.col("start")) & (F.coalesce("a", "end") >= F.col("end"))))
        .select("doc_id", "kind", "start", "end")
    )


def report(docs: DataFrame, threshold: float = THRESHOLD, training_documents: int = TRAINING_DOCUMENTS) -> DataFrame:
    """One row per document: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random``.

    Null and empty texts have no spans: the digest is then that of the empty string.
    """
    spans = secrets(docs, threshold, training_documents)
    names = F.array(*(F.lit(k) for k in KINDS))
    label = F.concat_ws(":", F.get(names, F.col("kind")), F.col("start"), F.col("end"))
    each = spans.groupBy("doc_id").agg(
        *(F.count(F.when(F.col("kind") == i, 1)).alias(f"n_{k}") for i, k in enumerate(KINDS)),
        F.array_sort(F.collect_list(F.struct("start", "kind", label.alias("label")))).alias("s"),
    )
    joined = lambda arr: F.array_join(F.transform(arr, lambda x: x["label"]), ",")
    each = each.select(
        "doc_id",
        *(f"n_{k}" for k in KINDS),
        F.sha2(joined(F.filter("s", lambda x: x["kind"] < 3)), 256).alias("base_sha256"),
        joined("s").alias("spans"),
    )
    ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return ids.join(each, "doc_id", "left").select(
        "doc_id",
        *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
        F.coalesce("n_random", F.lit(0)).cast("long").alias("n_random"),
    )


def redact(
    docs: DataFrame,
    placeholder: str = "<secret>",
    threshold: float = THRESHOLD,
    training_documents: int = TRAINING_DOCUMENTS,
) -> DataFrame:
    """``docs`` with each run of secret characters in ``text`` replaced by the placeholder.

    All columns and rows stay, and ``n_chars``, where there is such a column, follows the
    text.  Of rows that share a doc_id, and of rows without one, none is redacted by its
    position in another: they are judged by their text alone, under a row id of their own.
    """
    at = "__secret_row"
    keyed = docs
    ids = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    plain = ids.isEmpty() and docs.where("doc_id is null").isEmpty()
    if plain:
        keyed = docs.withColumn(at, F.col("doc_id").cast("long"))
    else:
        keyed = stash(docs.withColumn(at, F.monotonically_increasing_id()), "rows")
    spans = secrets(keyed.select(F.col(at).alias("doc_id"), "text"), threshold, training_documents)
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("new", (F.coalesce(reach, F.lit(-1)) < F.col("start")).cast("int")).withColumn(
        "run", F.sum("new").over(order)
    )
    runs = runs.groupBy("doc_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    cuts = runs.groupBy(F.col("doc_id").alias("__secret_doc")).agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__secret_cuts")
    )
    cuts = stash(cuts, "cuts")
    untouched, rest = split(keyed, F.col(at), cuts.select("__secret_doc"))
    wide = rest.join(cuts, F.col(at) == F.col("__secret_doc"), "left")
    # Between two cuts, and after the last one, the text stays.
    keep = F.expr("""
        transform(sequence(0, size(__secret_cuts)), i -> substring(text,
          if(i = 0, 0, __secret_cuts[i - 1].end) + 1,
          if(i = size(__secret_cuts), length(text), __secret_cuts[i].start) - if(i = 0, 0, __secret_cuts[i - 1].end)))
    """)
    text = F.when(F.col("__secret_cuts").isNull(), F.col("text")).otherwise(F.array_join(keep, placeholder))
    out = wide.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__secret_cuts").isNull(), F.col("n_chars")).otherwise(F.length("text")))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return untouched.select(columns).union(out.select(columns))
