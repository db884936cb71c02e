"""Quality rules: fixed limits, then robust multivariate outliers, DataFrame operations only.

For each language and source the minimum-covariance-determinant (MCD) estimate of location and
scatter is fitted to transformed statistics of its documents, and a document is rejected if its
squared Mahalanobis distance exceeds the chi-square cutoff.  The fit is deterministic: several
starts (``STARTS``) take two concentration steps each, the start of least determinant goes on,
and steps are taken until the determinants stand still (``TOLERANCE``).  A step keeps the ``ALPHA`` share of
documents nearest to the last estimate and estimates from them alone.

Groups of every size are treated alike: each estimate counts ``PRIOR`` further documents, which
are distributed as those kept in its language, whose own estimate counts as many distributed as
those kept in all languages.  Ten documents are judged nearly as their language is, ten thousand
by themselves.

The statistics are kept as integers (thousandths).  A concentration step is one pass: documents
are binned by distance (``BINS`` bins for each factor of two), and counts, sums and products are
added up by group and bin; the bins up to the ``ALPHA`` share make the next estimate, the last of
them with the weight that makes the share exact.  What is shuffled follows the number of groups
and bins, so a group with a third of all rows costs no more than others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, stash

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Share of documents that an estimate rests on.
ALPHA = 0.75
#: Share of ordinary documents that the cutoff may reject, if the statistics are normal.
TAIL = 1e-6
#: Documents that the language of a group, and all languages, count for in its estimate.
PRIOR = 50
#: Where fits start: medians and quartiles of the group, of its language and of all documents, and
#: means and scatter of the group and of its language.
STARTS = ("median", "language median", "overall median", "mean", "language mean")
BINS = 64
#: A fit has ended when no logarithm of a determinant's root changes by more; it is taken as it is
#: after ``MAX_STEPS`` steps.
TOLERANCE = 1e-3
MAX_STEPS = 20
SALTS = 32
#: Statistic: SQL over the base columns, and the least standard deviation that a group is
#: taken to have, in the same unit.  The last two are zero for most documents: as shares, not
#: logarithms, a single repeated line is near zero and many are far from it.  Five lines are
#: added so that one of few lines is not a large share.
FEATURES = {
    "word_length": ("ln(word_chars / n_words)", 0.08),
    "symbols": ("ln(1 + 100 * n_symbols / n_words)", 0.4),
    "upper": ("ln(1 + 100 * n_upper / word_chars)", 0.3),
    "dup_lines": ("n_dup_lines / (n_lines + 5)", 0.045),
    "repeats": ("n_repeat_words / n_words", 0.045),
}
_UNIT = 1000
_SPACE = "[\\\\x20\\\\x09-\\\\x0D]+"
_P = len(FEATURES)


def chi2_cdf(x: float, k: int) -> float:
    """The chi-square distribution function, by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    s, x = k / 2, x / 2
    term = total = 1 / s
    n = s
    while term > total * 1e-17:
        n += 1
        term *= x / n
        total += term
    return min(1.0, total * math.exp(-x + s * math.log(x) - math.lgamma(s)))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return high


def base_statistics(docs: DataFrame) -> DataFrame:
    """``docs(.., text)`` with the base columns in place of ``text``.

    Words that repeat are found by 64-bit hashes of 8-word windows within one text.
    """
    out = docs.withColumn("__t", F.coalesce(F.col("text").cast("string"), F.lit(""))).drop("text")
    out = out.select(
        *[c for c in out.columns if c != "__t"],
        F.expr(f"length(regexp_replace(__t, '{_SPACE}', ''))").cast("long").alias("word_chars"),
        F.expr("length(__t) - length(translate(__t, '#*$%&|<>', ''))").cast("long").alias("n_symbols"),
        F.expr("length(__t) - length(translate(__t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))").cast("long").alias("n_upper"),
        F.expr(f"transform(filter(split(__t, '{_SPACE}', -1), x -> x <> ''), w -> xxhash64(w))").alias("__w"),
        F.expr("filter(split(__t, '\\n', -1), x -> x RLIKE '[^\\\\x20\\\\x09-\\\\x0D]')").alias("__l"),
    )
    keep = [c for c in out.columns if not c.startswith("__")]
    out = out.select(
        *keep,
        F.size("__w").cast("long").alias("n_words"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.col("__w").alias("__h"),
    )
    keep += ["n_words", "n_lines", "n_dup_lines"]
    for step in (1, 2, 4):  # hashes of 2, 4 and 8 words
        n = f"greatest(size(__h) - {step}, 0)"
        both = f"zip_with(slice(__h, 1, {n}), slice(__h, {1 + step}, {n}), (a, b) -> xxhash64(a, b))"
        out = out.select(*keep, F.expr(f"if({n} > 0, {both}, array())").alias("__h"))
    out = out.select(
        *keep,
        F.expr("""
            CASE WHEN size(array_distinct(__h)) < size(__h)
            THEN sort_array(transform(__h, (h, i) -> named_struct('h', h, 'i', i))) END""").alias("__s"),
    )
    out = out.select(
        *keep,
        F.expr("""
            sort_array(filter(transform(__s, (x, i) ->
              if(coalesce(get(__s, i - 1).h = x.h, false) OR coalesce(get(__s, i + 1).h = x.h, false), x.i, null)),
              x -> x IS NOT NULL))""").alias("__p"),
    )
    return out.select(
        *keep,
        F.expr("""
            CASE WHEN __p IS NULL THEN 0L ELSE 8L + aggregate(
              zip_with(slice(__p, 1, size(__p) - 1), slice(__p, 2, size(__p)), (a, b) -> least(8, b - a)),
              0L, (s, x) -> s + coalesce(x, 0)) END""").alias("n_repeat_words"),
    )


_GROUP = ["lang", "source", "start"]
_SUMS = ["n", *(f"s_{i}" for i in range(_P)), *(f"s_{i}_{j}" for i in range(_P) for j in range(i + 1))]
_FLOORS = [f for _, f in FEATURES.values()]


def _named(x: str, names: list[str]) -> list[Column]:
    return [F.col(c).alias(f"{x}_{c}") for c in names]


def _shrunk(sums: DataFrame) -> DataFrame:
    """Counts, sums and products by group, with ``PRIOR`` documents of the parents added."""
    total = [F.sum(c).alias(c) for c in _SUMS]
    lang = sums.groupBy("lang", "start").agg(*total)
    every = lang.groupBy("start").agg(*total).select("start", *_named("a", _SUMS))
    lang = lang.join(every, "start").select(
        "lang", "start", *((F.col(c) + PRIOR * F.col(f"a_{c}") / F.col("a_n")).alias(f"p_{c}") for c in _SUMS)
    )
    out = sums.join(lang, ["lang", "start"])
    return out.select(*_GROUP, *((F.col(c) + PRIOR * F.col(f"p_{c}") / F.col("p_n")).alias(c) for c in _SUMS))


def _estimate(sums: DataFrame, scale: float) -> DataFrame:
    """From ``n``, sums ``s_i`` and products ``s_i_j`` by group: means ``m_i`` and the Cholesky
    factor ``l_i_j`` of the scatter, with the least variances added to the diagonal."""
    cov = []
    for i in range(_P):
        for j in range(i + 1):
            c = (F.col(f"s_{i}_{j}") - F.col(f"s_{i}") * F.lit(1.0) * F.col(f"s_{j}") / F.col("n")) / F.col("n") / _UNIT**2
            cov.append((c * scale + (_FLOORS[i] ** 2 if i == j else 0.0)).alias(f"c_{i}_{j}"))
    out = sums.select(*_GROUP, *((F.col(f"s_{i}") / F.col("n") / _UNIT).alias(f"m_{i}") for i in range(_P)), *cov)
    for j in range(_P):  # one column of the factor after the other
        square = F.col(f"c_{j}_{j}")
        for k in range(j):
            square = square - F.col(f"l_{j}_{k}") * F.col(f"l_{j}_{k}")
        out = out.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(square, F.lit((_FLOORS[j] / 100) ** 2))))
        for i in range(j + 1, _P):
            rest = F.col(f"c_{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            out = out.withColumn(f"l_{i}_{j}", rest / F.col(f"l_{j}_{j}"))
    det = F.lit(0.0)
    for j in range(_P):
        det = det + F.log(F.col(f"l_{j}_{j}"))
    return out.select(*_GROUP, *_FIT, F.round(det, 6).alias("det"))


_FIT = [*(f"m_{i}" for i in range(_P)), *(f"l_{i}_{j}" for i in range(_P) for j in range(i + 1))]


def _distance(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """``rows`` with ``start`` and ``d2`` for each estimate of their group, null where it has none.
    Both sides are salted, so that a large group meets its estimate in many tasks."""
    salted = estimate.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = rows.join(salted, ["lang", "source", "salt"], "left")
    names = []
    for i in range(_P):
        z = F.col(f"x_{i}") / _UNIT - F.col(f"m_{i}")
        for k in range(i):
            z = z - F.col(f"l_{i}_{k}") * F.col(f"z_{k}")
        out = out.withColumn(f"z_{i}", z / F.col(f"l_{i}_{i}"))
        names.append(f"z_{i}")
    d2: Column = F.lit(0.0)
    for z in names:
        d2 = d2 + F.col(z) * F.col(z)
    return out.select(*rows.columns, "start", d2.alias("d2"))


def _sums(rows: DataFrame, by: list[str]) -> DataFrame:
    sums = [F.count("*").alias("n")] + [F.sum(f"x_{i}").alias(f"s_{i}") for i in range(_P)]
    sums += [F.sum(F.col(f"x_{i}") * F.col(f"x_{j}")).alias(f"s_{i}_{j}") for i in range(_P) for j in range(i + 1)]
    return rows.groupBy(*by).agg(*sums)


def _concentrate(rows: DataFrame, estimate: DataFrame, scale: float) -> DataFrame:
    """One concentration step of every fit."""
    binned = _distance(rows, estimate).where("d2 IS NOT NULL").withColumn("bin", F.floor(F.log2(F.col("d2") + 2.0**-20) * BINS))
    bins = _sums(binned, [*_GROUP, "bin"])
    fit = Window.partitionBy(*_GROUP)
    before = F.sum("n").over(fit.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    room = F.sum("n").over(fit) * ALPHA - F.coalesce(before, F.lit(0))
    weight = F.least(F.lit(1.0), room / F.col("n"))
    near = bins.withColumn("weight", weight).where("weight > 0")
    return _estimate(_shrunk(near.groupBy(*_GROUP).agg(*(F.sum(F.col(c) * F.col("weight")).alias(c) for c in _SUMS))), scale)


def _starts(rows: DataFrame) -> DataFrame:
    """The estimates that the fits of each group start from."""
    groups = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    quartiles = [F.expr(f"percentile(x_{i}, array(0.25D, 0.5D, 0.75D))").alias(f"q_{i}") for i in range(_P)]
    own = rows.groupBy("lang", "source").agg(*quartiles)
    lang = groups.join(rows.groupBy("lang").agg(*quartiles), "lang")
    medians = rows.agg(*quartiles).first()
    every = groups.select("lang", "source", *(F.array(*(F.lit(v) for v in medians[i] or [None] * 3)).alias(f"q_{i}") for i in range(_P)))
    out = None
    for name, found in zip(STARTS[:3], (own, lang, every), strict=True):
        sd = [(F.col(f"q_{i}")[2] - F.col(f"q_{i}")[0]) / _UNIT / 1.349 for i in range(_P)]
        fit = found.select(
            "lang",
            "source",
            F.lit(STARTS.index(name)).alias("start"),
            *((F.col(f"q_{i}")[1] / _UNIT).alias(f"m_{i}") for i in range(_P)),
            *(
                (F.sqrt(sd[i] * sd[i] + _FLOORS[i] ** 2) if i == j else F.lit(0.0)).alias(f"l_{i}_{j}")
                for i in range(_P)
                for j in range(i + 1)
            ),
            F.lit(0.0).alias("det"),
        )
        out = fit if out is None else out.unionByName(fit)
    sums = stash(_sums(rows, ["lang", "source"]), "sums")
    names = [c for c in _SUMS]
    of_lang = sums.groupBy("lang").agg(*(F.sum(c).alias(c) for c in names))
    own = sums.withColumn("start", F.lit(STARTS.index("mean")))
    lang = sums.select("lang", "source").join(of_lang, "lang").withColumn("start", F.lit(STARTS.index("language mean")))
    classical = own.unionByName(lang.select(own.columns)).select(*_GROUP, *(F.col(c).cast("double").alias(c) for c in names))
    return out.unionByName(_estimate(_shrunk(classical), 1.0))


def mcd(rows: DataFrame) -> DataFrame:
    """The MCD estimate of each group of ``rows(lang, source, salt, x_0, ..)``."""
    estimate = stash(_starts(rows), "mcd")
    # The scatter of the nearest share is smaller than that of all, by a known factor.
    scale = ALPHA / chi2_cdf(chi2_quantile(ALPHA, _P), _P + 2)
    for _ in range(2):
        release(rows.sparkSession)  # plans of a step are the most that the driver holds
        estimate = stash(_concentrate(rows, estimate, scale), "mcd")
    best = F.min_by(F.struct(*(c for c in estimate.columns if c not in ("lang", "source"))), F.struct("det", "start"))
    estimate = estimate.groupBy("lang", "source").agg(best.alias("best")).select("lang", "source", "best.*")
    # The fits that go on share their parents from here on, wherever they started.
    estimate = stash(estimate.withColumn("start", F.lit(0)), "mcd")
    for _ in range(MAX_STEPS - 2):
        release(rows.sparkSession)
        before = estimate.select("lang", "source", F.col("det").alias("last"))
        estimate = stash(_concentrate(rows, estimate, scale), "mcd")
        if estimate.join(before, ["lang", "source"]).where(F.abs(F.col("det") - F.col("last")) > TOLERANCE).isEmpty():
            break
    release(rows.sparkSession)
    return estimate


def verdicts(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, d2``.

    Null and empty texts have no words and fail; a null language or source is a group of its
    own; ``d2`` is null for a document that fails.
    Rows are judged one by one, so repeated rows and repeated or null ids get one row each.
    """
    def column(name: str) -> Column:
        return (F.col(name).cast("string") if name in docs.columns else F.lit(None).cast("string")).alias(name)

    base = base_statistics(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), column("lang"), column("source"), "text")
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    base = base.withColumn("base_failed", failed).select(
        "*",
        *(
            F.when(~F.col("base_failed"), F.round(F.expr(x) * _UNIT).cast("long")).alias(f"x_{i}")
            for i, (x, _) in enumerate(FEATURES.values())
        ),
        F.pmod(F.xxhash64("doc_id", "word_chars", "n_words"), F.lit(SALTS)).cast("int").alias("salt"),
    )
    named = [F.coalesce(c, F.lit("\u0000null")).alias(c) for c in ("lang", "source")]
    base = stash(base.select(*[c for c in base.columns if c not in ("lang", "source")], *named), "statistics")
    estimate = mcd(base.where(~F.col("base_failed")))
    limit = chi2_quantile(1 - tail, _P)
    judged = _distance(base, estimate)
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= limit)).alias("kept"),
        F.round("d2", 4).alias("d2"),
    )


def keep_good(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns.

    A row with a null doc_id is rejected: its verdict can't be told from another's.  Of rows
    that share a doc_id, all stay if one is kept.
    """
    kept = verdicts(docs, tail).where("kept").select(F.col("doc_id").alias("__kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].cast("long") == kept["__kept_id"], "left_semi")
