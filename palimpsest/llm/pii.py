"""Personal data by weak supervision.

Four patterns find e-mail addresses, IP addresses, card numbers and phone numbers; their spans
always stay.  Beyond them, looser candidates (number groups, spelled-out addresses) are judged
by a model that nobody labelled by hand: labelers over shape, checksum, gazetteer and context
vote on every candidate and every base span of the corpus, expectation-maximisation estimates
how reliable each labeler is and the posterior of each vote pattern, and a logistic regression
on span features is trained on these posteriors.  Both fits use all documents: what reaches
the driver is a count for each pair of vote pattern and feature pattern, at most
3^5 x 2^10 rows whatever the corpus.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, stash

KINDS = ("email", "ip", "card", "phone", "other")
THRESHOLD = 0.5
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never starts inside a run of digits: from its start the run would match as well.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBERS = re.compile(r"(?<![0-9A-Za-z+.])\(?[0-9][0-9().\x20-]{5,38}[0-9](?![0-9A-Za-z])")
_SPELLED = re.compile(
    r"[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]{1,63})+",
    re.IGNORECASE | re.ASCII,
)
_DIGIT = re.compile("[0-9]")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")

#: Words near personal data, and near numbers that are none.
NEAR_PERSONAL = frozenset(
    "call phone tel telephone fax mobile cell contact mail email e-mail card visa mastercard amex account iban ssn "
    "ip host address whatsapp kontakt telefon courriel telefono correo tarjeta carte karte".split()
)
NEAR_OTHER = frozenset("page pages version isbn issn doi order chapter section figure table item build release year".split())
#: Last labels of mail domains, card issuers' first digits, country codes.
DOMAINS = frozenset("com org net edu gov io de fr es uk info".split())
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "2221")
COUNTRIES = ("1", "33", "34", "39", "44", "49", "351")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: the run before an ``@`` is taken whole, in time linear in the text."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            last = found.end()
            out.append((start, last))
            at = text.find("@", last)
        else:
            last = max(last, start)
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` of the four patterns, by kind, then start."""
    out = [(0, a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, bool]]:
    """``(start, end, base?)``: the base spans, and looser candidates that touch none of them."""
    found = []
    if _DIGIT.search(text):
        found = [(m.start(), m.end()) for m in _NUMBERS.finditer(text)]
    if "at]" in (low := text.lower()) or "at)" in low:
        found += [(m.start(), m.end()) for m in _SPELLED.finditer(text)]
    if not found and not base:
        return []
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    reach = np.maximum.accumulate([b for _, b in taken]).tolist() if taken else []
    out = [(a, b, True) for a, b in taken]
    last = 0
    for a, b in sorted(found):
        before = int(np.searchsorted(starts, b))  # base spans that start before this one ends
        if a >= last and (before == 0 or reach[before - 1] <= a):
            out.append((a, b, False))
            last = b
    return out


def votes(text: str, start: int, end: int) -> tuple[int, int]:
    """The vote pattern (base 3: 0 not personal, 1 abstains, 2 personal) and the features."""
    s = text[start:end]
    digits = _digits(s)
    n = len(digits)
    mail = "@" in s or "at]" in s.lower() or "at)" in s.lower()
    quad = s.count(".") == 3 and s.replace(".", "").isdigit()
    grouped = any(c in s for c in " ().-")
    near = set(re.findall(r"[a-z-]+", text[max(0, start - 32) : start].lower())[-3:])
    personal, other = bool(near & NEAR_PERSONAL), bool(near & NEAR_OTHER)
    luhn_ok = n >= 13 and luhn(digits)
    shape = 2 if mail or quad or (grouped and 10 <= n <= 15) or 16 <= n <= 19 else 0 if n < 7 or n > 19 else 1
    check = 1
    if quad:
        check = 2 if all(map(_small, s.split("."))) else 0
    elif n >= 16 and not mail:
        check = 2 if luhn_ok else 0
    known = 1
    if mail:
        known = 2 if s.lower().rstrip(")]").rsplit(".", 1)[-1].strip() in DOMAINS else 1
    elif n >= 16:
        known = 2 if digits.startswith(ISSUERS) else 0
    elif s.startswith("+"):
        known = 2 if digits.startswith(COUNTRIES) else 1
    context = 2 if personal and not other else 0 if other and not personal else 1
    plain = 0 if not mail and not grouped and n < 16 else 0 if n < 9 and not mail and not quad else 1
    pattern = 0
    for v in (shape, check, known, context, plain):
        pattern = pattern * 3 + v
    bits = (mail, quad, grouped, n >= 16, 10 <= n < 16, 7 <= n < 10, luhn_ok, s[:1] in "+(", personal, other)
    return pattern, sum(1 << i for i, b in enumerate(bits) if b)


_FOUND = "doc_id long, base array<int>, cand array<int>"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base spans as flat (kind, start, end), candidates as flat (start, end, base, votes, features)."""
    for batch in batches:
        bases, cands = [], []
        for x in batch.column(1):
            text = x.as_py()
            base = base_spans(text)
            bases.append([v for span in base for v in span])
            cands.append([v for a, b, own in candidates(text, base) for v in (a, b, int(own), *votes(text, a, b))])
        yield pa.record_batch(
            [batch.column(0), pa.array(bases, pa.list_(pa.int32())), pa.array(cands, pa.list_(pa.int32()))],
            ["doc_id", "base", "cand"],
        )


def _vote_matrix(patterns: np.ndarray) -> np.ndarray:
    return np.stack([patterns // 3**k % 3 for k in range(4, -1, -1)], axis=1)


def reliabilities(patterns: np.ndarray, counts: np.ndarray, steps: int = 200) -> tuple[np.ndarray, float, np.ndarray]:
    """EM over vote patterns: for each labeler P(vote | class), the prior, and the posteriors.

    It starts from the majority vote; votes and classes have pseudo-counts of one.
    """
    v = _vote_matrix(patterns)
    post = 1 / (1 + np.exp(-1.5 * (v.astype(float) - 1).sum(axis=1)))
    table = np.zeros((v.shape[1], 2, 3))
    prior = 0.5
    for _ in range(steps):
        weight = np.stack([counts * (1 - post), counts * post])
        prior = float((weight[1].sum() + 1) / (weight.sum() + 2))
        for k in range(v.shape[1]):
            for value in range(3):
                table[k, :, value] = weight[:, v[:, k] == value].sum(axis=1) + 1
        table /= table.sum(axis=2, keepdims=True)
        log = np.log(table[np.arange(v.shape[1])[None, :], 1, v]) - np.log(table[np.arange(v.shape[1])[None, :], 0, v])
        new = 1 / (1 + np.exp(-(log.sum(axis=1) + np.log(prior / (1 - prior)))))
        if np.abs(new - post).max(initial=0) < 1e-9:
            post = new
            break
        post = new
    return table, prior, post


def _design(features: np.ndarray) -> np.ndarray:
    bits = (features[:, None] >> np.arange(10)) & 1
    return np.concatenate([np.ones((len(features), 1)), bits], axis=1).astype(float)


def train_classifier(features: np.ndarray, weights: np.ndarray, targets: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression on soft targets, by Newton's method."""
    x = _design(features)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weights * (p - targets)) + ridge * w
        hessian = (x * (weights * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(found: DataFrame) -> np.ndarray:
    """The span classifier's weights, from all candidates of ``found``."""
    each = found.select(F.explode(F.expr("transform(sequence(0, size(cand) div 5), i -> struct(get(cand, i * 5 + 3) AS v, get(cand, i * 5 + 4) AS f))")).alias("x"))
    rows = each.where("x.v is not null").groupBy("x.v", "x.f").agg(F.count("*").alias("n")).orderBy("v", "f").collect()
    if not rows:
        return np.full(11, 0.0) - np.eye(11)[0] * 10
    v, f, n = (np.array([r[i] for r in rows], np.int64) for i in range(3))
    _, _, post = reliabilities(v, n.astype(float))
    return train_classifier(f, n.astype(float), post)


def _judge(weights: np.ndarray, threshold: float):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = [[] for _ in KINDS], [], []
            for base, cand in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = [f"{KINDS[base[i]]}:{base[i + 1]}:{base[i + 2]}" for i in range(0, len(base), 3)]
                more = np.array(cand, np.int64).reshape(-1, 5)
                more = more[more[:, 2] == 0]
                added = []
                if len(more):
                    p = 1 / (1 + np.exp(-np.clip(_design(more[:, 4]) @ weights, -30, 30)))
                    added = [f"{KINDS[4]}:{a}:{b}" for a, b in more[p > threshold][:, :2].tolist()]
                for k in range(4):
                    counts[k].append(base[::3].count(k))
                counts[4].append(len(added))
                digests.append(hashlib.sha256(",".join(own).encode()).hexdigest())
                spans.append(",".join(own + added))
            yield pa.record_batch(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts[:4]), pa.array(digests), pa.array(spans), pa.array(counts[4], pa.int64())],
                ["doc_id", *(f"n_{k}" for k in KINDS[:4]), "base_sha256", "spans", "n_other"],
            )

    return judge


def report(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans,
    n_other``; spans in code points, end exclusive.

    Null and empty texts have no spans, and the digest is that of the empty string; without
    any candidate in the corpus nothing is added; an empty table gives an empty result.
    """
    found = stash(documents(docs).mapInArrow(_find, _FOUND), "spans")
    return found.mapInArrow(
        _judge(fit(found), threshold),
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_other long",
    )
