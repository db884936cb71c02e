"""Plain versions of the operators, for small tables."""

import hashlib
import re

ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def secrets(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def secret_row(text):
    s = secrets(text)
    kinds = ("assign", "access", "hex")
    n = [sum(x[1] == k for x in s) for k in range(3)]
    return (*n, sha(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in s)))


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    hit = set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            hit.update(range(i, i + 8))
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    n = len(words)
    return n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(hit), n < 20 or 100 * len(hit) > 30 * n


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def pii(text):
    """n_email, n_ip, n_card, n_phone, base_sha256."""
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [
        ("ip", m)
        for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
        if all(int(x) <= 255 for x in m[0].split("."))
    ]
    out += [
        ("card", m)
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)
        if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))
    ]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]
    n = [sum(k == x for k, _ in out) for x in ("email", "ip", "card", "phone")]
    return (*n, sha(",".join(f"{k}:{m.start()}:{m.end()}" for k, m in out)))


def byte_repeats(texts, size=100):
    """texts: (doc_id, text); by doc_id: n_bytes, n_removed, n_spans, kept_sha256."""
    seen, out = set(), {}
    for doc, text in sorted(texts, key=lambda x: x[0]):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            w = b[i : i + size]
            if w in seen:
                gone[i : i + size] = b"\1" * size
            else:
                seen.add(w)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[doc] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def word_repeats(texts, size=20):
    """texts: (doc_id, text); by doc_id: n_words, n_removed, kept_sha256."""
    seen, out = set(), {}
    for doc, text in sorted(texts, key=lambda x: x[0]):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for i in range(len(words) - size + 1):
            w = tuple(words[i : i + size])
            if w in seen:
                gone[i : i + size] = [True] * size
            else:
                seen.add(w)
        out[doc] = (len(words), sum(gone), sha(" ".join(w for w, g in zip(words, gone) if not g)))
    return out
