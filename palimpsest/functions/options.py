"""Values of options as people write them."""

from __future__ import annotations

import re

from .constants import MODES, WINDOW_SIZES

_UNITS = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def parse_size(text: str) -> int:
    """Bytes of a size such as ``256KiB``, ``4 MB`` or ``1g``; units are powers of 1,024."""
    found = re.fullmatch(r"([0-9]+)\s*(?:([kmgt])(?:i?b)?|(b)?)", text.strip().lower())
    if not found:
        raise ValueError(f"{text!r} is no size")
    value = int(found[1]) * _UNITS[found[2] or ""]
    if value >= 1 << 63:
        raise ValueError(f"{text!r} is too large")
    return value


def parse_memory(text: str) -> int | None:
    """A memory budget: None for ``auto``, else at least 128 MiB."""
    if text.strip().lower() in ("", "auto"):
        return None
    value = parse_size(text)
    if value < 128 << 20:
        raise ValueError("a memory budget is at least 128 MiB")
    return value


def parse_window_size(text: str) -> int | str:
    if text.strip().lower() in ("", "auto"):
        return "auto"
    value = parse_size(text)
    if value not in WINDOW_SIZES:
        raise ValueError("a window is 256 KiB, 512 KiB, 1, 2, 4 or 8 MiB")
    return value


def parse_mode(text: str) -> str:
    """An optimisation mode, by name or alias (``speed``, ``size``)."""
    value = text.strip().lower()
    value = {"": "balanced", "speed": "apply-speed", "size": "patch-size"}.get(value, value)
    if value not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    return value


def parse_verify(text: str) -> str:
    """How sources are verified: ``referenced`` ranges, ``strict`` (whole files) or ``output`` only."""
    value = text.strip().lower() or "referenced"
    if value not in ("referenced", "strict", "output"):
        raise ValueError("verification is referenced, strict or output")
    return value
