"""Plain Python versions of the operators, for comparison on small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ------------------------------------------------------------------ op9

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}")
SECRET_WORDS = re.compile(r"(?<![a-z0-9])(token|secret|password|passwd|pwd|credentials?|api[ _-]?key|access[ _-]?key|private[ _-]?key|bearer)(?![a-z0-9])")


def secrets(text: str | None) -> list[str]:
    """``secret:start:stop`` of each token with letters and digits near a context word."""
    text, out = text or "", []
    found = list(SECRET.finditer(text))
    ends, starts = [0, *(m.end() for m in found)], [*(m.start() for m in found[1:]), len(text)]
    for m, before, after in zip(found, ends, starts, strict=False):
        near = text[max(before, m.start() - 40) : m.start()].lower() + "\n" + text[m.end() : min(after, m.end() + 40)].lower()
        if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and SECRET_WORDS.search(near):
            out.append(f"secret:{m.start()}:{m.end()}")
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def pii_base(text: str | None) -> list[tuple[int, int, int, str]]:
    text, out = text or "", []
    for no, (kind, pattern) in enumerate((("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE))):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), no, m.end(), kind))
    return sorted(out)


def pii_row(text: str | None) -> tuple:
    base = pii_base(text)
    n = Counter(x[3] for x in base)
    joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in base)
    return n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(joined.encode()).hexdigest()


# ------------------------------------------------------------------ op5


def without_repeats(rows: list[tuple[int | None, str | None]], width: int = 50) -> list[tuple]:
    """(doc_id, n_words, n_removed, kept_sha256) of each row."""
    least: dict[tuple, int] = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            if d is not None:
                least[k] = min(least.get(k, d), d)
    out = []
    for d, t in rows:
        w, gone = words(t), set()
        for i in range(len(w) - width + 1):
            if d is not None and least[tuple(w[i : i + width])] < d:
                gone.update(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


# ------------------------------------------------------------------ op3


def shingle_set(text: str | None) -> frozenset:
    w = words(lower(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    """(doc_id, n_shingles, component_id) of each row."""
    sets = [shingle_set(t) for _, t in rows]
    holders: dict[tuple, list[int]] = {}
    for k, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for k, s in enumerate(sets):
        shared = Counter(j for x in s for j in holders[x] if j < k)
        for j, n in shared.items():
            a, b = rows[k][0], rows[j][0]
            if a is not None and b is not None and 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = find(a), find(b)
                up[max(a, b)] = min(a, b)
    return [(d, len(s), None if d is None else find(d)) for (d, _), s in zip(rows, sets, strict=True)]
