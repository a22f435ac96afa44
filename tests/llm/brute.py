"""Plain Python versions of what the operators return, one text or table at a time."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

SPACE = " \t\n\x0b\x0c\r"
PRIVATE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SECRET = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}


def words(text: str) -> list[str]:
    return [w for w in re.split(f"[{SPACE}]+", text) if w]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def accepts(kind: str, m: re.Match) -> bool:
    digits = re.sub("[^0-9]", "", m[0])
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
        "card": lambda: 12 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 9 <= len(digits) <= 15,
        "assign": lambda: len(m[2]) >= 12,
        "access": lambda: len(m[0]) >= 18,
        "hex": lambda: len(m[0]) >= 16,
    }[kind]()


def spans(text: str | None, patterns: dict[str, str]) -> list[tuple[str, int, int]]:
    order = list(patterns)
    found = [(k, m.start(), m.end()) for k, p in patterns.items() for m in re.finditer(p, text or "") if accepts(k, m)]
    return sorted(found, key=lambda x: (x[1], order.index(x[0])))


def written(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def sha(found: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(written(found).encode()).hexdigest()


def quality(text: str | None) -> dict:
    text = text or ""
    ws = words(text)
    grams = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    covered = {j for i in range(len(ws) - 4) if grams[tuple(ws[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return {
        "n_words": len(ws), "word_chars": sum(map(len, ws)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": dup, "n_repeat_words": len(covered),
        "base_failed": len(ws) < 10 or 100 * len(covered) > 20 * len(ws),
    }


# texts for fixtures
SYLLABLES = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve"]
COMMON = ["the", "and", "of", "to", "a", "in", "is", "that", "it", "was"]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(COMMON) if rng.random() < 0.35 else "".join(rng.choices(SYLLABLES, k=rng.randint(2, 5))) for _ in range(n))
