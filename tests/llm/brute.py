"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import re

SPACE = r"[\x20\x09-\x0D]"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if not words:
        return set()
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))}


def near_components(docs, share=80):
    """{(doc_id, n_shingles, component_id)} by comparing all pairs."""
    sets = [(i, shingle_set(t)) for i, t in docs]
    parent = {i: i for i, _ in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (a, s) in enumerate(sets):
        for b, t in sets[:x]:
            if s and t and 100 * len(s & t) >= share * len(s | t):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {(i, len(s), root(i)) for i, s in sets}


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (2 if place % 2 else 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def personal(text):
    """[(kind, start, end)] of the fixed patterns."""
    def counts(kind, value):
        digits = re.sub("[^0-9]", "", value)
        return (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in value.split("."))
                or kind == "card" and 13 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15)

    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if counts(k, m[0])]


def kept_lines(docs, least=10):
    """{doc_id: (n_lines, n_dropped, kept text)}, ids distinct."""
    def key(line):
        return line.strip(" \t\n\v\f\r").translate(UPPER)

    owner = {}
    for ident, text in docs:
        for line in (text or "").split("\n"):
            k = key(line)
            owner[k] = min(owner.get(k, ident), ident)
    out = {}
    for ident, text in docs:
        lines = (text or "").split("\n")
        keep = [x for x in lines if len(key(x)) < least or owner[key(x)] == ident]
        out[ident] = (len(lines), len(lines) - len(keep), "\n".join(keep))
    return out
