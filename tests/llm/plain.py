"""Plain single-process versions of the operators' contracts, and small awkward tables."""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import combinations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SENTENCE = "the quick brown fox jumps over the lazy dog while seven grey geese fly north across a wide cold lake in march"


def awkward_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, one id with two texts."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [
        (1, SENTENCE, "en", "a"), (2, SENTENCE.upper(), "en", "b"), (3, SENTENCE + " again", "en", None), (4, None, None, "a"),
        (5, "", "en", "a"), (6, " \t\n", "en", "b"), (7, "one", "en", "a"), (8, "ONE", "en", "c"), (9, long, "en", "a"), (10, long + " end", "en", "a"),
        (11, "café \U0001f600 naïve", "fr", "c"), (11, "café \U0001f600 naïve", "fr", "c"), (12, "first text of twelve here", "de", "c"),
        (12, SENTENCE + " twelve", "de", "c"), (None, SENTENCE, None, None), (None, None, None, None),
    ]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], DOC_SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text, width):
    w = words(text)
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def roots(nodes, links):
    """Smallest node reachable from each."""
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def near_links(rows, width, percent=80):
    """Links between ids of (doc_id, text) rows; a set's ids are all linked."""
    by_set = defaultdict(list)
    for doc_id, text in rows:
        s = shingles(text, width)
        if s and doc_id is not None:
            by_set[s].append(doc_id)
    links = [(ids[0], x) for ids in by_set.values() for x in ids]
    for (s, a), (t, b) in combinations(by_set.items(), 2):
        if 100 * len(s & t) >= percent * len(s | t):
            links.append((a[0], b[0]))
    return links


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contamination(docs, items):
    """(n_words, n_hit, sorted item ids) of each text, in order."""
    held = defaultdict(set)
    for item_id, text in items:
        w = bench_words(text)
        for j in range(max(len(w) - 9, 1)):
            if w:
                held[tuple(w[j : j + 10])].add(item_id)
    out = []
    for _, text in docs:
        w, hit, found = bench_words(text), set(), set()
        for size in {len(k) for k in held}:
            for j in range(len(w) - size + 1):
                if (key := tuple(w[j : j + size])) in held:
                    hit.update(range(j, j + size))
                    found |= held[key] - {None}
        out.append((len(w), len(hit), sorted(map(str, found))))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def pii(text):
    """Base spans by kind, then start, found with the plain patterns."""
    out = []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {
                "email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15,
            }[kind]:
                out.append((kind, *m.span()))
    return out


def secrets(text):
    """Base spans by start, then kind, found with the plain patterns."""
    found, text = [], text or ""
    found += [(m.start(), 0, m.end(), "assign") for m in re.finditer(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(k, s, e) for s, _, e, k in sorted(found)]
