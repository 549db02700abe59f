"""Plain versions of token counts, spelling variants and conversation repair."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
STEP = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
NAMES = {"u": "user", "a": "assistant"}


def word_counts(rows):
    """Occurrences of the words of (doc_id, text) rows after planted slips."""
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            low = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 31 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            if len(low) >= 7:
                counts[low] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def one_apart(x, y):
    """Whether one insertion, deletion or replacement makes *y* of *x*."""
    if x == y or abs(len(x) - len(y)) > 1:
        return False
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    short, long = sorted((x, y), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def variants(counts):
    """{word: (form, root, n, n_near, form_n)}, by words that lack one code point."""
    near, lacking = {w: set() for w in counts}, {}
    for w in counts:
        for i in range(len(w)):
            lacking.setdefault((w[:i], w[i + 1 :]), set()).add(w)
            v = w[:i] + w[i + 1 :]
            if v in counts:
                near[w].add(v)
                near[v].add(w)
    for group in lacking.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda y: (-counts[y], y))
            if counts[best] >= 10 * counts[w]:
                form[w] = best
    found = {}
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        found[w] = form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None
    return found


def damaged(rows):
    found = []
    for conv, turn, role, text in rows:
        key, role, text = ":".join(" " if v is None else str(v) for v in (conv, turn)), role if role is not None else " ", text if text is not None else " "
        fault = zlib.crc32(key.encode()) % 20
        if fault == 1:
            text = ""
        elif fault == 2:
            text = re.sub("[.!?]", "", text)
        elif fault == 4:
            role = "user"
        found += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return found


def _made(best):
    """Also with turns made at this place."""
    for _ in range(3):
        for q, (cost, audit, lines) in list(best.items()):
            for x in "ua":
                if x in STEP[q] and (x not in best or (cost + 2, audit + "I") < best[x][:2]):
                    best[x] = cost + 2, audit + "I", lines + [NAMES[x] + ":"]
    return best


def repaired(rows, conversations):
    """{conv_id: (gaps, blank, duplicate, truncated, illegal, cost, audit, sha256)} by the least (cost, audit) of every prefix and state."""
    found = {}
    for conv in conversations:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in own:
            tail = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not tail else "duplicate" if (role, text) in seen else "truncated" if tail[-1] not in ".!?" else "")
            seen.add((role, text))
        best = {"": (0, "", [])}
        for (_, role, text), fault in zip(own, faults):
            following = {}
            for q, (cost, audit, lines) in _made(best).items():
                ways = [(q, 3, "D", [])]
                if fault not in ("blank", "duplicate"):
                    stays = int(fault == "truncated")
                    if role[:1] in STEP[q]:
                        ways.append((role[0], stays, "K", [f"{role}:{text}"]))
                    ways += [(x, 2 + stays, "R", [f"{NAMES[x]}:{text}"]) for x in "ua" if x in STEP[q]]
                for to, more, letter, line in ways:
                    if to not in following or (cost + more, audit + letter) < following[to][:2]:
                        following[to] = cost + more, audit + letter, lines + line
            best = following
        cost, audit, lines = min((v for q, v in _made(best).items() if q in ("", "a")), key=lambda v: v[:2])
        turns = {r[0] for r in own} - {None}
        illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(own, own[1:]))
        found[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return found
