"""Plain versions of the text operators, from the definitions, for small inputs."""

from __future__ import annotations

import re
import unicodedata


def words(text):
    if not text:
        return []
    text = "".join(c for c in text if unicodedata.category(c) != "Cf")
    return [w for w in re.split(r"[\W_]+", text.casefold()) if w]


def leaks(docs, items, least=12):
    """docs, items: (id, text). Pairs (doc, item) with `least` successive words in common."""
    grams = {}
    for i, t in items:
        ws = words(t)
        for k in range(len(ws) - least + 1):
            grams.setdefault(tuple(ws[k : k + least]), set()).add(i)
    out = set()
    for d, t in docs:
        ws = words(t)
        for k in range(len(ws) - least + 1):
            out |= {(d, i) for i in grams.get(tuple(ws[k : k + least]), ())}
    return out


def sharing(docs, least=300):
    """Pairs that share a span, and per document the set of code points that stand elsewhere."""
    where = {}
    for d, t in docs:
        for k in range(len(t or "") - least + 1):
            where.setdefault(t[k : k + least], {}).setdefault(d, []).append(k)
    pairs, covered = set(), {}
    for members in where.values():
        if len(members) > 1:
            own = sorted(members)
            pairs |= {(a, b) for i, a in enumerate(own) for b in own[i + 1 :]}
            for d, at in members.items():
                for k in at:
                    covered.setdefault(d, set()).update(range(k, k + least))
    return pairs, covered
