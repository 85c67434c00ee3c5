"""Plain restatements of what the operators promise, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def exact(rows):
    """(doc_id, keep_id, group_size, kept, sha) of (doc_id, text)."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[low(t)].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        out += [(i, keep, len(ids), i == keep, sha(t)) for i in ids]
    return out


def substrings(rows, width):
    """(doc_id, n_words, n_removed, kept sha)."""
    words = [WORD.findall(t or "") for _, t in rows]
    count = Counter(tuple(w[k : k + width]) for w in words for k in range(len(w) - width + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if count[tuple(w[k : k + width])] > 1:
                gone[k : k + width] = [True] * width
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def similar(rows, width=5, percent=80):
    """(doc_id, n_shingles, component_id, n_links)."""
    sets = []
    for _, t in rows:
        w = WORD.findall(low(t))
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    parent, links = list(range(len(rows))), Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    members = defaultdict(list)
    for k in range(len(rows)):
        members[find(k)].append(rows[k][0])
    first = {r: min((i for i in ids if i is not None), default=None) for r, ids in members.items()}
    return [(rows[k][0], len(sets[k]), first[find(k)], links[k]) for k in range(len(rows))]


def as_rows(df, columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
