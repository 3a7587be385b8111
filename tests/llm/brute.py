"""Plain versions of the operators, over lists of rows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def base_rules(text):
    text = text or ""
    w = WORDS.findall(text)
    three = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, again = set(), 0
    for line in text.split("\n"):
        again += line in seen and bool(WORDS.search(line))
        seen.add(line)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered), failed


def fingerprint(text):
    w = [x.encode() for x in WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def closure(n, linked):
    """Smallest index reachable from each of n."""
    lab = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in linked[i]:
                if lab[j] < lab[i]:
                    lab[i], changed = lab[j], True
    return lab


def exact(rows):
    """{doc_id: (keep_id, group_size, sha256)} of (doc_id, text) rows with distinct ids."""
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in rows}
    groups = defaultdict(list)
    for i, t in norm.items():
        groups[t].append(i)
    return {i: (min(groups[t]), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()}


def repeats(rows, length=50):
    """{doc_id: (bytes, removed, spans, sha256 of the rest)}; rows in the order of doc_id."""
    seen, out = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        mine = set()
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w in seen:
                gone[k : k + length] = True
            mine.add(w)
        seen |= mine
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def lines(rows, p=4, q=5):
    """{(doc_id, line): (class doc_id, class line, links, removed)} of rows in the order of doc_id."""
    found = [((i, k), frozenset(WORDS.findall(x))) for i, t in rows for k, x in enumerate((t or "").split("\n"))]
    first = {}
    for place, s in found:
        if s:
            first.setdefault(s, place)
    order = {place: n for n, (place, _) in enumerate(found)}
    by_word = defaultdict(list)
    for s in first:
        for w in s:
            by_word[w].append(s)
    links = defaultdict(set)
    for s in first:
        for o, k in Counter(o for w in s for o in by_word[w]).items():
            if o is not s and q * k >= p * (len(s) + len(o) - k):
                links[s].add(o)
    out = {}
    for place, s in found:
        if not s:
            out[place] = (None, None, 0, False)
            continue
        near = min((order[first[o]] for o in links[s]), default=10**18)
        out[place] = (*first[s], len(links[s]), near < order[first[s]] or order[place] > order[first[s]])
    return out


def phrases(sample, text):
    """Phrases of the text when each is the longest match in the sample; unknown characters are phrases."""
    n = at = 0
    while at < len(text):
        k = 0
        while at + k < len(text) and text[at : at + k + 1] in sample:
            k += 1
        at += max(k, 1)
        n += 1
    return n


def near_copies(rows):
    """{id: smallest id that links of 5-word Jaccard 4/5 or more reach} of (id, text) rows with distinct ids."""
    rows = sorted(rows, key=lambda r: r[0])
    sets = []
    for _, t in rows:
        w = [x.encode().lower() for x in WORDS.findall(t or "")]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    near = [[j for j in range(len(sets)) if not sets[i] and not sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in range(len(sets))]
    return {rows[i][0]: rows[k][0] for i, k in enumerate(closure(len(sets), near))}
