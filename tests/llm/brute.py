"""Plain versions of the operators' definitions, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DARK = re.compile(r"[^\x20\x09-\x0D]+")


def contamination(docs, items, size=10):
    """docs, items: (id, text); returns (id, n_words, n_hit, n_items, sha256, contaminated)."""
    windows = defaultdict(set)
    for item, text in items:
        words = ALNUM.findall((text or "").translate(LOWER))
        n = min(size, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows[n, tuple(words[i : i + n])].add(item)
    out = []
    for doc, text in docs:
        words = ALNUM.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in {n for n, _ in windows}:
            for i in range(len(words) - n + 1):
                if (n, tuple(words[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[n, tuple(words[i : i + n])]
        names = ",".join(sorted(str(x) for x in found if x is not None))
        digest = hashlib.sha256(names.encode()).hexdigest()
        out.append((doc, len(words), len(hit), len({x for x in found if x is not None}), digest, bool(hit)))
    return out


def repeated_spans(texts, length):
    """Which units of each sequence lie in a run of ``length`` units that starts twice anywhere."""
    starts = Counter(
        bytes(t[i : i + length]) if isinstance(t, bytes) else tuple(t[i : i + length])
        for t in texts
        for i in range(len(t) - length + 1)
    )
    out = []
    for t in texts:
        gone = [False] * len(t)
        until = 0
        for i in range(len(t) - length + 1):
            key = bytes(t[i : i + length]) if isinstance(t, bytes) else tuple(t[i : i + length])
            if starts[key] > 1:
                for k in range(max(i, until), i + length):
                    gone[k] = True
                until = i + length
        out.append(gone)
    return out


def suffix_dedup(docs, length=200):
    texts = [(text or "").encode() for _, text in docs]
    out = []
    for (doc, _), text, gone in zip(docs, texts, repeated_spans(texts, length)):
        kept = bytes(b for b, g in zip(text, gone) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(text), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def phrase_dedup(docs, length=35):
    texts = [DARK.findall(text or "") for _, text in docs]
    out = []
    for (doc, _), words, gone in zip(docs, texts, repeated_spans(texts, length)):
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((doc, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def near_dedup(docs, size=5, percent=75):
    sets = {}
    for doc, text in docs:
        words = DARK.findall((text or "").translate(LOWER))
        n = min(size, len(words))
        sets[doc] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()
    root = {doc: doc for doc in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for doc in sets:
        for shingle in sets[doc]:
            holders[shingle].append(doc)
    common = Counter()
    for group in holders.values():
        common.update((a, b) for a in group for b in group if a < b)
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return [(doc, len(sets[doc]), find(doc), find(doc) == doc) for doc in sets]


def base_scores(docs, held_out):
    """docs: (id, text); returns (id, held_out, n_tokens, n_known, train_tokens, base_score)."""
    from math import log10

    end = object()
    tokens = {doc: [*DARK.findall((text or "").translate(LOWER)), end] for doc, text in docs}
    counts = Counter(t for doc in tokens if not held_out(doc) for t in tokens[doc])
    total, kinds = sum(counts.values()), len(counts)
    return [
        (
            doc, held_out(doc), len(own), sum(counts[t] > 0 for t in own), total,
            sum(log10((counts[t] + 1) / (total + kinds + 1)) for t in own),
        )
        for doc, own in tokens.items()
    ]
