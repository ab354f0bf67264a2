"""Plain versions of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def near_classes(rows):
    """[(doc_id, text or None)] -> {doc_id: (n_shingles, component_id)}; ids are not null."""
    sets = {}
    for i, text in rows:
        w = WORD.findall((text or "").encode().translate(LOWER))
        s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        sets[i] = s
    has = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            has[x].append(i)
    shared = defaultdict(int)
    for same in has.values():
        for k, a in enumerate(same):
            for b in same[k + 1 :]:
                shared[a, b] += 1
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((top(a), top(b)))
            up[b] = a
    return {i: (len(s), top(i)) for i, s in sets.items()}


def word_repeats(rows, window=20):
    """[(doc_id, text or None)] -> {doc_id: (n_words, n_removed, kept_sha256)}."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        w = WORD.findall((text or "").encode())
        gone = bytearray(len(w))
        for k in range(len(w) - window + 1):
            x = b" ".join(w[k : k + window])
            if x in seen:
                gone[k : k + window] = b"\1" * window
            seen.add(x)
        out[i] = len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()
    return out


def byte_repeats(rows, window=100):
    """[(doc_id, text or None)] -> {doc_id: (n_bytes, n_removed, n_spans, kept_sha256)}."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        t = (text or "").encode()
        gone = bytearray(len(t))
        for k in range(len(t) - window + 1):
            x = hashlib.blake2b(t[k : k + window], digest_size=12).digest()
            if x in seen:
                gone[k : k + window] = b"\1" * window
            seen.add(x)
        runs = sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1]))
        out[i] = len(t), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(t, gone) if not g)).hexdigest()
    return out
