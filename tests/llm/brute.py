"""Plain-Python versions of what the operators must return."""

import collections
import hashlib
import math
import re
import zlib

_LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def fold(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def solid_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_LOWER))


def contamination(docs, items, window=13):
    """doc_id -> (n_words, n_hit, n_items, items_sha256, contaminated)"""
    known = collections.defaultdict(set)
    for i, t in items:
        w = alnum_words(t)
        for k in range(max(1, len(w) - window + 1)) if w else []:
            known[tuple(w[k:k + window])].add(i)
    out = {}
    for d, t in docs:
        w, hit, found = alnum_words(t), set(), set()
        for n in set(map(len, known)):
            for k in range(len(w) - n + 1):
                if got := known.get(tuple(w[k:k + n])):
                    found |= got
                    hit.update(range(k, k + n))
        listed = ",".join(sorted(map(str, found)))
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(listed.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def line_cuts(docs, min_words=50):
    """doc_id -> text with every line cut that lies in a run of min_words words with an earlier,
    not overlapping copy; ids must differ."""
    first, runs = {}, []
    for d, t in docs:
        lines = [(i, tuple(w)) for i, x in enumerate((t or "").split("\n")) if (w := solid_words(x))]
        for a in range(len(lines)):
            n = 0
            for b in range(a, min(len(lines), a + 120)):
                n += len(lines[b][1])
                if n >= min_words:
                    runs.append((d, lines[a][0], lines[b][0], tuple(x[1] for x in lines[a:b + 1])))
    for d, a, b, run in sorted(runs, key=lambda r: r[:3]):
        first.setdefault(run, (d, a, b))
    gone = collections.defaultdict(set)
    for d, a, b, run in runs:
        f = first[run]
        if f[0] != d or a > f[2]:
            gone[d].update(range(a, b + 1))
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in docs}


def shingle_components(docs, n_words, percent):
    """doc_id -> (n_shingles, component_id)"""
    sets = {}
    for d, t in docs:
        w = solid_words(t)
        sets[d] = frozenset(tuple(w[i:i + n_words]) for i in range(len(w) - n_words + 1)) if len(w) >= n_words else frozenset([tuple(w)] if w else [])
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= max(len(x), len(y)) * percent:
                common = len(x & y)
                if 100 * common >= percent * (len(x) + len(y) - common):
                    p, q = top(a), top(b)
                    parent[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), top(d)) for d in sets}


def unigram(docs, trained):
    """doc_id -> (n_tokens, n_known, train_tokens, base_score)"""
    tokens = {d: [*solid_words(t), None] for d, t in docs}
    c = collections.Counter(x for d, _ in docs if trained(d) for x in tokens[d])
    n, v = sum(c.values()), len(c)
    return {d: (len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for d, w in tokens.items()}
