"""Plain Python versions of the operators, for small inputs."""
import hashlib
import re

import xxhash

ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(s):
    return hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


def words(text):
    return WORD.findall((text or "").translate(ASCII_LOWER))


def contamination(docs, items, window=10):
    """docs: (doc_id, text); items: (item_id, text) -> sorted (doc_id, n_words, hits, item_ids)."""
    wins = []
    for item, text in items:
        w = words(text)
        n = min(len(w), window)
        wins += [(item, tuple(w[i:i + n])) for i in range(len(w) - n + 1)] if n else []
    out = []
    for doc, text in docs:
        w, hit, got = words(text), set(), set()
        for item, win in wins:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i:i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    got.add(item)
        out.append((doc, len(w), sorted(hit), sorted(str(x) for x in got if x is not None)))
    return out


BASE = [
    ("assign", re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
    ("pem", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), 0, 1),
    ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"), 0, 30),
]


def secrets(text):
    out = []
    for order, (kind, rx, group, least) in enumerate(BASE):
        out += [(m.start(), order, m.end(), kind) for m in rx.finditer(text or "") if len(m[group]) >= least]
    return sorted(out)


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
    if not w:
        return 0
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(n, linked):
    """Smallest member of the component of each of 0..n-1 under the symmetric relation ``linked``."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]
