"""Plain-Python versions of the contracts, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import xxhash

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def fingerprint(t):
    w = words((t or "").translate(LOW))
    if not w:
        return 0
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, bits=3):
    """Index of the first member reachable, for a list of fingerprints."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def repeated(rows, n=50):
    """(doc_id, n_words, n_removed, sha of the rest) of rows (doc_id, text)."""
    first = {}
    for i, t in rows:
        w = words(t)
        for a in range(len(w) - n + 1):
            k = tuple(w[a:a + n])
            if i is not None:
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for a in range(len(w) - n + 1):
            if i is not None and first[tuple(w[a:a + n])] < i:
                gone[a:a + n] = [True] * n
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def bench_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def contaminated(rows, items, n=10):
    wins = {}
    for i, t in items:
        w = bench_words(t)
        for a in range(max(1, len(w) - n + 1)) if w else ():
            wins.setdefault(tuple(w[a:a + n]), set()).add(i)
    out = []
    for i, t in rows:
        w = bench_words(t)
        hit, found = [False] * len(w), set()
        for size in {len(k) for k in wins}:
            for a in range(len(w) - size + 1):
                k = tuple(w[a:a + size])
                if k in wins:
                    hit[a:a + size] = [True] * size
                    found |= wins[k] - {None}
        out.append((i, len(w), sum(hit), len(found), sha(",".join(sorted(map(str, found)))), any(hit)))
    return out


def unigram(rows, mod=7, rest=2):
    toks = [words((t or "").translate(LOW)) + [None] for _, t in rows]
    held = [zlib.crc32(str(i).encode() if i is not None else b"") % mod == rest for i, _ in rows]
    c = Counter(w for x, h in zip(toks, held) if not h for w in x)
    n, v = sum(c.values()), len(c)
    return [(i, h, len(x), sum(c[w] > 0 for w in x), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x))
            for (i, _), x, h in zip(rows, toks, held)]


def quality(t):
    t = t or ""
    w = words(t)
    c = Counter(tuple(w[a:a + 8]) for a in range(len(w) - 7))
    rep = [False] * len(w)
    for a in range(len(w) - 7):
        if c[tuple(w[a:a + 8])] > 1:
            rep[a:a + 8] = [True] * 8
    lines = [x for x in t.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), len(lines) - len(set(lines)), sum(rep),
            len(w) < 20 or 100 * sum(rep) > 30 * len(w))


def _digits(s):
    return re.sub("[^0-9]", "", s)


def _luhn(s):
    t = 0
    for i, ch in enumerate(s[::-1]):
        n = int(ch) * (1 + i % 2)
        t += n - 9 * (n > 9)
    return t % 10 == 0


PII = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
       ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x.lstrip("0")[:9] or "0") <= 255 for x in m.group().split("."))),
       ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(_digits(m.group())) <= 19 and _luhn(_digits(m.group()))),
       ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(_digits(m.group())) <= 15)]
SECRETS = [("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
            lambda m: len(m.group(2)) >= 6),
           ("access", r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 20), ("hex", r"[0-9a-f]+", lambda m: len(m.group()) >= 24)]


def patterns(t, kinds, by_start):
    found = [[(k, m.start(), m.end()) for m in re.finditer(p, t or "") if ok(m)] for k, p, ok in kinds]
    flat = [x for y in found for x in y]
    if by_start:
        flat.sort(key=lambda x: x[1])
    return (*map(len, found), sha(",".join("%s:%d:%d" % x for x in flat)))
