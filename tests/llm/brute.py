"""Plain Python versions of the operators' contracts, for small tables."""

import hashlib
import re
from collections import Counter

BLANKS = re.compile(rb"[\x20\x09-\x0D]+")
BREAKS = re.compile("[\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def sha256(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def blank_words(text):
    return [w.decode() for w in BLANKS.split((text or "").encode()) if w]


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def plain_words(text):
    return [w for w in BREAKS.split(lower(text)) if w]


def quality(text):
    w = blank_words(text)
    t = text or ""
    lines = [x for x in t.split("\n") if blank_words(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = Counter(grams)
    hit = {i + j for i, g in enumerate(grams) if twice[g] > 1 for j in range(3)}
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), failed


def hits(documents, benchmark):
    """documents, benchmark: (id, text) rows; one tuple a document."""
    windows = {}
    for item, text in benchmark:
        w = plain_words(text)
        for i in range(max(len(w) - 13, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in documents:
        w = plain_words(text)
        hit, items = set(), set()
        for s in sizes:
            for i in range(len(w) - s + 1):
                if found := windows.get(tuple(w[i : i + s])):
                    hit |= set(range(i, i + s))
                    items |= found
        names = sorted(str(x) for x in items)
        out.append((doc, len(w), len(hit), len(names), sha256(",".join(names)), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def licenses(text):
    w = plain_words(text)
    labels, places = [], []
    for phrase, label in (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")):
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        places += at
        labels += [label] if at else []
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def url(u, rules=(("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))):
    host = path = ""
    if u and "://" in u:
        m = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1])
        host, path = lower(m[1]), m[2]
    fits = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda x: len(x[0]), default=(None, None))
    return host, path, *best


def passages(documents):
    """(doc_id, text) rows with distinct ids; words covered by a 13-word window that starts in a smaller doc_id go."""
    first = {}
    for doc, text in documents:
        w = blank_words(text)
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            first[k] = min(first.get(k, doc), doc)
    out = []
    for doc, text in documents:
        w = blank_words(text)
        gone = {i + j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < doc for j in range(13)}
        out.append((doc, len(w), len(gone), sha256(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def substrings(documents, size=400):
    seen = Counter(t[i : i + size] for _, x in documents for t in [(x or "").encode()] for i in range(len(t) - size + 1))
    out = []
    for doc, x in documents:
        t = (x or "").encode()
        gone = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(t), sum(gone), spans, sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g))))
    return out


def shingles(text):
    w = blank_words(lower(text))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 5, 0) + 1)} if w else set()


def near_groups(documents):
    sets = {d: shingles(t) for d, t in documents}
    holders = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, set()).add(d)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d, s in sets.items():
        for e, n in Counter(e for x in s for e in holders[x] if e > d).items():
            if 100 * n >= 75 * (len(s) + len(sets[e]) - n):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return [(d, len(s), find(d), find(d) == d) for d, s in sets.items()]
