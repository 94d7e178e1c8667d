"""Small corpora with the awkward cases every operator must handle, and plain reference computations."""

import random
import re
import zlib
from collections import Counter, defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h1 string, id long, key string, n long, bucket string, word string, slot string"


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def texts(seed=0):
    """doc_id, text pairs: null and empty texts, short, long, repeated and near copies, shared passages, odd characters."""
    rng = random.Random(seed)
    base = words(rng, 120)
    near = list(base)
    near[60] = "CHANGED"
    passage = words(rng, 60, 5000)
    out = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (6, " ".join(base)), (7, " ".join(base)), (8, " ".join(near)),
        (9, " ".join(words(rng, 40) + passage + words(rng, 40))), (10, " ".join(words(rng, 10) + passage)), (11, " ".join(words(rng, 3000, 50000))),
        (12, "a " * 200), (13, "été\x1cÉTÉ naïve ☃ x \x0b tab\tend"), (14, "two words"), (15, "TWO Words"), (16, "\n".join(" ".join(words(rng, 12)) for _ in range(8))),
        (17, " ".join(passage[:34])), (18, " ".join(passage[:35])), (None, " ".join(base)), (None, "lonely text here"), (20, " ".join(words(rng, 80))), (20, " ".join(words(rng, 80))),
        (21, " ".join(words(rng, 50))), (21, None),
    ]
    out[-1] = out[-2]  # a repeated row
    return out


def table(spark, rows):
    """A documents table with extra columns whose names clash with those used inside."""
    full = [(i, t, "en", None if n % 7 == 0 else f"s{n % 3}", None if t is None else len(t), "x", 5, None, n, "b", "w", "s") for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text, lower=False):
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


def bucket(doc_id, modulus):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % modulus


def repeats(rows, span):
    """Per row (words, removed, kept text) by comparing all windows."""
    counts = Counter()
    for _, t in rows:
        w = split(t)
        counts.update(tuple(w[i : i + span]) for i in range(len(w) - span + 1))
    out = []
    for _, t in rows:
        w = split(t)
        gone = set()
        for i in range(len(w) - span + 1):
            if counts[tuple(w[i : i + span])] > 1:
                gone.update(range(i, i + span))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def shingles(text, k):
    w = split(text, lower=True)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def near_components(rows, k, percent=80):
    """Nodes are ids (rows with the same id are one node); rows of a null id are nodes of their own text."""
    node = [("id", i) if i is not None else ("text", t) for i, t in rows]
    sets = [shingles(t, k) for _, t in rows]
    root = {n: n for n in node}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(node[i]), find(node[j])), key=repr)
                root[y] = x
    groups = defaultdict(list)
    for n in set(node):
        groups[find(n)].append(n)
    best = {n: min((v for kind, v in g if kind == "id"), default=None) for g in groups.values() for n in g}
    return [(len(s), best[n]) for s, n in zip(sets, node)]


_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def leaked(rows, items, size=10):
    """Per row (words, hit words, sorted item ids as text)."""
    windows = defaultdict(set)
    for i, t in items:
        w = _WORD.findall((t or "").translate(_LOW))
        if w:
            m = min(size, len(w))
            for s in range(len(w) - m + 1):
                windows[tuple(w[s : s + m])].add(str(i))
    out = []
    for _, t in rows:
        w, hit, found = _WORD.findall((t or "").translate(_LOW)), set(), set()
        for m in {len(x) for x in windows}:
            for s in range(len(w) - m + 1):
                ids = windows.get(tuple(w[s : s + m]))
                if ids:
                    hit.update(range(s, s + m))
                    found |= ids
        out.append((len(w), len(hit), sorted(found)))
    return out
