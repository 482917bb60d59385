"""Brute-force versions the tests compare with."""

import hashlib
import re
import zlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash long, words string, data string, row string"


def documents(spark, rows):
    """A documents table with extra columns whose names clash with internal ones; rows are (doc_id, text, lang)."""
    full = [(i, t, g, "s", None if t is None else len(t), 1, "w", "d", "r") for i, t, g in rows]
    return spark.createDataFrame(full, SCHEMA)


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


def smallest(ids, roots):
    """Smallest non-null id of each row's component."""
    low = {}
    for i, r in zip(ids, roots, strict=True):
        if i is not None:
            low[r] = min(low.get(r, i), i)
    return [low.get(r) for r in roots]


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)])


def jaccard(rows):
    """(doc_id, n_shingles, component_id) of (doc_id, text) rows."""
    sets = [shingles(t) for _, t in rows]
    links = [
        (i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    ]
    ids = [i for i, _ in rows]
    low = smallest(ids, components(len(rows), links))
    return [(i, len(s), c if s else i) for i, s, c in zip(ids, sets, low, strict=True)]


def covered(texts, length=400):
    """One mask per text (bytes): 1 where a string of ``length`` bytes that starts elsewhere too covers the byte."""
    count = {}
    for b in texts:
        for i in range(len(b) - length + 1):
            count[b[i : i + length]] = count.get(b[i : i + length], 0) + 1
    out = []
    for b in texts:
        mask = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                mask[i : i + length] = b"\1" * length
        out.append(bytes(mask))
    return out


def cut(text, mask):
    return bytes(x for x, m in zip(text, mask, strict=True) if not m)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n
