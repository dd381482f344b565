"""Plain Python versions of the operators, and documents with every odd case."""

import hashlib
import random
import re
from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def odd_documents(seed=3):
    """Null, empty, blank, one-word, copied, nearly copied and long texts, shared passages, ties, null sources and languages."""
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["the", "of", "and", "é", "naïve"]
    text = lambda n: " ".join(r.choices(vocabulary, k=n))
    base, passage = text(150), text(60)
    near = []
    for k in range(12):
        ws = base.split()
        ws[r.randrange(len(ws))] = f"edit{k}"
        near.append(" ".join(ws))
    texts = [None, "", " \n\t ", "one", "one", "a b c d", "A b C d", base, base, base.upper(), *near, passage, text(80) + " " + passage + "\n" + text(80), text(20) + "\n" + passage, text(90), "x" * 700, "é" * 400 + text(30), text(9000), "cc by " * 3 + text(30), "All Rights Reserved. " + text(40) + "\nReleased under the MIT License.\n"]
    return [(k, t, [None, "en", "de"][k % 3], [None, "b", "a", "c"][k % 4], None) for k, t in enumerate(texts)]


def shingles(text):
    w = words(lower(text))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_duplicates(docs):
    sets = {d: shingles(t) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def remove_repeats(docs, length=200):
    raw = {d: (t or "").encode() for d, t in docs}
    counts = Counter(b[i : i + length] for b in raw.values() for i in range(len(b) - length + 1))
    out = {}
    for d, b in raw.items():
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if counts[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out[d] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def repeated_words(text):
    w = words(text)
    grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    n = Counter(grams)
    return len({k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(8)})
