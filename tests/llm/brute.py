"""Plain Python forms of the operators, to hold the Spark forms against."""

import hashlib
import re

import numpy as np
import xxhash

UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SPACED, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text, pattern=SPACED):
    return pattern.findall((text or "").translate(UPPER))


def fingerprint(text):
    w = words(text)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reachable(ids, linked):
    """The smallest id reachable from each place."""
    label = list(range(len(ids)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                label[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[top(i)] = min(least.get(top(i), x), x)
    return [least.get(top(i)) for i in range(len(ids))]


def near_lines(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def dedup_lines(rows, least=6):
    """{(doc_id, text): new text}; rows of the same id and text are one."""
    rows = sorted({(i, t) for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    first, places = {}, []
    for r, (_, text) in enumerate(rows):
        for at, line in enumerate((text or "").split("\n")):
            if w := tuple(words(line)):
                first.setdefault(w, (r, at))
                places.append((w, (r, at)))
    long = [w for w in first if len(w) >= least]
    near = {a for a in long for b in long if first[b] < first[a] and near_lines(a, b)}
    gone = {p for w, p in places if w in near or first[w] < p}
    return {(i, t): None if t is None else "\n".join(x for at, x in enumerate(t.split("\n")) if (r, at) not in gone) for r, (i, t) in enumerate(rows)}


def shingles(text, k=5):
    w = words(text, ALNUM)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def contained(text, item, share=0.8):
    s = shingles(item)
    return bool(s) and len(s & shingles(text)) >= share * len(s) - 1e-9


def mixed(rows, most=3, seed="mix-1"):
    """{doc_id: (size, target, taken)} for rows of (doc_id, text, source)."""
    size = [len(words(t)) for _, t, _ in rows]
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(sources)}
    total = {s: sum(n for n, r in zip(size, rows, strict=True) if r[2] == s) for s in sources}
    target, open_ = {}, set(sources)
    while True:  # reshare until none is above its cap
        left = sum(total.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > most * total[s] + 1e-9}
        if not full:
            target |= share
            break
        target |= {s: float(most * total[s]) for s in full}
        open_ -= full
    out = []
    for n, (i, _, s) in zip(size, rows, strict=True):
        rate = target[s] / total[s] if total[s] else 0.0
        u = int(hashlib.md5(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16) / 2**32
        out.append((i, n, target[s], n * (int(rate) + (u < rate - int(rate)))))
    return out


def cosines(vectors):
    x = np.array(vectors, float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x @ x.T
