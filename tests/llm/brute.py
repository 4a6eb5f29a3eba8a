"""Slow and plain versions of what the queries return, on rows that Python holds."""

import hashlib
import math
import re
import zlib

import numpy as np
import zstandard

WORDS = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(doc_id, n):
    return 0 if doc_id is None else zlib.crc32(str(doc_id).encode()) % n


def sha256(data):
    return hashlib.sha256(data).hexdigest()


def shingles(text):
    w = WORDS.findall((text or "").translate(LOW))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def roots(n, links, names):
    """The least name that can be reached from each of n places."""
    parent = list(range(n))

    def root(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in links:
        parent[root(a)] = root(b)
    least = {}
    for i in range(n):
        if names[i] is not None:
            least[root(i)] = min(least.get(root(i), names[i]), names[i])
    return [least.get(root(i)) for i in range(n)]


def jaccard_links(sets):
    return [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]


def similar(rows):
    """(doc_id, n_shingles, component_id) of rows (doc_id, text); rows without an id are left out."""
    rows = [r for r in rows if r[0] is not None]
    sets = [shingles(t) for _, t in rows]
    names = [d for d, _ in rows]
    return [(d, len(s), c) for d, s, c in zip(names, sets, roots(len(rows), jaccard_links(sets), names), strict=True)]


def near_vectors(rows):
    """(vec_id, n_links, component_id, kept) of rows (vec_id, label, embedding)."""
    ok = [i for i, (_, label, v) in enumerate(rows) if label is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)]
    unit = {i: np.array(rows[i][2], np.float64) / np.linalg.norm(np.array(rows[i][2], np.float64)) for i in ok}
    links = [(a, b) for a in ok for b in ok if b < a and rows[a][1] == rows[b][1] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98]
    n = [0] * len(rows)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    names = [r[0] for r in rows]
    return [(d, k, c, d is not None and d == c) for d, k, c in zip(names, n, roots(len(rows), links, names), strict=True)]


def language(model, text):
    """(prediction, score): all segmentations of each word are summed by a plain forward pass."""
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    index = {p: i for i, p in enumerate(model.pieces)}
    logs = np.log(model.probabilities)
    words = re.findall("[^\x20\x09-\x0d]+", text.lower())
    total = np.zeros(len(model.names))
    for word in words:
        s = "▁" + word
        alpha = [np.zeros(len(model.names))]
        for j in range(1, len(s) + 1):
            ways = []
            for i in range(max(0, j - 16), j):
                piece = index.get(s[i:j], -1 if j - i == 1 else None)
                if piece is not None:
                    ways.append(alpha[i] + logs[piece])
            alpha.append(np.logaddexp.reduce(ways, axis=0) if ways else np.full(len(model.names), -np.inf))
        total += alpha[-1]
    z = total / len(words) * math.sqrt(len(words)) * model.sharpness
    p = np.exp(z - z.max())
    p /= p.sum()
    return model.names[int(p.argmax())], float(p.max())


def quality(model, text):
    data = (text or "").encode()
    sizes = []
    for d in (model.bad, model.good):
        packer = zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False)
        sizes.append(sum(len(packer.compress(data[i : i + 2048])) for i in range(0, len(data), 2048)))
    x = (sizes[0] - sizes[1]) / max(len(data), 1)
    return 1 / (1 + math.exp(-min(30.0, max(-30.0, model.slope * x + model.intercept))))


def mixed(rows, plan_of, orders_of, rule):
    """(doc_id, source, tokens, pass, block) of rows (doc_id, source, hash, tokens, name), taken one after another."""
    by_source = {}
    for row in rows:
        by_source.setdefault(row[4], []).append(row)
    names = sorted(by_source)
    plan = plan_of([float(sum(r[3] for r in by_source[n])) for n in names])
    out = []
    for name, weight, passes in zip(names, plan.weights, [max(p, 1.0) for p in plan.passes], strict=True):
        own = by_source[name]
        total = sum(r[3] for r in own)
        blocks = max(1, -(-total // rule.block_tokens))
        whole, spend = int(passes), (passes - int(passes)) * total
        taken = [(r, p) for p in range(whole) for r in own]
        factor, shift = orders_of(name, whole + 1, blocks, rule.seed)[whole]
        spent, last = 0, None
        for r in sorted(own, key=lambda r: ((r[2] % blocks * factor + shift) % blocks, r[2], r[0] is not None, r[0])):
            place = (r[2] % blocks * factor + shift) % blocks
            if spent < spend or (place, r[2]) == last:
                taken.append((r, whole))
                last = (place, r[2])
            spent += r[3]
        out += [(r[0], r[1], r[3], round(weight, 9), p, r[2] % blocks) for r, p in taken]
    return out
