"""Plain versions of the operators, for small inputs."""

import collections
import hashlib
import math
import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def strip(rows, length=100):
    """(doc_id, text) -> (n_bytes, n_removed, n_spans, kept_sha256); texts of one doc_id go by their hashes."""
    seen, out = set(), {}
    code = lambda b: (xxhash.xxh64(b, seed=42).intdigest() + 2**63) % 2**64
    for doc_id, text in sorted({(r[0], r[1] or "") for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0, code(r[1].encode()))):
        b = text.encode()
        mark = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                mark[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, m in zip(b, mark, strict=True) if not m)
        runs = sum(1 for k in range(len(b)) if mark[k] and (k == 0 or not mark[k - 1]))
        out[doc_id, text] = (len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest())
    return out


def shingles(text):
    w = WORD.findall(text or "")
    k = min(5, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if k else frozenset()


def near(rows):
    """One (class, links) for each of the rows (doc_id, text), in their order."""
    sets = [shingles(r[1]) for r in rows]
    low = lambda i: -(2**63) if rows[i][0] is None else rows[i][0]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    for i, s in enumerate(sets):
        for j, n in collections.Counter(j for x in s for j in where[x] if j > i).items():
            if n * 9 >= 4 * (len(s) + len(sets[j])):
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)), key=lambda k: (low(k), k))
                parent[b] = a
    least = {}
    for i in range(len(rows)):
        r = find(i)
        least[r] = min(least.get(r, low(i)), low(i))
    back = lambda v: None if v == -(2**63) else v
    return [(back(least[find(i)]), links[i]) for i in range(len(rows))]


def squeeze(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def copies(rows):
    """One (keep_id, group_size, kept, sha) for each row, in order."""
    key = lambda r: (-len(r[1] or ""), r[0] is not None, r[0] or 0)
    groups = collections.defaultdict(list)
    for r in rows:
        groups[squeeze(r[1])].append(r)
    best = {k: min(g, key=key) for k, g in groups.items()}
    out = []
    for r in rows:
        s = squeeze(r[1])
        b = best[s]
        out.append((b[0], len(groups[s]), r[0] == b[0] and len(r[1] or "") == len(b[1] or ""), hashlib.sha256(s.encode()).hexdigest()))
    return out


def targets(sizes):
    """source -> target, by resharing what is above the cap until nothing is."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
            open_.discard(s)
        left = 1.5 * sum(sizes.values()) - sum(out.values())
    return out


def counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(tri)
    covered = {p + k for p, t in enumerate(tri) if n[t] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


class PlainFTRL:
    """Follow the regularised leader over dictionaries, one feature at a time."""

    def __init__(self, alpha, beta, l1, l2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(self, f):
        z, n = self.z[f], self.n[f]
        return 0.0 if abs(z) <= self.l1 else -(z - math.copysign(self.l1, z)) / ((self.beta + math.sqrt(n)) / self.alpha + self.l2)

    def update(self, gradient):
        for f, (g, w) in {f: (g, self.weight(f)) for f, g in gradient.items()}.items():
            self.z[f] += g - (math.sqrt(self.n[f] + g * g) - math.sqrt(self.n[f])) / self.alpha * w
            self.n[f] += g * g


def logistic(z):
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))


def quality_features(text, model):
    """feature -> value, counted word by word."""
    words, out = text.split(), collections.defaultdict(float)
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    if not words:
        return {model.code("=", "empty"): 1.0}
    codes = [(model.code("w", w.lower()), model.code("s", model.shape(w))) for w in words]
    mask, pairs = (1 << model.BITS) - 1, max(1, len(words) - 1)
    for a, b in codes:
        out[a] += model.SCALE / len(words)
        out[b] += model.SCALE / len(words)
    for (a, s), (b, t) in zip(codes, codes[1:], strict=False):
        out[model.code("=", "repeat") if a == b else (s * 40503 + t * 9176 + 77) & mask] += model.SCALE / pairs
        out[(a * 69069 + b * 30011 + 7) & mask] += model.SCALE / pairs
    out[model.code("=", "line")] += model.SCALE * (1 - len(set(lines)) / len(lines))
    out[model.code("=", "lines")] += model.SCALE * len(lines) / len(words)
    return out


def quality_weights(rows, model):
    """feature -> weight, 'bias' too."""
    examples = [(quality_features(t, model), y) for t, y in rows]
    ftrl, order = PlainFTRL(0.3, 1.0, 0.2, 0.5), np.random.default_rng(5)
    for _ in range(model.EPOCHS):
        for i in order.permutation(len(examples)):
            x, y = examples[i]
            x = {**x, "bias": 1.0}
            slope = logistic(sum(ftrl.weight(f) * v for f, v in x.items())) - y
            ftrl.update({f: slope * v for f, v in x.items()})
    return {f: ftrl.weight(f) for f in list(ftrl.z)}


def toxic_features(words, model):
    return {c for w in words for c in model.codes(w)}


def toxic_weights(rows, model):
    """feature -> weight that is not 0; -1 is the intercept."""
    examples = []
    for text, y in rows:
        words = set(re.findall(r"\w+", text.lower()))
        terms = {t: kind[(kind.index(t) + 1) % len(kind)] for kind in model.IDENTITY_TERMS for t in kind}
        other = {terms.get(w, w) for w in words} if words & terms.keys() else None
        examples.append((toxic_features(words, model) | {-1}, None if other is None else toxic_features(other, model) | {-1}, y))
    ftrl, order = PlainFTRL(0.25, 1.0, model.L1, 0.1), np.random.default_rng(5)
    for _ in range(model.EPOCHS):
        for i in order.permutation(len(examples)):
            x, other, y = examples[i]
            slope = logistic(sum(map(ftrl.weight, x))) - y
            gap = 0.0 if other is None else sum(map(ftrl.weight, x)) - sum(map(ftrl.weight, other))
            side = {f: (f in x) - (f in other) for f in x | other} if other is not None else dict.fromkeys(x, 0)
            ftrl.update({f: slope * (f in x) + 2.0 * model.CF_PENALTY * gap * d for f, d in side.items()})
    return {f: w for f in list(ftrl.z) if (w := ftrl.weight(f)) or f == -1}
