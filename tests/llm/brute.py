"""Plain Python versions of the operators' definitions."""

import re


def brute_components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def lower_words(text):
    t = "" if text is None else re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall("[^\x20\x09-\x0d]+", t)


def shingles(text, width):
    w = lower_words(text)
    if not w:
        return set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)}


def jaccard_rows(docs, width, percent):
    """docs: {id: text}; {id: (n_shingles, component)} over all pairs."""
    sets = {i: shingles(t, width) for i, t in docs.items()}
    ids, links = sorted(sets), []
    holders = {}
    for i, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(i)
    from collections import Counter

    for a in ids:
        over = Counter(b for g in sets[a] for b in holders[g] if b > a)
        links += [(a, b) for b, n in over.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    comp = brute_components(ids, links)
    return {i: (len(sets[i]), comp[i]) for i in ids}


def dedup_rows(docs, length):
    """docs: list of (id, text); list of (id, n_bytes, n_removed, n_spans, sha256 of the kept bytes)."""
    import hashlib
    from collections import Counter

    data = [(t or "").encode() for _, t in docs]
    seen = Counter(hash(b[i : i + length]) for b in data for i in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(docs, data):
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[hash(b[k : k + length])] > 1:
                gone[k : k + length] = b"\x01" * length
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def katz_rows(docs, held, min_count=1, top=5):
    """docs: {id: text}, held: set of ids; {id: (n_tokens, n_known, base, score)} and a function P(word | history)."""
    from collections import Counter, defaultdict
    from math import log10

    seqs = {i: [*lower_words(t), "</s>\n"] for i, t in docs.items()}
    uni, bi = Counter(), Counter()
    for i, s in seqs.items():
        if i not in held:
            uni.update(s)
            bi.update(zip(["<s>\n", *s], s))
    n, v = sum(uni.values()), len(uni)
    hist = Counter()
    for (h, _), c in bi.items():
        hist[h] += c
    of = Counter(bi.values())
    a = (top + 1) * of[top + 1] / of[1] if of[1] else 1.0
    d = {}
    for r in range(1, top + 1):
        x = (((r + 1) * of[r + 1] / of[r] if of[r] else 0.0) / r - a) / (1 - a) if a < 1 else 1.0
        d[r] = x if 0 < x <= 1 else 1.0
    low = lambda w: (uni[w] + 1) / (n + v + 1)
    mass, below = defaultdict(float), defaultdict(float)
    for (h, w), c in bi.items():
        if c >= min_count:
            mass[h] += d.get(c, 1.0) * c
            below[h] += low(w)
    all_ = {h: hist[h] + 1 if mass[h] > hist[h] - 1e-6 else hist[h] for h in mass}

    def p(w, h):
        if bi[h, w] >= min_count:
            return d.get(bi[h, w], 1.0) * bi[h, w] / all_[h]
        return low(w) * ((1 - mass[h] / all_[h]) / (1 - below[h]) if h in all_ else 1.0)

    out = {}
    for i, s in seqs.items():
        out[i] = (len(s), sum(uni[w] > 0 for w in s), sum(log10(low(w)) for w in s), sum(log10(p(w, h)) for h, w in zip(["<s>\n", *s], s)))
    return out, p, uni
