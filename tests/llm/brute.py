"""Plain versions of the operators, for small inputs."""

import hashlib
import re

WORD = re.compile("[^\x20\x09-\x0d]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def suffix_dedup(docs, window):
    """docs: list of (doc_id, text). Multiset of doc_id, n_bytes, n_removed, n_spans, sha256."""
    seen = {}
    texts = [(d, (t or "").encode()) for d, t in docs]
    for _, b in texts:
        for i in range(len(b) - window + 1):
            seen[b[i:i + window]] = seen.get(b[i:i + window], 0) + 1
    out = []
    for d, b in texts:
        gone = [False] * len(b)
        for i in range(len(b) - window + 1):
            if seen[b[i:i + window]] > 1:
                gone[i:i + window] = [True] * window
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def substring_dedup(docs, window):
    """docs: list of (doc_id, text) in their order."""
    words = [(d, WORD.findall(t or "")) for d, t in docs]
    seen, gone = set(), []
    for _, w in words:
        g = [False] * len(w)
        for i in range(len(w) - window + 1):
            key = tuple(w[i:i + window])
            if key in seen:
                g[i:i + window] = [True] * window
            seen.add(key)
        gone.append(g)
    return [(d, len(w), sum(g), sha(" ".join(x for x, y in zip(w, g) if not y).encode())) for (d, w), g in zip(words, gone)]


def shingles(text, size):
    w = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def jaccard(docs, size, percent):
    """docs: list of (doc_id, text). Multiset of doc_id, n_shingles, component_id."""
    sets = [shingles(t, size) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(docs)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and docs[i][0] is not None and docs[j][0] is not None \
                    and 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), None if d is None else least[find(i)]) for i, ((d, _), s) in enumerate(zip(docs, sets))]


BENCH_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def bench_words(text):
    return BENCH_WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def decontaminate(docs, items, size):
    windows = {}
    for item, text in items:
        w = bench_words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i:i + size]), set()).add(str(item))
    out = []
    for d, text in docs:
        w, hit, found = bench_words(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                ids = windows.get(tuple(w[i:i + k]))
                if ids and len(w[i:i + k]) == k:
                    hit |= set(range(i, i + k))
                    found |= ids
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), bool(hit) and 20 * len(hit) >= len(w)))
    return out


ASSIGN = re.compile("((?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)


def secrets(docs):
    """doc_id, counts and base digest."""
    out = []
    for d, text in docs:
        text, found = text or "", []
        found += [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        spans = ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))
        out.append((d, *(sum(f[1] == i for f in found) for i in range(3)), sha(spans.encode())))
    return out


def targets(sizes, weights=(5, 2, 1), most=3):
    """sizes: {source: words}. Sharing out, capping and resharing until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, total, out = set(sizes), float(sum(sizes.values())), {}
    while left:
        share = {s: total * w[s] / sum(w[x] for x in left) for s in left}
        over = {s for s in left if share[s] > most * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = float(most * sizes[s])
            total -= out[s]
        left -= over
    return out
