"""Plain rewritings of the contracts, for comparison on small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def raw(t):
    return (t or "").encode()


def substring(docs, k):
    """Sorted (id, n_words, n_removed, kept_sha256)."""
    texts = [(i, raw(t).split()) for i, t in docs]
    count = Counter(tuple(w[j : j + k]) for _, w in texts for j in range(len(w) - k + 1))
    out = []
    for i, w in texts:
        hit = {z for j in range(len(w) - k + 1) if count[tuple(w[j : j + k])] > 1 for z in range(j, j + k)}
        kept = b" ".join(x for z, x in enumerate(w) if z not in hit)
        out.append((i, len(w), len(hit), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def shingles(t, k=5):
    w = raw(t).lower().split()
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def jaccard(docs, num=80, den=100):
    """Sorted (id, n_shingles, component_id, n_links)."""
    sets = [shingles(t) for _, t in docs]
    root, links = list(range(len(sets))), [0] * len(sets)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, x in enumerate(sets):
        for b in range(a):
            y = sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    groups = {}
    for i, (d, _) in enumerate(docs):
        groups.setdefault(find(i), []).append(d)
    least = {g: min((d for d in m if d is not None), default=None) for g, m in groups.items()}
    return sorted([(d, len(sets[i]), least[find(i)], links[i]) for i, (d, _) in enumerate(docs)], key=str)


def contaminated(docs, items, k=8, least=2):
    """Sorted (id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    found = {}
    for i, t in items:
        w = ALNUM.findall(raw(t).lower())
        for x in [tuple(w[j : j + k]) for j in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] if w else []:
            found.setdefault(x, set()).add("" if i is None else str(i))
    sizes, out = {len(x) for x in found}, []
    for d, t in docs:
        w = ALNUM.findall(raw(t).lower())
        hit, names = set(), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in found:
                    names |= found[tuple(w[j : j + n])]
                    hit |= set(range(j, j + n))
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), len(names) >= least))
    return sorted(out, key=str)


def licences(docs, templates):
    """Sorted (id, n_words, n_base, first, last, base labels), and for each the labels of whole templates."""
    out = []
    for d, t in docs:
        w = [x.decode() for x in ALNUM.findall(raw(t).lower())]
        places, base, labels = [], set(), set()
        for x in templates:
            hit = [i for i in range(len(w) - len(x.words) + 1) if w[i : i + len(x.words)] == x.words]
            if hit:
                labels.add(x.label)
                if x.base:
                    places += hit
                    base.add(x.label)
        out.append(((d, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base))), labels))
    return sorted(out, key=lambda x: str(x[0]))


def base_scores(docs):
    """Sorted (id, held_out, n_tokens, n_known, train_tokens, base_score)."""
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    tokens = lambda t: [*raw(t).lower().split(), None]
    count = Counter(w for d, t in docs if not held(d) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    return sorted([(d, held(d), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(t))) for d, t in docs], key=str)


def quality(docs):
    """Sorted (id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed); docs: (id, text)."""
    out = []
    for d, t in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        count = Counter(grams)
        hit = {j for i, g in enumerate(grams) if count[g] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        out.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)))
    return sorted(out, key=str)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
