"""Plain versions of what the operators compute, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

import regex

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def near_classes(rows, threshold=0.8):
    """Links and class (smallest id of the connected component) of each document; ids must be distinct."""
    sets, inverted = {}, defaultdict(list)
    for i, text in rows:
        w = WORD.findall(text or "")
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
        for s in sets[i]:
            inverted[s].append(i)
    same = defaultdict(list)
    for i, text in rows:
        if text is not None:
            same[text].append(i)
    pairs = {(a, b) for own in inverted.values() for k, b in enumerate(own) for a in own[:k]}
    linked = {(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}
    linked |= {(a, b) for own in same.values() for k, b in enumerate(own) for a in own[:k]}
    links, up = Counter({i: 0 for i, _ in rows}), {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in linked:
        links[a] += 1
        links[b] += 1
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return links, {i: root(i) for i, _ in rows}


def deduplicated(rows, window=20):
    """doc_id, n_words, n_removed, sha256 of the kept words."""
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: r[0]):
        w, gone = WORD.findall(text or ""), set()
        for k in range(len(w) - window + 1):
            own = tuple(w[k : k + window])
            if own in seen:
                gone.update(range(k, k + window))
            seen.add(own)
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return out


def contaminated(rows, items, threshold=0.8):
    """Best weighted similarity of any window of each item's size, where it reaches the threshold."""

    def words(t):
        return regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())

    out = {}
    docs = [(i, words(t)) for i, t in rows]
    for item, text in items:
        w = words(text)
        if not w:
            continue
        k = min(5, len(w))
        wanted = Counter(tuple(w[a : a + k]) for a in range(len(w) - k + 1))
        for i, v in docs:
            runs = [tuple(v[a : a + k]) for a in range(len(v) - k + 1)]
            if not any(r in wanted for r in runs):
                continue
            for start in range(max(1, len(v) - len(w) + 1)):
                own = Counter(runs[start : start + len(w) - k + 1])
                both = sum((wanted & own).values())
                s = both / (sum(wanted.values()) + sum(own.values()) - both)
                if s >= threshold:
                    out[i, item] = max(out.get((i, item), 0), s)
    return out


def deduplicated_texts(rows, window=20):
    """id and text of the documents that keep a word or lose none; texts change only where words go."""
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: r[0]):
        w, gone = WORD.findall(text or ""), set()
        for k in range(len(w) - window + 1):
            own = tuple(w[k : k + window])
            if own in seen:
                gone.update(range(k, k + window))
            seen.add(own)
        if not gone or len(gone) < len(w):
            out.append((i, " ".join(x for k, x in enumerate(w) if k not in gone) if gone else text))
    return out


def language(text, model):
    """Language, score and whether the text is rejected, from the model's tables, subword by subword."""
    import math

    from millrace.llm.langid import ORDERS, PRIOR, SCALE

    letters = "".join(c.lower()[0] if c.isalpha() else " " for c in text or "")
    sums, usual, count = [0] * len(model.langs), 0, 0
    for word in letters.split():
        padded = [ord(c) for c in f" {word} "]
        for n in ORDERS:
            for at in range(len(padded) - n + 1):
                h = 0
                for c in padded[at : at + n]:
                    h = (h * 0x9E3779B1 + c) % 2**64
                bucket = h * (0xD6E8FEB86659FD93 + 2 * n) % 2**64 >> (64 - model.settings.bits)
                sums = [s + int(x) for s, x in zip(sums, model.scores[bucket])]
                usual += int(model.usual[bucket])
                count += 1
    if not count:
        return None, 0.0, True
    z = [s / (count * SCALE * model.temperature) * count / (count + PRIOR) for s in sums]
    e = [math.exp(x - max(z)) for x in z]
    top = max(e) / sum(e)
    known = (usual / SCALE + PRIOR * model.mean) / (count + PRIOR)
    return model.langs[e.index(max(e))], round(top, 6), round(top, 6) < model.threshold or known < model.least


def best_fit_rows(sizes, capacity):
    """How full each row is when pieces are packed best fit decreasing, by a look at every open row."""
    used = []
    pieces = [min(capacity, n - x) for n in sizes for x in range(0, n, capacity)]
    for p in sorted(pieces, reverse=True):
        fits = [u for u in used if u + p <= capacity]
        if fits:
            used.remove(max(fits))
        used.append(max(fits, default=0) + p)
    return sorted(used)


def best_products(rows, queries, k=5):
    """query_id, rank, vec_id, score over integer vectors."""
    out = []
    for q in queries:
        own = next(v for i, v in rows if i == q)
        scored = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in rows if i != q and len(v) == len(own))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out
