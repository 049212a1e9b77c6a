"""Plain versions of the operators for small inputs."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, n=5):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1)))


def similar(rows, up=4, down=5):
    """(id, text) rows to {id: (class_id, copy_id, n_links, n_copies)}; ids distinct and not null."""
    by_set = defaultdict(list)
    for i, t in rows:
        by_set[shingles(t)].append(i)
    sets = [s for s in by_set if s]
    where = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            where[x].append(k)
    common = Counter()
    for ks in where.values():
        for a in ks:
            for b in ks:
                if a < b:
                    common[a, b] += 1
    links, parent = Counter(), list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in common.items():
        if down * n >= up * (len(sets[a]) + len(sets[b]) - n):
            links[a] += 1
            links[b] += 1
            parent[find(a)] = find(b)
    least = {}
    for k, s in enumerate(sets):
        r = find(k)
        least[r] = min(least.get(r, math.inf), *by_set[s])
    out = {}
    for k, s in enumerate(sets):
        for i in by_set[s]:
            out[i] = (least[find(k)], min(by_set[s]), links[k], len(by_set[s]))
    for i in by_set.get(frozenset(), []):
        out[i] = (i, i, 0, 1)
    return out


def lm_scores(rows, backoff=0.4):
    """(id, text) rows to {id: (n_tokens, log_score, n_backed_off)} under bigrams of the other rows."""
    texts = [(i, words(t)) for i, t in rows]
    one, two = Counter(), Counter()
    for _, w in texts:
        one.update(w)
        two.update(zip(w, w[1:]))
    whole = sum(one.values())
    out = {}
    for i, w in texts:
        own1, own2 = Counter(w), Counter(zip(w, w[1:]))
        left, total, backed = max(whole - len(w), 1), 0.0, 0
        for k, x in enumerate(w):
            c = one[x] - own1[x]
            s = math.log((c if c > 0 else 0.5) / left)
            if k:
                pair, context = two[w[k - 1], x] - own2[w[k - 1], x], one[w[k - 1]] - own1[w[k - 1]]
                if pair > 0:
                    s = math.log(pair / context)
                else:
                    s += math.log(backoff)
                    backed += 1
            total += s
        out[i] = (len(w), total, backed)
    return out
