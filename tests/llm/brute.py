"""The operators' results by the plainest code, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

LEAST = -(1 << 63)


def in_order(rows):
    """Places of (doc_id, text) rows by id (null first), then place."""
    return sorted(range(len(rows)), key=lambda i: (LEAST if rows[i][0] is None else rows[i][0], i))


def removed_words(rows, m=20):
    """For each row, a flag for each word: covered by a window that began earlier."""
    seen, out = set(), [None] * len(rows)
    for i in in_order(rows):
        words = (rows[i][1] or "").encode().split()
        flags = [False] * len(words)
        for s in range(len(words) - m + 1):
            window = tuple(words[s : s + m])
            if window in seen:
                flags[s : s + m] = [True] * m
            seen.add(window)
        out[i] = flags
    return out


def substring_digest(rows, m=20):
    out = []
    for (doc_id, text), flags in zip(rows, removed_words(rows, m)):
        words = (text or "").encode().split()
        kept = b" ".join(w for w, gone in zip(words, flags) if not gone)
        out.append((doc_id, len(words), sum(flags), hashlib.sha256(kept).hexdigest()))
    return out


def cut_text(text, flags):
    """The text without flagged words and the white space behind them."""
    at = 0

    def keep(match):
        nonlocal at
        at += 1
        return b"" if flags[at - 1] else match[0]

    return re.sub(rb"[^ \t-\r]+[ \t-\r]*", keep, text.encode()).decode()


def gram_set(text, n=5):
    words = (text or "").encode().split()
    if len(words) < n:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def near_duplicates(rows, threshold=0.8):
    """(doc_id, class id, links, copies, grams) of each row, and its class as a number."""
    sets = [gram_set(text) for _, text in rows]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        holders[s or ("empty", i)].append(i)
    kinds = list(holders)
    inverted = defaultdict(list)
    for k, kind in enumerate(kinds):
        for gram in kind if isinstance(kind, frozenset) else ():
            inverted[gram].append(k)
    parent = list(range(len(kinds)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    links = Counter()
    for k, kind in enumerate(kinds):
        if isinstance(kind, frozenset):
            for j, n in Counter(j for g in kind for j in inverted[g] if j > k).items():
                if n >= threshold * (len(kind) + len(kinds[j]) - n) - 1e-9:
                    links[k] += 1
                    links[j] += 1
                    parent[root(k)] = root(j)
    of, least = {}, {}
    for k, kind in enumerate(kinds):
        for i in holders[kind]:
            of[i] = k
            least[root(k)] = min(least.get(root(k), (True, 0, 0)), (rows[i][0] is None, rows[i][0] or 0, i))
    out = []
    for i, (doc_id, _) in enumerate(rows):
        none, class_id, _ = least[root(of[i])]
        out.append((doc_id, None if none else class_id, links[of[i]], len(holders[kinds[of[i]]]), len(sets[i])))
    return out, [least[root(of[i])][2] == i for i in range(len(rows))]


def contained(text, items, n=5, threshold=0.8):
    """Whether a text holds an item."""

    def words_of(t):
        return [w.decode() for w in (t or "").lower().encode().split()]

    def cut(words, n):
        return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}

    own = words_of(text)
    wanted = [(cut(w, k), k) for w in map(words_of, items) if (k := min(n, len(w)))]
    return any(len(cut(own, k) & g) >= threshold * len(g) - 1e-9 for g, k in wanted)
