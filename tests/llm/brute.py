"""Plain versions of the operators that SQL cannot express, for small tables."""

import collections
import hashlib
import re

BLANK = "[^\x20\x09-\x0d]+"


def words(text, lower=False):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "") if lower else text or ""
    return re.findall(BLANK, text)


def near_duplicates(rows, n, percent):
    """id -> (set size, smallest id reachable)."""
    sets = {}
    for i, text in rows:
        w = words(text, lower=True)
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def remove_repeats(rows, span):
    """One (words, removed, digest of the kept words) per row."""
    texts = [words(t) for _, t in rows]
    seen = collections.Counter(tuple(w[k : k + span]) for w in texts for k in range(len(w) - span + 1))
    out = []
    for w in texts:
        gone = [False] * len(w)
        for k in range(len(w) - span + 1):
            if seen[tuple(w[k : k + span])] > 1:
                gone[k : k + span] = [True] * span
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def quality_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = words(text)
    grams = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)
