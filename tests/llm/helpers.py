"""Plain Python versions of what the operators compute, and rows that hold every odd case."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, width=5):
    w = words(text)
    return frozenset([tuple(w)] if 0 < len(w) < width else [tuple(w[i:i + width]) for i in range(len(w) - width + 1)])


def components(nodes, links):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def near_duplicates(rows):
    """{doc_id: (set size, component)} by comparing every pair that shares a shingle."""
    sets = {i: shingles(t) for i, t in rows}
    holders, links = defaultdict(list), []
    for i in sorted(sets):
        shared = Counter(j for g in sets[i] for j in holders[g])
        links += [(i, j) for j, n in shared.items() if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n)]
        for g in sets[i]:
            holders[g].append(i)
    found = components(sets, links)
    return {i: (len(s), found[i]) for i, s in sets.items()}


def prose(n, start=0):
    return " ".join(f"w{(start + i) * 7919 % 5003}" for i in range(n))


def odd_documents():
    """Nulls in every column, empty, blank and long texts, ties, repeated rows."""
    long = prose(60_000)
    return [
        (1, prose(80), "en", "a", 1), (2, prose(80), "en", "a", 1), (2, prose(80), "en", "a", 1), (3, None, None, None, None),
        (4, "", "en", "b", 0), (5, " \t\r\n ", "en", "b", 4), (None, prose(30, 500), "en", "b", 9), (None, None, None, None, None),
        (6, "two words", "en", None, 9), (7, "Two WORDS", "en", None, 9), (8, long, "en", "c", len(long)), (9, long + " end", "en", "c", 1),
        (10, "é ü 漢字 " * 40, "fr", "c", 1), (11, "a\n\n\nb\n", "en", "a", 5),
    ]
