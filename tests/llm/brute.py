"""Plain Python versions of the operators, for small fixtures."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Groups:
    """Union-find whose root is the smallest member."""

    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def measures(text):
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    inside = set()
    for i in range(len(w) - 2):
        if windows[tuple(w[i : i + 3])] > 1:
            inside |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(w), sum(map(len, w)), symbols, len(lines), len(lines) - len(set(lines)), len(inside)


def failures(m):
    n, chars, symbols, lines, dup, repeat = m
    return (
        (n < 50) + 2 * (100 * repeat > 50 * n) + 4 * (10 * symbols > n) + 8 * (2 * dup > lines)
        + 16 * (chars < 3 * n or chars > 10 * n)
    )


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def near_groups(docs):
    """doc_id -> (set size, smallest doc_id reachable)."""
    sets = {i: shingles(t) for i, t in docs}
    groups, ids = Groups(sets), sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                groups.join(a, b)
    return {i: (len(sets[i]), groups.find(i)) for i in sets}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


_GAP = re.compile(r"[ \t\n\x0b\f\r!-/:-@\[-`{-~]+")


def line_form(line):
    """The normal form of a line: of punctuation alone the line itself, '' is blank."""
    words = " ".join(w for w in _GAP.split(line.lower()) if w)
    return words or line.strip(" \t\n\x0b\f\r")


def within(a, b, most):
    """Whether two strings are at most ``most`` edits apart, in a band of the table."""
    if abs(len(a) - len(b)) > most:
        return False
    far, row = most + 1, {j: j for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            best = min(row.get(j, far) + 1, new.get(j - 1, far) + 1)
            if j:
                best = min(best, row.get(j - 1, far) + (x != b[j - 1]))
            new[j] = best if j or i > most else i
        row = new
        if min(row.values()) > most:
            return False
    return row[len(b)] <= most


def dropped_lines(docs, similarity=0.8):
    """doc_id -> set of dropped line numbers: all pairs of normal forms, by edit similarity alone."""
    lines = [
        (i, k, form) for i, t in docs for k, x in enumerate((t or "").split("\n")) if (form := line_form(x))
    ]
    forms = sorted({x for _, _, x in lines}, key=lambda x: (len(x), x))
    counts = {x: Counter(x) for x in forms}
    groups = Groups(forms)
    for k, a in enumerate(forms):
        for b in forms[k + 1 :]:
            most = int(len(b) * (1 - similarity) + 1e-9)
            if len(b) - len(a) > most:
                break
            # characters of the longer form that the other lacks are edits
            if (counts[b] - counts[a]).total() <= most and within(a, b, most):
                groups.join(a, b)
    first, gone = {}, defaultdict(set)
    for i, k, x in sorted(lines):
        if first.setdefault(groups.find(x), (i, k)) != (i, k):
            gone[i].add(k)
    return gone


def without(text, gone):
    return None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)
