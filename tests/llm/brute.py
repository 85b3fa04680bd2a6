"""Plain versions of the operators, for small fixtures."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def shingles(text, size):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1)))


def components(ids, linked):
    """id → smallest id that links reach."""
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def jaccard_components(texts, size=4, percent=85):
    sets = {i: shingles(t, size) for i, t in texts.items()}
    ids = sorted(sets)
    linked = [
        (a, b)
        for k, a in enumerate(ids)
        for b in ids[:k]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    return components(ids, linked), {i: len(s) for i, s in sets.items()}


def table_text(rows):
    """Rows of (text, columns, rows spanned) cells: laid out on a grid of squares, then padded."""
    taken, cells = set(), []
    for r, row in enumerate(rows):
        c = 0
        for text, span, down in row:
            while (r, c) in taken:
                c += 1
            taken |= {(r + i, c + k) for i in range(down) for k in range(span)}
            cells.append((r, c, text, span))
            c += span
    columns = 1 + max((c + span - 1 for _, c, _, span in cells), default=0)
    width = [max([len(t) for _, c, t, span in cells if span == 1 and c == k], default=0) for k in range(columns)]
    out = []
    for r in range(len(rows)):
        here = {c: (t, span) for q, c, t, span in cells if q == r}
        line, c = [], 0
        while c <= max(here, default=-1):
            t, span = here.get(c, ("", 1))
            line.append(t.ljust(sum(width[c : c + span]) + 3 * (span - 1)))
            c += span
        out.append(" | ".join(line).rstrip())
    return [x for x in out if x.strip(" |")]


def list_text(items, depth=0):
    """Nested lists (start, reversed, [(value, text, list below or None)]) as lines; start None and no order: bullets."""
    order, start, back, entries = items
    number = start if start is not None else (len(entries) if back else 1)
    out = []
    for value, text, below in entries:
        number = value if value is not None and order else number
        mark = f"{number}. " if order else "- "
        number += -1 if back else 1
        inner = [text] + (list_text(below) if below else [])
        out += [mark + inner[0]] + [" " * len(mark) + x for x in inner[1:]]
    return out


def kneser_ney(texts, order, discount, alphabet):
    """Interpolated Kneser-Ney over letters: the probability of an n-gram's last letter after the others."""
    counts = {order: Counter()}
    for text in texts:
        padded = " " * (order - 1) + text
        counts[order].update(padded[j : j + order] for j in range(len(text)))
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(gram[1:] for gram in counts[n + 1])

    def p(gram):
        if not gram:
            return 1 / alphabet
        after = {g: c for g, c in counts[len(gram)].items() if g[:-1] == gram[:-1]}
        if not after:
            return p(gram[1:])
        total = sum(after.values())
        return max(after.get(gram, 0) - discount, 0) / total + discount * len(after) / total * p(gram[1:])

    return p
