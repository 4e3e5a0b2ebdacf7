"""Plain versions of the operators' rules, to compare with on small tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def base_row(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    w = words(text)
    lines, seen = 0, set()
    for line in (text or "").split("\n"):
        if words(line):
            lines += line in seen
            seen.add(line)
    three = Counter(zip(w, w[1:], w[2:], strict=False))
    inside = set()
    for i in range(len(w) - 2):
        if three[tuple(w[i : i + 3])] > 1:
            inside |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), lines, len(inside)


def shingles(text, n=5):
    w = words((text or "").translate(LOW))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def linked(a, b):
    both = len(a & b)
    return bool(a) and bool(b) and 100 * both >= 80 * (len(a) + len(b) - both)


def components(texts: dict):
    """id -> (set size, least id reachable), by all pairs."""
    sets = {i: shingles(t) for i, t in texts.items()}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if linked(sets[i], sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: (len(sets[i]), top(i)) for i in ids}


def letters(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").translate(LOW))


def least_distance(item, text):
    """Edit distance in words between ``item`` and the best run of ``text``."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def spans(text):
    """The base spans (kind, start, end) of a text, found kind by kind."""
    text = text or ""
    found = []
    name = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token"))
    pattern = rf"({name}|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    found += [("assign", m.start(), m.end()) for m in re.finditer(pattern, text) if len(m[2]) >= 8]
    found += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    order = ["assign", "access", "hex"]
    return sorted(found, key=lambda x: (x[1], order.index(x[0])))


def kneser_ney(words_of, order, history, symbol, alphabet, discount):
    """P(symbol | history) by the definition, from a list of padded words."""
    counts = {n: Counter() for n in range(1, order + 1)}
    for w in words_of:
        for i in range(order - 1, len(w)):
            counts[order][w[i - order + 1 : i + 1]] += 1
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])

    def p(history, symbol):
        n = len(history) + 1
        below = 1 / (alphabet + 1) if n == 1 else p(history[1:], symbol)
        same = {g: c for g, c in counts[n].items() if g[:-1] == history}
        total = sum(same.values())
        if not total:
            return below
        d = discount(counts[n])
        return max(same.get(history + symbol, 0) - d, 0) / total + d * len(same) / total * below

    return p(history[-(order - 1) :], symbol)


def discount(counts):
    once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once + 2 * twice else 0.5


def groups(pairs):
    out = defaultdict(set)
    for a, b in pairs:
        out[a].add(b)
    return out
