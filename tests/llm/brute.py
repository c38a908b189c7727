"""Plain Python versions of the operators, for small inputs."""

import re
from collections import Counter

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, pattern=SPACE, lower=True):
    text = text or ""
    return pattern.findall(text.translate(LOWER) if lower else text)


def shingles(text, size=5):
    w = words(text)
    return {tuple(w[i: i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def linked(a, b, share=75):
    both = len(a & b)
    return bool(a) and bool(b) and 100 * both >= share * (len(a) + len(b) - both)


def components(docs, size=5, share=75):
    """Smallest reachable id of each (id, text); equal ids are one node."""
    sets = [(i, shingles(t, size)) for i, t in docs]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i != j and find(i) != find(j) and linked(a, b, share):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i, _ in sets}


def contamination(docs, items, window=10):
    out = []
    grams = {}
    for item, text in items:
        w = words(text, ALNUM)
        if item is not None and w:
            n = min(window, len(w))
            for i in range(len(w) - n + 1):
                grams.setdefault(tuple(w[i: i + n]), set()).add(str(item))
    sizes = {len(g) for g in grams}
    for doc, text in docs:
        w = words(text, ALNUM)
        hit, names = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (found := grams.get(tuple(w[i: i + n]))):
                    hit |= set(range(i, i + n))
                    names |= found
        out.append((doc, len(w), len(hit), sorted(names)))
    return out


def quality(text):
    text = text or ""
    w = words(text, lower=False)
    windows = Counter(tuple(w[i: i + 3]) for i in range(len(w) - 2))
    repeated = {j for i in range(len(w) - 2) if windows[tuple(w[i: i + 3])] > 1 for j in range(i, i + 3)}
    seen, lines = set(), 0
    for line in text.split("\n"):
        if SPACE.search(line):
            lines += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(repeated), failed


def secrets(text):
    text = text or ""
    out = []
    assign = r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for kind, (pattern, group, least) in enumerate([(assign, 2, 12), (r"AKIA[A-Z0-9]+", 0, 18), (r"[0-9a-f]+", 0, 16)]):
        for m in re.finditer(pattern, text):
            if len(m.group(group)) >= least:
                out.append((m.start(), kind, m.end()))
    return [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out)]


def water_level(sizes, weights, share, most):
    """Target of each source by sharing the excess again until none is above its limit."""
    target, total = {}, share * sum(sizes.values())
    open_ = dict(weights)
    while open_:
        unit = (total - sum(target.values())) / sum(open_.values())
        full = [s for s, w in open_.items() if w * unit > most * sizes[s]]
        if not full:
            return target | {s: w * unit for s, w in open_.items()}
        for s in full:
            target[s] = most * sizes[s]
            del open_[s]
    return target
