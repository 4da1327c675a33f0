"""Plain single-machine versions of the operators, for small inputs."""

import re
from collections import Counter

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())


def shingles(text, width):
    w = SPACE.findall(lower(text))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def near_groups(rows, width, percent):
    """Component (smallest id) of every id."""
    sets = {i: shingles(t, width) for i, t in rows}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            k = len(sets[a] & sets[b])
            if k and 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                p, q = find(a), find(b)
                top[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def kept_lines(rows, least=10):
    """Text left of every id (in id order, first copies stay), and whether all its lines went."""
    seen, dead, lines = {}, set(), {}
    for i, t in sorted(rows):
        lines[i] = [x for x in (t or "").split("\n") if x.encode().strip()]
        for p in range(len(lines[i])):
            words = 0
            for m in range(1, len(lines[i]) - p + 1):
                words += len(SPACE.findall(lines[i][p + m - 1].encode()))
                if words >= least:
                    run = tuple(lines[i][p : p + m])
                    if run in seen:
                        dead |= {(i, p + x) for x in range(m)}
                    else:
                        seen[run] = (i, p)
                    break
    out = {}
    for i, t in rows:
        left, p = [], 0
        for x in (t or "").split("\n"):
            if not x.encode().strip():
                left.append(x)
                continue
            if (i, p) not in dead:
                left.append(x)
            p += 1
        out[i] = (None if t is None else "\n".join(left), sum(d[0] == i for d in dead), len(lines[i]))
    return out


def hits(text, items, width=10):
    """Covered word places and items found."""
    w = ALNUM.findall(lower(text))
    places, found = set(), set()
    for item, t in items:
        words = ALNUM.findall(lower(t))
        for i in range(max(1, len(words) - width + 1) if words else 0):
            win = words[i : i + width]
            for p in range(len(w) - len(win) + 1):
                if w[p : p + len(win)] == win:
                    places |= set(range(p, p + len(win)))
                    found.add(item)
    return len(w), places, found


def without_repeats(texts, length):
    """Bytes left of each text when all that a repeated window covers is gone."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[p : p + length] for r in raw for p in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = set()
        for p in range(len(r) - length + 1):
            if seen[r[p : p + length]] > 1:
                gone |= set(range(p, p + length))
        out.append(bytes(b for i, b in enumerate(r) if i not in gone))
    return out
