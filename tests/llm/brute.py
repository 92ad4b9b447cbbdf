"""Slow and plain versions of the contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

SPACE = " \t\n\x0b\x0c\r"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NOT_SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lines(rows):
    def key(x):
        return x.strip(SPACE).translate(LOW)

    at = defaultdict(list)
    for d, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 20:
                at[k].append(d)

    def goes(d, x):
        held = at.get(key(x), [])
        known = [h for h in held if h is not None]
        return len(held) >= 3 and (max(known) if known else None) != d

    out = []
    for d, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if not goes(d, x)]
        out.append((d, len(own), len(own) - len(kept), sha("\n".join(kept))))
    return out


def licenses(text):
    w, found = words(text), []
    for phrase, label in {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    return len(w), len(found), min(found)[0] if found else None, max(found)[0] if found else None, ",".join(sorted({x for _, x in found}))


def leaks(rows, items):
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add("" if i is None else str(i))
    out = []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[g]
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def jaccard(rows, threshold=0.8):
    """By place in rows: (least place of its class, links); and the pairs."""
    sets = []
    for _, t in rows:
        w = words(t)
        n = min(5, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set())
    up, links = list(range(len(rows))), Counter()

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [(root(i), links[i]) for i in range(len(rows))]


def secrets(text):
    t, out = text or "", []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    out.sort()
    c = Counter(o[3] for o in out)
    return c["assign"], c["access"], c["hex"], sha(",".join(f"{o[3]}:{o[0]}:{o[2]}" for o in out))


def quality(text):
    t = text or ""
    w = NOT_SPACE.findall(t)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    repeat = set()
    for i in range(len(w) - 4):
        if grams[tuple(w[i : i + 5])] > 1:
            repeat |= set(range(i, i + 5))
    seen, dup = set(), 0
    for x in t.split("\n"):
        if NOT_SPACE.search(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(repeat), len(w) < 10 or 100 * len(repeat) > 20 * len(w)


def records(pages):
    by = defaultdict(list)
    for i, _, h in pages:
        by[h or ""].append(i)
    out = []
    for i, _, h in pages:
        p = (h or "").encode()
        known = [x for x in by[h or ""] if x is not None]
        top = max(known) if known else None
        again = len(p) >= 1000 and top is not None and i != top
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", top if again else None))
    return out
