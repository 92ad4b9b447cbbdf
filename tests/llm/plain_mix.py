"""A plain Pareto order in Python, for small tables with distinct ids."""

import hashlib
import math


def plain_mix(rows, weights=(3.0, 1.0, 2.0), share=1.5, most=2, long_words=50):
    """Copies by id of rows (id, source, size)."""
    names = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(n for _, x, n in rows if x == s) for s in names}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    capped, scale = set(), 0.0
    while free := sum(weight[s] for s in names if s not in capped):
        scale = (share * sum(sizes.values()) - sum(most * sizes[s] for s in capped)) / free
        more = {s for s in names if weight[s] * scale >= most * sizes[s]}
        if more == capped:
            break
        capped = more
    copies = {}
    for s in names:
        own = [(i, n) for i, x, n in rows if x == s]
        target = min(weight[s] * scale, most * sizes[s])
        sure = min(math.floor((target / sizes[s] if sizes[s] else 0.0) + 1e-12), most)
        rest = max(target - sure * sizes[s], 0.0)
        heavy = sum(n for _, n in own if n >= long_words)
        light = sizes[s] - heavy
        factor = rest / (2 * heavy + light) if sizes[s] else 0.0
        if 2 * factor > 1 and light:
            factor = (rest - heavy) / light

        def odds(i, n):
            p = min(max(factor * (2 if n >= long_words else 1), 0.0), 1.0)
            u = (int(hashlib.md5(f"mix-1|{i}|{n}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296
            return 0.0 if p >= 1 else 1e300 if p <= 0 else (u / (1 - u)) / (p / (1 - p))

        order = sorted(own, key=lambda r: (odds(*r), *r))
        at, left, gap = 0, [], rest
        extra = set()
        for i, n in order:
            if at + n <= rest:
                extra.add(i)
                gap -= n
            else:
                left.append((i, n))
            at += n
        at = 0
        for i, n in [r for r in left if 0 < r[1] <= gap]:
            if at + n / 2 <= gap:
                extra.add(i)
            at += n
        copies |= {i: min(sure + (rest > 0 and i in extra), most) for i, _ in own}
    return copies
