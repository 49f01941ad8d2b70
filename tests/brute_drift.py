"""Plain single-machine version of the drift report, for comparison."""

import json
from collections import Counter, defaultdict


def walk(found, head=()):
    for k, v in found.items():
        if isinstance(v, dict):
            yield from walk(v, (*head, k))
        elif v is not None:
            yield ".".join((*head, k)), v


def report(lines, files):
    """lines: (feed, file, event, attrs); files: (file, feed, period_start). Rows as p1_found has them."""
    content = defaultdict(list)
    for feed, file, event, attrs in lines:
        try:
            found = json.loads(attrs)
        except (TypeError, ValueError):
            found = None
        content[feed, file].append((event, dict(walk(found)) if isinstance(found, dict) else {}))
    name = lambda v: {bool: 2, list: 3, str: 1}.get(type(v), 0)
    out, before = set(), {}
    for file, feed, _ in sorted(files, key=lambda x: x[2]):
        if (feed, file) not in content:
            continue
        now = content[feed, file]
        types = defaultdict(Counter)
        for _, flat in now:
            for p, v in flat.items():
                types[p][name(v)] += 1
        kinds = {p: min(c, key=lambda k: (-c[k], k)) for p, c in types.items()}
        if feed in before:
            old_kinds, old = before[feed]
            gone, new = set(old_kinds) - set(kinds), set(kinds) - set(old_kinds)
            used = set()
            for g in gone:
                for n in new:
                    pairs = [(a[g], b[n]) for e, a in old for f, b in now if e is not None and e == f and g in a and n in b]
                    if pairs and all(a == b and type(a) is type(b) for a, b in pairs):
                        out.add((feed, file, "renamed", n, g))
                        used |= {g, n}
            out |= {(feed, file, "added", p, p) for p in new - used} | {(feed, file, "removed", p, p) for p in gone - used}
            out |= {(feed, file, "retyped", p, p) for p in set(kinds) & set(old_kinds) if kinds[p] != old_kinds[p]}
        before[feed] = kinds, now
    return out
