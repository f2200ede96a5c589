"""Plain restatements of the contracts, one document (or pair) at a time."""

import hashlib
import re


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingle_set(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def near_duplicates(rows, size, percent):
    """{id: (n, component)}; rows are (id, text)."""
    sets = {i: shingle_set(t, size) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    pairs = {(a, b) for h in holders.values() for k, a in enumerate(h) for b in h[:k]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def contamination(text, items, window=10):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = re.findall(pattern, lower(text or ""))
    hit, found = set(), set()
    places = {}
    for i, w in enumerate(words):
        places.setdefault(w, []).append(i)
    for item, t in items:
        own = re.findall(pattern, lower(t or ""))
        if item is None or not own:
            continue
        for k in range(max(1, len(own) - window + 1)):
            part = own[k : k + window]
            for p in places.get(part[0], []):
                if words[p : p + len(part)] == part:
                    hit |= set(range(p, p + len(part)))
                    found.add(str(item))
    return len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)


def _luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    """{kind: [(start, end)]}"""
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and _luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    }
    return {k: [m.span() for m in re.finditer(p, text or "") if ok(m[0])] for k, (p, ok) in kinds.items()}


def spans_text(spans):
    return ",".join(f"{k}:{a}:{b}" for k, found in spans.items() for a, b in found)


def template_lines(rows, min_docs=3, min_tokens=3, long_tokens=20, share=0.8, depth=3):
    """{id: places dropped} of (id, text) rows with distinct ids, by the tree in one process."""
    import math

    lines = []
    for i, text in rows:
        if i is None or text is None:
            continue
        for place, line in enumerate(text.split("\n")):
            tokens = re.findall(r"[^\x20\x09-\x0D]+", lower(line))
            if len(tokens) >= min_tokens:
                lines.append((i, place, tuple("<*>" if re.search("[0-9]", t) else t for t in tokens)))
    needed = lambda n: 2 if n >= long_tokens else min_docs
    leaf = lambda t: (len(t), t[:depth])
    holders = {}
    for i, place, t in lines:
        holders.setdefault(t, set()).add(i)
    seen = {}
    for t, ids in holders.items():
        for at, word in enumerate(t):
            seen[leaf(t), at, word] = seen.get((leaf(t), at, word), 0) + len(ids)
    templates = {}
    for t in holders:
        fixed = tuple((at, w) for at, w in enumerate(t) if w != "<*>" and seen[leaf(t), at, w] >= needed(len(t)))
        if len(fixed) >= len(t) * share and not math.isclose(share, 0):
            templates.setdefault((leaf(t), fixed), []).append(t)
    first = {}
    at_first = {}
    for i, place, t in lines:
        at_first[t] = min(at_first.get(t, (i, place)), (i, place))
    for t, ids in holders.items():
        if len(ids) >= needed(len(t)):
            first[t] = at_first[t]
    for members in templates.values():
        if len(set().union(*(holders[t] for t in members))) >= needed(len(members[0])):
            head = min(at_first[t] for t in members)
            for t in members:
                first[t] = min(first.get(t, head), head)
    out = {}
    for i, place, t in lines:
        if t in first and first[t] != (i, place):
            out.setdefault(i, set()).add(place)
    return out
