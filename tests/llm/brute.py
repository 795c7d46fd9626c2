"""Plain restatements of the contracts, for tests: loops over whole texts, no Spark."""

import hashlib
import re
import zlib

import numpy as np
import xxhash


def sha(s: str) -> str:
    return hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()


def secrets(text):
    text = text or ""
    out = []
    rules = (
        ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    )
    for no, (kind, rx, ok) in enumerate(rules):
        out += [(m.start(), no, m.end(), kind) for m in re.finditer(rx, text, re.A) if ok(m)]
    return sorted(out)


def pii(text):
    text = text or ""
    out = []

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m[0])) <= 15),
    )
    for no, (rx, ok) in enumerate(rules):
        out += [(no, m.start(), m.end()) for m in re.finditer(rx, text) if ok(m)]
    return sorted(out)


def simhash(text, size=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(ws[i : i + size]) for i in range(len(ws) - size + 1)] if len(ws) >= size else [" ".join(ws)] if ws else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def component_ids(ids, prints, distance=4):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    p = np.array(prints, dtype=np.uint64)
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(p[i + 1 :] ^ p[i]) <= distance) + i + 1:
            parent[root(int(j))] = root(i)
    least = {}
    for i, d in enumerate(ids):
        r = root(i)
        least[r] = min(x for x in (least.get(r), d) if x is not None) if d is not None or r in least else None
    return [least[root(i)] for i in range(len(ids))]


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def hits(text, items):
    ws, hit, found = words(text), set(), set()
    for item_id, item in items:
        iw = words(item)
        k = min(10, len(iw))
        if not k:
            continue
        wins = {tuple(iw[i : i + k]) for i in range(len(iw) - k + 1)}
        for i in range(len(ws) - k + 1):
            if tuple(ws[i : i + k]) in wins:
                hit |= set(range(i, i + k))
                found.add(item_id)
    return len(ws), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)


def crc(text):
    return zlib.crc32((text or "").encode())
