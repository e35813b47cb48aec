"""Plain Python versions of the text operators, straight from their definitions."""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections import Counter, defaultdict

WHITE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(docs):
    """{doc_id: (set size, component)} for (doc_id, text); documents of one id are merged by min."""
    sets = []
    for d, t in docs:
        w = WHITE.findall((t or "").translate(LOWER))
        sets.append((d, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    at = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            at[x].append(i)
    for i, (d, s) in enumerate(sets):
        shared = Counter(j for x in s for j in at[x] if j < i)
        for j, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(sets[j][1]) - n):
                a, b = find(d), find(sets[j][0])
                root[max(a, b)] = min(a, b)
    return sorted((d, len(s), find(d)) for d, s in sets)


def encoded(tokenizer, text, end):
    return array("I", tokenizer.encode(text or "", add_special_tokens=False).ids).tobytes() + end.to_bytes(4, "little")


def repeats(docs, k=50):
    """Rows of the repeated-bytes contract for distinct ids."""
    least = {}
    data = [(d, (t or "").encode()) for d, t in docs]
    for d, b in data:
        for i in range(len(b) - k + 1):
            g = b[i : i + k]
            if least.get(g, d) >= d:
                least[g] = d
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - k + 1):
            if least[b[i : i + k]] < d:
                gone[i : i + k] = b"\x01" * k
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def counts(t):
    t = t or ""
    w = WHITE.findall(t)
    c, hit, seen, dup = Counter(zip(w, w[1:], w[2:], strict=False)), set(), set(), 0
    for i in range(len(w) - 2):
        if c[tuple(w[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    for line in t.split("\n"):
        if WHITE.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)


def url(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(LOWER), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule(host, path, rules):
    fit = [r for r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fit, key=len, default=None)


def line_matches(docs, least=5):
    """{(doc_id, line)} of lines that match an earlier line."""
    rows = sorted((d, i, frozenset(WHITE.findall(x.translate(LOWER)))) for d, t in docs for i, x in enumerate((t or "").split("\n")) if len(WHITE.findall(x)) >= least)
    at, gone = defaultdict(list), set()
    for j, (d, i, s) in enumerate(rows):
        shared = Counter(k for w in s for k in at[w])
        if any(100 * n >= 80 * (len(s) + len(rows[k][2]) - n) for k, n in shared.items()):
            gone.add((d, i))
        for w in s:
            at[w].append(j)
    return gone


def contaminated(docs, items, span=13):
    windows = defaultdict(set)
    for item, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        n = min(span, len(w))
        for i in range(len(w) - n + 1) if w else ():
            windows[tuple(w[i : i + n])].add(item)
    sizes = sorted({len(x) for x in windows})
    out = []
    for d, t in docs:
        w, hit, found = ALNUM.findall((t or "").translate(LOWER)), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[x]
        names = ",".join(sorted(map(str, found)))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def crc(data):
    return zlib.crc32(data)
