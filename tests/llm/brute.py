"""Plain one-process versions that the operators are held against."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def substring_dedup(docs: list[tuple[int, str | None]], k: int = 50) -> list[tuple]:
    words = [(d, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for d, t in docs if d is not None]
    lowest: dict[tuple, int] = {}
    for d, w in words:
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            lowest[key] = min(d, lowest.get(key, d))
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if lowest[tuple(w[i : i + k])] < d:
                gone[i : i + k] = [True] * k
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), sha(kept)))
    return sorted(out)


def suffix_dedup(docs: list[tuple[int, str | None]], k: int = 400) -> list[tuple]:
    own = [(d, (t or "").encode()) for d, t in docs if d is not None]
    seen = Counter(hash(b[i : i + k]) for _, b in own for i in range(len(b) - k + 1))
    out = []
    for d, b in own:
        gone, until = bytearray(len(b)), 0
        for i in range(len(b) - k + 1):
            if seen[hash(b[i : i + k])] > 1:
                for j in range(max(i, until), i + k):
                    gone[j] = 1
                until = i + k
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return sorted(out)


def token_files(docs, encode, end: int = 0) -> list[tuple]:
    out, at = [], 0
    for d, t in sorted((x for x in docs if x[0] is not None), key=lambda x: (x[0], x[1] or "")):
        ids = [*encode(t or ""), end]
        out.append((d, at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        at += len(ids)
    return out


def decontamination(docs, items, size: int = 10) -> list[tuple]:
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    windows = defaultdict(set)
    for i, t in items:
        w = split(t)
        for j in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[j : j + size])].add(str(i))
    sizes = {len(x) for x in windows}
    out = []
    for d, t in docs:
        w, hit, found = split(t), set(), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[j : j + n])):
                    hit.update(range(j, j + n))
                    found |= ids
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), bool(hit)))
    return sorted(out)


def simhash(docs) -> list[tuple]:
    import xxhash

    fps = []
    for d, t in docs:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        fps.append((d, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    return [(d, f"{f:016x}", c) for (d, f), c in zip(fps, components(fps, lambda a, b: (a ^ b).bit_count() <= 2))]


def components(nodes: list[tuple], linked) -> list:
    """Smallest id that each (id, value) can reach."""
    root = list(range(len(nodes)))

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i in range(len(nodes)):
        for j in range(i):
            if linked(nodes[i][1], nodes[j][1]):
                root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(nodes):
        least[find(i)] = min(d, least.get(find(i), d))
    return [least[find(i)] for i in range(len(nodes))]


def embeddings(rows, least: float = 0.95) -> list[tuple]:
    import numpy as np

    def ok(v):
        return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    rows = [r for r in rows if r[0] is not None]
    good = [(i, np.array(v, float) / np.linalg.norm(np.array(v, float))) for i, v in rows if ok(v)]
    links = [[j for j, (_, w) in enumerate(good) if j != i and len(v) == len(w) and float(v @ w) >= least] for i, (_, v) in enumerate(good)]
    out = [(i, 0, i, True) for i, v in rows if not ok(v)]
    seen: set[int] = set()
    for i in range(len(good)):
        if i in seen:
            continue
        todo, group = [i], {i}
        while todo:
            for j in links[todo.pop()]:
                if j not in group:
                    group.add(j)
                    todo.append(j)
        seen |= group
        low = min(good[j][0] for j in group)
        out += [(good[j][0], len(links[j]), low, good[j][0] == low) for j in group]
    return sorted(out)


def warc(pages) -> list[tuple]:
    import base64

    last: dict[bytes, int] = {}
    for p, _, h in pages:
        b = (h or "").encode()
        last[b] = max(p, last.get(b, p))
    out = []
    for p, _, h in pages:
        b = (h or "").encode()
        to = last[b] if last[b] != p else None
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if to is None else "revisit", to))
    return sorted(out, key=lambda r: r[0])
