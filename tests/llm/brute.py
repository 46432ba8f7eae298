"""Plain Python versions of the contracts, for small tables."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from wordloom.llm import pitman_yor as py
from wordloom.llm.kernels import U64, mix
from wordloom.llm.shingles import word_hashes

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def lower_ascii(text: str) -> bytes:
    return text.encode().lower()


def shingles(text: str | None) -> frozenset:
    words = WORD.findall(lower_ascii(text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def linked_groups(rows: list[tuple]) -> list[tuple]:
    """(id, set size, component) of each row; ids name the component, null ones only if there are no others."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(k: int) -> int:
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    best: dict[int, int] = {}
    for k, (i, _) in enumerate(rows):
        if i is not None and sets[k]:
            best[find(k)] = min(best.get(find(k), i), i)
    return [(i, len(s), best.get(find(k), i) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))]


def repeated_bytes(texts: list[bytes], length: int = 200) -> list[tuple[bytes, int]]:
    """(kept bytes, removed runs) of each text."""
    seen = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        out.append((bytes(b for b, g in zip(t, gone, strict=True) if not g), len(re.findall(rb"\x01+", bytes(gone)))))
    return out


def plain_restaurants(rows: list[tuple], hot: int) -> tuple[list[tuple], list[list[float]]]:
    """(id, score) of each row, and for some contexts the probabilities of all known words and an unknown one.

    The same model with dictionaries; random numbers and single draws are taken from the library.
    """

    def one(f, *args):
        return f(*(np.array([a]) if not isinstance(a, (int, float)) or isinstance(a, np.generic) else a for a in args))[0]

    def learned(i) -> bool:
        return zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1

    tokens = [[*(w for w in word_hashes([(t or "").encode()])[0]), py.END] for _, t in rows]
    counts = Counter(w for (i, _), ws in zip(rows, tokens, strict=True) if learned(i) for w in ws[:-1])
    vocabulary = len(counts) + 1
    parts = {w: -(-n // hot) for w, n in counts.items() if n >= hot}
    if len(rows) >= hot:
        parts[py.START] = -(-len(rows) // hot)

    def places(i, ws):
        own = one(mix, np.int64(-(2**63) if i is None else i).view(U64))
        for k, w in enumerate(ws):
            before = [ws[k - j] if k >= j else py.START for j in (1, 2, 3)]
            named = [own if b == py.START else b for b in before]
            kind = 0
            if parts.get(before[0], 1) > 1:
                kind = int(one(mix, named[1] + py._ODD[0]) % U64(parts[before[0]])) << 16
                if parts.get(before[1], 1) > 1:
                    kind += int(one(mix, named[2] + py._ODD[0]) % U64(parts[before[1]]))
            node = one(py.node_of, before[0], np.int64(kind))
            yield node, before[1], w

    with np.errstate(over="ignore"):
        seen = [list(places(i, ws)) for (i, _), ws in zip(rows, tokens, strict=True)]
    c3 = Counter(x for (i, _), xs in zip(rows, seen, strict=True) if learned(i) for x in xs)
    (d1, d2, d3), (s1, s2, s3) = py.DISCOUNTS, py.STRENGTHS

    def run(above, draws):
        t3 = dict.fromkeys(c3, 1)
        c2 = Counter((n, w) for n, _, w in c3)
        t2 = dict.fromkeys(c2, 1)
        for draw in draws:
            tables, total, held = Counter(), Counter(), Counter()
            for (n, w), c in c2.items():
                tables[n] += t2[n, w]
                total[n] += c
            for (n, u, w), t in t3.items():
                held[n, u] += t
            new = {}
            for (n, u, w), c in c3.items():
                mine = t3[n, u, w]
                eaten = c2[n, w] - mine
                least = min(t2[n, w], eaten)
                parent = (eaten - d2 * least + (s2 + d2 * (tables[n] - t2[n, w] + least)) * above(w)) / (s2 + total[n] - mine)
                context = one(lambda a, b: py.pair(a, b, 1), n, u)
                name = one(lambda a, b: py.pair(a, b, 2), context, w)
                new[n, u, w] = int(py.tables_of(np.array([c]), np.array([parent]), np.array([held[n, u] - mine]), s3, d3, np.array([name]), 2 * draw)[0])
            t3 = new
            c2 = Counter()
            for (n, u, w), t in t3.items():
                c2[n, w] += t
            t2 = {(n, w): int(py.tables_of(np.array([c]), np.array([above(w)]), np.array([tables[n] - t2[n, w]]), s2, d2, np.array([one(lambda a, b: py.pair(a, b, 2), n, w)]), 2 * draw + 1)[0]) for (n, w), c in c2.items()}
            yield t3, c2, t2

    *_, (_, _, t2) = run(lambda w: 1 / (vocabulary + 1), range(py._BURN_IN))
    c1 = Counter()
    for (n, w), t in t2.items():
        c1[w] += t
    flat = 1 / (vocabulary + 1)
    t1 = {w: sum(int(py.tables_of(np.array([c]), np.array([flat]), np.array([vocabulary - 1]), s1, d1, np.array([w]), 1000 + k)[0]) for k in range(4)) / 4 for w, c in c1.items()}

    def unigram(w):
        return (c1.get(w, 0) - d1 * t1.get(w, 0) + (s1 + d1 * sum(t1.values())) * flat) / (s1 + sum(c1.values()))

    sums = defaultdict(float)
    wanted = {x for xs in seen for x in xs}
    contexts = sorted({(n, u) for n, u, _ in wanted})[:12]
    unknown = U64(12345)
    wanted |= {(*c, w) for c in contexts for w in [*counts, py.END, unknown]}
    for draw, (t3, c2, t2) in enumerate(run(unigram, range(py._SWEEPS, 2 * py._SWEEPS))):
        if draw < py._BURN_IN:
            continue
        tables, total, held, eaten = Counter(), Counter(), Counter(), Counter()
        for (n, w), c in c2.items():
            tables[n] += t2[n, w]
            total[n] += c
        for (n, u, w), t in t3.items():
            held[n, u] += t
            eaten[n, u] += c3[n, u, w]
        for n, u, w in wanted:
            p2 = (c2.get((n, w), 0) - d2 * t2.get((n, w), 0) + (s2 + d2 * tables[n]) * unigram(w)) / (s2 + total[n])
            p3 = (c3.get((n, u, w), 0) - d3 * t3.get((n, u, w), 0) + (s3 + d3 * held[n, u]) * p2) / (s3 + eaten[n, u])
            sums[n, u, w] += p3 / (py._SWEEPS - py._BURN_IN)
    scores = [(i, float(sum(np.log10(sums[x]) for x in xs))) for (i, _), xs in zip(rows, seen, strict=True)]
    return scores, [[sums[*c, w] for w in [*counts, py.END, unknown]] for c in contexts]
