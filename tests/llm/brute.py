"""Plain versions of the operators' contracts, for comparison on small tables."""

from __future__ import annotations

import re

import xxhash

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def kept_words(docs: list[tuple[int | None, str | None]], window: int = 13) -> list[tuple]:
    """(doc_id, n_words, n_removed, kept text) per row."""
    least: dict[tuple, int] = {}
    split = [(i, _WORD.findall(t or "")) for i, t in docs]
    for i, words in split:
        if i is not None:
            for k in range(len(words) - window + 1):
                w = tuple(words[k : k + window])
                least[w] = min(i, least.get(w, i))
    out = []
    for i, words in split:
        gone = set()
        for k in range(len(words) - window + 1):
            if i is not None and least[tuple(words[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return out


def simhash(text: str | None, k: int = 4) -> int:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = _WORD.findall(low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64(s.encode("utf-8"), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_groups(docs: list[tuple[int | None, str | None]], max_bits: int = 4) -> list[tuple]:
    """(doc_id, fingerprint hex, component id) per row."""
    prints = [simhash(t) for _, t in docs]
    names = sorted(set(prints))
    root = {p: p for p in names}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in names:
        for b in names:
            if a < b and bin(a ^ b).count("1") <= max_bits:
                root[find(b)] = find(a)
    least: dict[int, int] = {}
    for (i, _), p in zip(docs, prints):
        if i is not None:
            r = find(p)
            least[r] = min(i, least.get(r, i))
    return [(i, f"{p:016x}", least.get(find(p))) for (i, _), p in zip(docs, prints)]


_BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def bench_words(text: str | None) -> list[str]:
    return _BENCH_WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def benchmark_hits(docs, items, window: int = 10) -> list[tuple]:
    """(doc_id, n_words, n_hit, sorted item ids) per row."""
    windows: dict[tuple, set] = {}
    for item, text in items:
        words = bench_words(text)
        m = min(window, len(words))
        for k in range(len(words) - m + 1 if m else 0):
            windows.setdefault(tuple(words[k : k + m]), set()).add(str(item))
    sizes = sorted({len(w) for w in windows})
    out = []
    for i, text in docs:
        words, hit, found = bench_words(text), set(), set()
        for m in sizes:
            for k in range(len(words) - m + 1):
                which = windows.get(tuple(words[k : k + m]))
                if which:
                    hit.update(range(k, k + m))
                    found |= which
        out.append((i, len(words), len(hit), sorted(found)))
    return out
