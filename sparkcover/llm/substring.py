"""Removal of word passages that an earlier document already has, by FM-index shards.

A window is ``window`` consecutive words of a document. Every word covered by a
window whose word sequence also starts in a document with a smaller id is removed.

Equal windows must meet in one shard, or each document would have to be searched in
every shard. So windows are routed by content: the smallest hash of the word
sequences of ``window - 8`` words inside the window (a minimizer). Runs of
neighbouring windows with one minimizer travel as one segment.

1. Per document, segments as numbers only: route, id, place. Routes that occur in one
   document alone are dropped.
2. The words of what is left are fetched from the texts. A route with more than
   ``hot_rows`` segments is split into single windows, routed by their whole words.
   Equal segments become one, with the smallest document id.
3. Shards of at most about ``shard_words`` words: a suffix order of the distinct segments over
   word symbols, its Burrows-Wheeler transform in a wavelet matrix (two bits of the
   symbols per level, packed, with ranks per 64-bit block). Backward search extends the matches of all segments to the
   left one word at a time; at length ``window`` the interval gives the smallest
   document id that has the window, then the last word is dropped and the search goes on.
4. Each occurrence compares its own id with that; covered windows go back to the
   document, one row each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcover.llm.common import discard, free_prefix, let_go_of_shuffles, map_arrow, written

OUTPUTS = ("n_words", "n_removed", "kept_text")
_RUN = 63  # windows in a segment at most: six bits of the place
_CHUNK = 1 << 19  # bytes hashed at a time
_GRAM_GAP = 8  # a minimizer has that many words less than a window
_NO_ID = np.iinfo(np.int64).max

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}
_ALL = ~np.uint64(0)
_TURN_ONE = np.array([_ALL, 0, _ALL, 0], np.uint64)
_TURN_TWO = np.array([_ALL, _ALL, 0, 0], np.uint64)
_BELOW = np.array([(1 << k) - 1 for k in range(64)], np.uint64)


def _power(which: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(which)
    if have is None or len(have) < n:
        size = max(n, _CHUNK + 4096)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _powers[which] = np.cumprod(steps)
    return have[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start byte and 64-bit hash of each word (split at ASCII white space)."""
    buf = np.frombuffer(data, np.uint8)
    edge = np.diff(np.concatenate(([0], (~_SPACE[buf]).view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    n = len(buf)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _power("base", _BASE, n), out=sums[1:])
    raw = (sums[ends] - sums[starts]) * _power("inverse", _BASE_INVERSE, n)[starts]
    return starts, _mix(raw + (ends - starts).astype(np.uint64))


def _pieces(data: bytes) -> Iterator[bytes]:
    """A text in stretches of about ``_CHUNK`` bytes that end at white space."""
    at = 0
    while len(data) - at > _CHUNK:
        cut = at + _CHUNK
        while cut < len(data) and not _SPACE[data[cut]]:
            cut += 1
        yield data[at:cut]
        at = cut
    yield data[at:]


def routes(hashes: np.ndarray, owner: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments of texts laid end to end: (first word, number of windows, route).

    ``owner`` numbers the text of each word; no window spans two texts.
    """
    n = len(hashes) - window + 1
    if n < 1:
        return (np.array([], np.int64),) * 2 + (np.array([], np.uint64),)
    gram = max(1, window - _GRAM_GAP)
    mixed = np.zeros(len(hashes) - gram + 1, np.uint64)
    for j in range(gram):
        mixed = mixed * _BASE + hashes[j : j + len(mixed)]
    low, width = _mix(mixed), 1
    reach = window - gram + 1
    while width < reach:
        step = min(width, reach - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    inside = owner[:n] == owner[window - 1 :]
    place = np.flatnonzero(inside)
    if not len(place):
        return (np.array([], np.int64),) * 2 + (np.array([], np.uint64),)
    value = low[place]
    new = np.concatenate(([True], (value[1:] != value[:-1]) | (place[1:] != place[:-1] + 1) | (owner[place[1:]] != owner[place[:-1]])))
    run = np.cumsum(new) - 1
    since = np.arange(len(place)) - np.flatnonzero(new)[run]
    first = np.flatnonzero(since % _RUN == 0)  # long runs of one route are cut
    return place[first], np.diff(np.append(first, len(place))), value[first]


def _segment_rows(texts: list[bytes], window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text number, first word in it, windows, route) arrays for groups of texts."""

    def of_group(numbers: list[int], parts: list[bytes]):
        data = b" ".join(parts)
        starts, hashes = word_hashes(data)
        limits = np.cumsum([len(p) + 1 for p in parts])
        owner = np.searchsorted(limits, starts, "right")
        at, count, route = routes(hashes, owner, window)
        first = np.searchsorted(owner, np.arange(len(parts)))
        mine = owner[at]
        return np.array(numbers)[mine], at - first[mine], count, route

    numbers: list[int] = []
    size = 0
    for k, text in enumerate(texts):
        if len(text) > _CHUNK:
            hashes = np.concatenate([word_hashes(p)[1] for p in _pieces(text)])
            at, count, route = routes(hashes, np.zeros(len(hashes), np.int64), window)
            yield np.full(len(at), k), at, count, route
            continue
        numbers.append(k)
        size += len(text)
        if size > _CHUNK:
            yield of_group(numbers, [texts[i] for i in numbers])
            numbers, size = [], 0
    if numbers:
        yield of_group(numbers, [texts[i] for i in numbers])


# ------------------------------------------------------------------ the index of a shard


class WaveletMatrix:
    """Ranks of symbols in a sequence: per level two packed bit vectors, for four branches."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels = max(1, -(-int(n_symbols - 1).bit_length() // 2))
        self.planes, self.before = [], []
        for level in range(self.levels - 1, -1, -1):
            digit = (symbols >> (2 * level)) & 3
            planes = []
            for bit in (digit & 1, digit >> 1):
                padded = np.zeros((len(digit) // 64 + 1) * 8, np.uint8)
                packed = np.packbits(bit.astype(bool), bitorder="little")
                padded[: len(packed)] = packed
                planes.append(padded.view(np.uint64))
            one, two = planes
            valid = np.full(len(one), ~np.uint64(0))
            valid[-1] = (np.uint64(1) << np.uint64(len(digit) % 64)) - np.uint64(1)
            before = np.empty((len(one), 4), np.int64)
            base = 0
            for d, here in enumerate((~one & ~two, one & ~two, ~one & two, one & two)):
                counts = np.bitwise_count(here & valid).astype(np.int64)
                before[:, d] = np.cumsum(counts) - counts + base  # places of smaller branches come first
                base += int(counts.sum())
            self.planes.append((one, two))
            self.before.append(before.reshape(-1))
            symbols = symbols[np.argsort(digit, kind="stable")]
        everything = np.arange(n_symbols)
        self.start = self._walk(everything, np.zeros(n_symbols, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            digit = (symbol >> (2 * (self.levels - 1 - k))) & 3
            block = at >> 6
            one, two = self.planes[k]
            # a plane is turned round where the digit has a 0 in it
            here = (one[block] ^ _TURN_ONE[digit]) & (two[block] ^ _TURN_TWO[digit]) & _BELOW[at & 63]
            at = self.before[k][4 * block + digit] + np.bitwise_count(here)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before place ``at``."""
        return self._walk(symbol, at) - self.start[symbol]


def _order(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by two rank arrays (ties in any order), and the dense rank of each row."""
    both = keys[0].astype(np.int64) * (int(keys[1].max()) + 1) + keys[1] if len(keys) > 1 else keys[0]
    order = np.argsort(both)
    sorted_keys = both[order]
    rank = np.empty(len(both), np.int64)
    rank[order] = np.cumsum(np.concatenate(([False], sorted_keys[1:] != sorted_keys[:-1])))
    return order, rank


class FmIndex:
    """Segments of words, indexed for backward search of up to ``window`` words."""

    def __init__(self, segments: list[list[int]], ids: np.ndarray, n_symbols: int, window: int):
        sizes = np.array([len(s) for s in segments])
        text = np.concatenate([np.array([*s, 0], np.int64) for s in segments])  # 0 ends a segment
        owner = np.repeat(np.arange(len(segments)), sizes + 1)
        self.window, self.n = window, len(text)

        def shifted(rank: np.ndarray, by: int) -> np.ndarray:
            return np.concatenate((rank[by:] + 1, np.zeros(min(by, len(rank)), np.int64)))[: len(rank)]

        rank, have = _order(text)[1], 1
        while 2 * have < window:
            rank, have = _order(rank, shifted(rank, have))[1], 2 * have
        order, full = _order(rank, shifted(rank, window - have)) if window > have else _order(rank)
        short = _order(rank, shifted(rank, window - 1 - have))[1] if window - 1 > have else rank
        rank_short = short[order] if window > 1 else np.zeros(self.n, np.int64)
        edge = np.flatnonzero(np.concatenate(([True], rank_short[1:] != rank_short[:-1])))
        run = np.cumsum(np.concatenate(([0], (rank_short[1:] != rank_short[:-1]).astype(np.int64))))
        self.low = edge[run]  # interval of the suffixes that share window - 1 words
        self.high = np.append(edge[1:], self.n)[run]
        whole = full[order]
        starts = np.flatnonzero(np.concatenate(([True], whole[1:] != whole[:-1])))
        self.least = np.minimum.reduceat(ids[owner[order]], starts)[whole]
        self.wavelet = WaveletMatrix(text[order - 1], n_symbols)  # the word before each suffix
        self.less = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=n_symbols))))[:-1]

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the matches extended by ``symbol`` to the left."""
        n = len(symbol)
        both = np.tile(self.less[symbol], 2) + self.wavelet.rank(np.tile(symbol, 2), np.concatenate((low, high)))
        return both[:n], both[n:]

    def least_ids(self, segments: list[list[int]]) -> list[np.ndarray]:
        """For each segment, per window from the left: the smallest id of a document that has it."""
        sizes = np.array([len(s) for s in segments])
        out = [np.full(max(0, int(m) - self.window + 1), _NO_ID) for m in sizes]
        flat = np.concatenate([np.array(s, np.int64) for s in segments])
        end = np.cumsum(sizes)
        low, high = np.zeros(len(segments), np.int64), np.full(len(segments), self.n)
        for t in range(int(sizes.max())):
            live = np.flatnonzero((sizes > t) & (high > low))
            if not len(live):
                break
            if t >= self.window:
                first = low[live]
                low[live], high[live] = self.low[first], self.high[first]
            low[live], high[live] = self.step(flat[end[live] - 1 - t], low[live], high[live])
            if t >= self.window - 1:
                hit = live[high[live] > low[live]]
                for k, least in zip(hit.tolist(), self.least[low[hit]].tolist()):
                    out[k][sizes[k] - 1 - t] = least
        return out


def _search_shard(table: pa.Table, window: int) -> pa.Table:
    """Distinct segments (route, key, words, least_id) of a shard to (route, key, least)."""
    names: dict[bytes, int] = {}
    segments = [
        [names.setdefault(w, len(names) + 1) for w in s.split(b" ")] for s in table.column("words").to_pylist()
    ]
    ids = table.column("least_id").to_numpy()
    found = FmIndex(segments, ids, len(names) + 1, window).least_ids(segments)
    return pa.table(
        {
            "route": table.column("route"),
            "key": table.column("key"),
            "least": pa.array([f.tolist() for f in found], pa.list_(pa.int64())),
        }
    )


# ------------------------------------------------------------------ the operator


def _segments(rows: DataFrame, window: int) -> DataFrame:
    """(route, id, place) of every segment; place: first word, windows, and the text's key."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            keys = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = [x or b"" for x in batch.column(2).to_pylist()]
            for k, first, count, route in _segment_rows(texts, window):
                if len(k):
                    place = (keys[k] << 33) | (first << 6) | count
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(route.view(np.int64)), pa.array(ids[k]), pa.array(place)], names=["route", "id", "place"]
                    )

    source = rows.where("id is not null and text is not null").select("id", "tk", "text")
    return map_arrow(source, run, "route long, id long, place long")


def _shared(segments: DataFrame) -> DataFrame:
    """The segments whose route occurs under two ids or more, repeated rows once.

    Each task reads its rows sorted; it holds back rows of one route only while they
    are all of one document.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["route", "id", "place"]
        held = [np.array([], np.int64)] * 3
        shared = None  # a route known to be shared that may go on
        before = None  # the last row of the batch before
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            other = np.logical_or.reduce([np.concatenate(([True], c[1:] != c[:-1])) for c in fresh])
            other[0] = before != tuple(int(c[0]) for c in fresh)
            before = tuple(int(c[-1]) for c in fresh)
            cols = [np.concatenate((h, c[other])) for h, c in zip(held, fresh)]
            route, ids = cols[0], cols[1]
            if not len(route):
                continue
            new = np.concatenate(([True], route[1:] != route[:-1]))
            starts = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            many = np.minimum.reduceat(ids, starts) != np.maximum.reduceat(ids, starts)
            if shared is not None and route[0] == shared:
                many[0] = True
            last = int(starts[-1])
            shared = int(route[-1]) if many[-1] else None
            keep = many[group]
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in cols], names=names)
            held = [np.array([], np.int64)] * 3 if many[-1] else [c[last:] for c in cols]

    grouped = segments.repartition("route").sortWithinPartitions("route", "id", "place")
    return map_arrow(grouped, run, "route long, id long, place long")


def _occurrences(rows: DataFrame, shared: DataFrame, window: int, hot_rows: int) -> DataFrame:
    """Words of the shared segments: (route, key, words, id, tk, first, windows)."""
    hot = shared.groupBy("route").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows).select(
        "route", F.lit(True).alias("hot")
    )
    wanted = (
        shared.join(hot, "route", "left")
        .select(
            "id",
            F.shiftrightunsigned("place", 33).cast("int").alias("tk"),
            F.struct("route", F.col("place").bitwiseAND(F.lit((1 << 33) - 1)).alias("at"), F.coalesce("hot", F.lit(False)).alias("hot")).alias("s"),
        )
        .groupBy("id", "tk").agg(F.collect_list("s").alias("s"))
    )
    joined = wanted.join(rows.select("id", "tk", "text"), ["id", "tk"]).select("id", "tk", "s", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            ids, keys, texts = (batch.column(k).to_pylist() for k in (0, 1, 3))
            lists = batch.column(2)
            ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).tolist()
            route, place, hot = (c.to_pylist() for c in lists.flatten().flatten())
            out: list[list] = [[] for _ in range(6)]
            add_route, add_words, add_id, add_key, add_first, add_windows = (c.append for c in out)
            start = 0
            for i, end in enumerate(ends):
                if before != (ids[i], keys[i]):  # a repeated row has the same segments
                    before = (ids[i], keys[i])
                    words = texts[i].split()
                    for k in range(start, end):
                        first, count = place[k] >> 6, place[k] & _RUN
                        parts = [(first, count)] if not hot[k] else [(j, 1) for j in range(first, first + count)]
                        for j, windows in parts:
                            text = b" ".join(words[j : j + windows + window - 1])
                            add_route(xxhash.xxh64_intdigest(text, 7) - (1 << 63) if hot[k] else route[k])
                            add_words(text)
                            add_id(ids[i])
                            add_key(keys[i])
                            add_first(j)
                            add_windows(windows)
                start = end
                if len(out[0]) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)
                    for c in out:
                        c.clear()
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    names = ["route", "words", "id", "tk", "first", "windows"]
    types = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    return map_arrow(joined, run, "route long, words binary, id long, tk int, first int, windows int").withColumn(
        "key", F.xxhash64("words")
    )


def remove_repeated_passages(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    window: int = 13,
    carry: list[str] | None = None,
    hot_rows: int = 4096,
    shard_words: int = 1 << 20,
) -> DataFrame:
    """``docs`` (or its columns ``carry``) with ``n_words``, ``n_removed`` and ``kept_text``.

    ``kept_text`` holds the kept words joined by one space, empty for a null or wordless
    text. Windows are judged on the input, and only against strictly smaller ids: rows
    that share an id don't remove each other, a null id neither removes nor loses
    anything. Repeated rows stay and are judged alike. Texts under ``window`` words keep
    all. (Rows of one id but different texts are told apart by 30 bits of a text hash.)
    An empty table gives an empty result. Input columns named like an output give way.
    """
    w = free_prefix(docs)
    keep = [c for c in (docs.columns if carry is None else carry) if c.lower() not in OUTPUTS]
    data = F.col(f"`{text}`").cast("binary")
    key = F.pmod(F.xxhash64(F.col(f"`{text}`")), F.lit(1 << 30)).cast("int")
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("id"), key.alias("tk"), data.alias("text"))
    shared = written(_shared(_segments(rows, window)), "shared-segments")
    let_go_of_shuffles(docs.sparkSession)
    found = written(_occurrences(rows.where("id is not null and text is not null"), shared, window, hot_rows), "segments")
    discard(shared)
    let_go_of_shuffles(docs.sparkSession)
    total = int(found.agg(F.sum(F.col("windows") + window)).first()[0] or 0)
    shards = max(1, -(-total // shard_words))
    distinct = found.groupBy("route", "key").agg(F.min("id").alias("least_id"), F.first("words").alias("words"))
    least = (
        distinct.withColumn("shard", F.pmod(F.xxhash64("route"), F.lit(shards)))
        .groupBy("shard")
        .applyInArrow(lambda t: _search_shard(t, window), "route long, key long, least array<long>")
    )
    covered = (
        found.select("route", "key", "id", "tk", "first").join(least, ["route", "key"])
        .select(
            "id",
            "tk",
            F.filter(
                F.transform("least", lambda m, j: F.when(m < F.col("id"), F.col("first") + j)), lambda x: x.isNotNull()
            ).alias("at"),
        )
        .where(F.size("at") > 0)
        .groupBy("id", "tk").agg(F.flatten(F.collect_list("at")).alias("at"))
    )
    covered = written(covered, "covered-windows")
    discard(found)
    let_go_of_shuffles(docs.sparkSession)
    covered = covered.select(
        F.col("id").alias(f"{w}id"), F.col("tk").alias(f"{w}tk"), F.col("at").alias(f"{w}at")
    )
    base = docs.select(
        *[F.col(f"`{c}`") for c in keep],
        F.col(f"`{doc_id}`").cast("bigint").alias(f"{w}id"),
        key.alias(f"{w}tk"),
        data.alias(f"{w}text"),
    )
    joined = base.join(covered, [f"{w}id", f"{w}tk"], "left").select(
        *[F.col(f"`{c}`") for c in keep], F.col(f"{w}at"), F.col(f"{w}text")
    )
    schema = T.StructType(
        joined.schema.fields[: len(keep)]
        + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(keep)
        for batch in batches:
            counts, removed, kept = [], [], []
            for at, value in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist()):
                words = (value or b"").split()
                counts.append(len(words))
                if at:
                    change = np.zeros(len(words) + 1, np.int64)
                    at = np.unique(at)
                    np.add.at(change, at, 1)
                    np.add.at(change, at + window, -1)
                    gone = np.cumsum(change)[:-1] > 0
                    removed.append(int(gone.sum()))
                    words = [words[i] for i in np.flatnonzero(~gone)]
                else:
                    removed.append(0)
                kept.append(b" ".join(words).decode("utf-8"))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                names=schema.fieldNames(),
            )

    return map_arrow(joined, run, schema)
