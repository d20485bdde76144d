"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of ``window`` consecutive words of each benchmark
item; an item of fewer words is one pattern by itself. Patterns of one length
share a matcher: a shift table on blocks of two words says how far the search may
skip, a table on the last block of each pattern selects the few patterns that may
end there, and their words are then compared directly.

The benchmark is read in blocks of about ``block_bytes`` of text, one at a time; each is one
pass over rows that stay where they are, and what a pass found is written before the next one
starts. So driver and tasks hold one block however large the benchmark is (one item lies in
one block). Nothing is shuffled; a benchmark of one block writes nothing between.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcover.llm.common import discard, free_prefix, kept_columns, map_arrow, written

OUTPUTS = ("n_words", "n_hit", "hit_spans", "item_ids", "contaminated")

# a-z, 0-9 and all bytes of non-ASCII characters make words; A-Z is lower-cased
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(data: bytes | None) -> list[bytes]:
    return (data or b"").translate(_FOLD).split()


class WuManber:
    """Search for patterns of ``length`` words, each a stretch of an item: ``(item, start)``."""

    def __init__(self, items: list[list[bytes]], patterns: list[tuple[int, int]], length: int):
        self.items, self.length = items, length
        self.block = min(2, length)
        self.skip = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.ends: dict[tuple[bytes, ...], list[tuple[int, int]]] = {}
        for item, start in patterns:
            words = items[item]
            for end in range(self.block, length + 1):
                gram = tuple(words[start + end - self.block : start + end])
                left = length - end
                if left < self.shift.get(gram, self.skip):
                    self.shift[gram] = left
            self.ends.setdefault(tuple(words[start + length - self.block : start + length]), []).append((item, start))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """(start, items) of each place where patterns occur, in order."""
        n, m, shift, skip = len(words), self.length, self.shift, self.skip
        pos = m - 1
        pair = self.block == 2
        while pos < n:
            gram = (words[pos - 1], words[pos]) if pair else (words[pos],)
            jump = shift.get(gram, skip)
            if jump:
                pos += jump
                continue
            start = pos - m + 1
            here = words[start : pos + 1]
            found = [i for i, s in self.ends[gram] if self.items[i][s] == here[0] and self.items[i][s : s + m] == here]
            if found:
                yield start, found
            pos += 1


def matchers(texts: list[bytes | None], window: int) -> list[WuManber]:
    """One matcher per pattern length; equal windows of one item count once."""
    items = [words_of(t) for t in texts]
    by_length: dict[int, list[tuple[int, int]]] = {}
    for i, words in enumerate(items):
        if words:
            m = min(window, len(words))
            starts = {tuple(words[s : s + m]): s for s in range(len(words) - m, -1, -1)}
            by_length.setdefault(m, []).extend((i, s) for s in starts.values())
    return [WuManber(items, patterns, m) for m, patterns in sorted(by_length.items())]


def _merge(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list]:
    """The benchmark's rows in lists of about ``block_bytes`` of text."""
    rows = benchmark.select(
        F.col(f"`{item_id}`").cast("string").alias("i"), F.col(f"`{text}`").cast("binary").alias("t")
    ).where("t is not null")
    total = rows.agg(F.sum(F.octet_length("t")).alias("b")).first()["b"] or 0
    n = max(1, -(-2 * int(total) // block_bytes)) if total > block_bytes else 1
    for k in range(n):
        yield rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()


def mark_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    block_bytes: int = 1 << 20,
    carry: list[str] | None = None,
) -> DataFrame:
    """``docs`` (or its columns ``carry``) with what of them the benchmark holds.

    ``n_words``; ``n_hit`` (words inside any occurrence); ``hit_spans``
    (array of ``(start, end)`` word intervals, merged, end excluded);
    ``item_ids`` (array of string, sorted, without repeats); ``contaminated``.
    Null or wordless texts have no words and no hits. Null and wordless items
    match nothing, null item ids are listed nowhere but their windows still hit.
    Repeated rows are judged alike. An empty benchmark marks nothing. Input
    columns named like an output give way.
    """
    keep = docs.columns if carry is None else carry
    w = free_prefix(docs)
    keep = [c for c in keep if c.lower() not in OUTPUTS]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("binary").alias(f"{w}t"))
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    added = [
        T.StructField(f"{w}n", T.LongType()),
        T.StructField(f"{w}s", span),
        T.StructField(f"{w}i", T.ArrayType(T.StringType())),
    ]
    plain = T.StructType(rows.schema.fields + added)
    arrow_span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def one_pass(shared, first: bool):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, items = shared.value
            searchers = matchers(items, window)
            for batch in batches:
                at = len(keep)
                before = batch.slice(0) if not first else None
                counts, spans, found = [], [], []
                old_s = before.column(at + 2).to_pylist() if before is not None else None
                old_i = before.column(at + 3).to_pylist() if before is not None else None
                for k, data in enumerate(batch.column(at).to_pylist()):
                    words = words_of(data)
                    hits = [] if first else [[x["start"], x["end"]] for x in old_s[k]]
                    seen = set() if first else set(old_i[k])
                    for s in searchers:
                        for start, which in s.search(words):
                            if hits and hits[-1][0] <= start <= hits[-1][1]:
                                hits[-1][1] = max(hits[-1][1], start + s.length)
                            else:
                                hits.append([start, start + s.length])
                            seen.update(names[i] for i in which if names[i] is not None)
                    counts.append(len(words))
                    spans.append([{"start": a, "end": b} for a, b in _merge(hits)])
                    found.append(sorted(seen))
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.columns[: at + 1],
                        pa.array(counts, pa.int64()),
                        pa.array(spans, arrow_span),
                        pa.array(found, pa.list_(pa.string())),
                    ],
                    names=plain.fieldNames(),
                )

        return run

    table = shared = None
    for k, block in enumerate(_blocks(benchmark, item_id, item_text, block_bytes)):
        if k:
            before, table = table, written(rows, "op7-pass")
            rows = table
            shared.unpersist()
            if before is not None:
                discard(before)
        shared = docs.sparkSession.sparkContext.broadcast(([r["i"] for r in block], [bytes(r["t"]) for r in block]))
        rows = map_arrow(rows, one_pass(shared, k == 0), plain)
    hit = F.aggregate(f"{w}s", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return rows.select(
        *kept_columns(docs.select(*[F.col(f"`{c}`") for c in keep]), OUTPUTS),
        F.col(f"{w}n").alias("n_words"),
        hit.alias("n_hit"),
        F.col(f"{w}s").alias("hit_spans"),
        F.col(f"{w}i").alias("item_ids"),
        (F.size(f"{w}s") > 0).alias("contaminated"),
    )
