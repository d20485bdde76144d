"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits; bit j is 1 if it is set in over half the XXH64 hashes
(seed 42) of the text's word shingles. Documents link when their fingerprints
differ in at most ``max_bits`` bits; groups are the connected components.

Multi-index hashing: the fingerprint is cut into segments. By the pigeonhole
principle two linked fingerprints agree, up to a small Hamming distance, in one
segment: with r bits over m segments, in one of the first ``r mod m + 1`` up to
``r div m`` bits, or in one of the others up to one bit less. Each distinct
fingerprint is put in one table bucket per segment, enumerates the small Hamming
ball of the segment's value (each pair of values from one side only), and the
buckets verify the complete distance.

Equal texts are one fingerprint, so thousands of copies cost one row. A bucket
gives back a spanning forest of its links, at most one row per fingerprint in it,
never all pairs; a bucket with more than ``bucket_rows`` rows is cut into pairs of
blocks dealt to different tasks. The components of the forest's links are found by
alternating large-star and small-star steps, each written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcover.llm.common import discard, free_prefix, let_go_of_shuffles, map_arrow, written

OUTPUTS = ("fingerprint", "component_id", "representative")
_BITS = 64
_SLICE = 1 << 15  # shingles whose bits are counted at a time


def fingerprint(data: bytes, shingle_words: int = 4, seed: int = 42) -> int:
    """SimHash of a UTF-8 text: A-Z lower-cased, words split at ASCII white space."""
    words = data.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle_words + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    first = starts[:n].tolist()
    last = ends[min(shingle_words, len(words)) - 1 :].tolist()
    counts = np.zeros(_BITS, np.int64)
    for at in range(0, n, _SLICE):
        part = [digest(joined[a:b], seed) for a, b in zip(first[at : at + _SLICE], last[at : at + _SLICE])]
        hashes = np.array(part, np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def with_fingerprints(
    docs: DataFrame, name: str, *, text: str = "text", shingle_words: int = 4, carry: list[str] | None = None
) -> DataFrame:
    """``docs`` (or its columns ``carry``) with the fingerprint as a signed long ``name``."""
    keep = [c for c in (docs.columns if carry is None else carry)]
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("binary").alias(f"{name}_text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [
                fingerprint(x or b"", shingle_words) for x in batch.column(batch.num_columns - 1).to_pylist()
            ]
            column = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column], names=[*keep, name])

    schema = T.StructType([*source.schema.fields[:-1], T.StructField(name, T.LongType())])
    return map_arrow(source, run, schema)


def _segments(max_bits: int, parts: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of each segment that is probed."""
    base, extra = divmod(max_bits, parts)
    out, shift = [], 0
    for s in range(parts):
        width = _BITS // parts + (s >= parts - _BITS % parts)
        radius = base if s <= extra else base - 1
        if radius >= 0:
            out.append((shift, width, radius))
        shift += width
    return out


def _bucket_rows(fp: Column, max_bits: int, parts: int) -> Column:
    """Array of ``(key, member)``: the own bucket of each segment, and the ball around it."""
    rows = []
    for s, (shift, width, radius) in enumerate(_segments(max_bits, parts)):
        value = F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))
        tag = F.lit(s << 40)
        rows.append(F.array(F.struct((value + tag).alias("key"), F.lit(True).alias("member"))))
        flips = [sum(1 << j for j in c) for k in range(1, radius + 1) for c in combinations(range(width), k)]
        if flips:
            masks = F.array(*[F.lit(m).cast("bigint") for m in flips])
            # two values that differ by a mask: the one whose lowest differing bit is 0 asks
            asked = F.filter(masks, lambda m: value.bitwiseAND(m.bitwiseAND(-m)) == 0)
            rows.append(F.transform(asked, lambda m: F.struct((value.bitwiseXOR(m) + tag).alias("key"), F.lit(False).alias("member"))))
    return F.concat(*rows) if len(rows) > 1 else rows[0]


def _forest(fps: np.ndarray, key: np.ndarray, member: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fp, smaller fp) that connect what is linked in the groups of equal ``key`` (sorted)."""
    names, node = np.unique(fps, return_inverse=True)
    label = np.arange(len(names))
    at, step = np.arange(len(key)), 0
    while True:
        step += 1
        at = at[: np.searchsorted(at, len(key) - step)]
        at = at[key[at] == key[at + step]]
        if not len(at):
            break
        near = (member[at] | member[at + step]) & (np.bitwise_count(fps[at] ^ fps[at + step]) <= max_bits)
        u, v = node[at[near]], node[at[near] + step]
        while len(u):
            a, b = label[u], label[v]
            apart = a != b
            if not apart.any():
                break
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label != label[label]).any():
                label = label[label]
    moved = np.flatnonzero(label != np.arange(len(names)))
    return names[moved], names[label[moved]]


def links(prints: DataFrame, max_bits: int, *, parts: int = 3, bucket_rows: int = 4096) -> DataFrame:
    """Distinct fingerprints ``fp`` (long) to links ``(u, v)`` whose components are those of all links."""
    rows = prints.select("fp", F.explode(_bucket_rows(F.col("fp"), max_bits, parts)).alias("b")).select(
        "fp", F.col("b.key").alias("key"), F.col("b.member").alias("member")
    )
    large = (
        rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_rows)
        .select("key", F.ceil(F.col("n") / F.lit(bucket_rows)).cast("int").alias("blocks"))
    )
    own = F.pmod(F.xxhash64("fp", "key"), F.col("blocks")).cast("int")
    dealt = rows.join(large, "key", "left").select(
        "fp",
        "key",
        "member",
        F.explode(
            F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(
                F.transform(
                    F.sequence(F.lit(0), F.col("blocks") - 1),
                    lambda j: F.least(own, j) * F.col("blocks") + F.greatest(own, j),
                )
            )
        ).alias("block"),
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(fps, key, block, member):
            if not len(fps):
                return
            group = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]) | (block[1:] != block[:-1]))))
            u, v = _forest(fps, group, member, max_bits)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        held = [np.array([], t) for t in (np.uint64, np.int64, np.int64, bool)]
        for batch in batches:
            new = (
                batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64),
                batch.column(1).to_numpy(zero_copy_only=False),
                batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64),
                batch.column(3).to_numpy(zero_copy_only=False),
            )
            held = [np.concatenate(x) for x in zip(held, new)]
            if not len(held[0]):
                continue
            # the last group may go on in the next batch
            last = (held[1] == held[1][-1]) & (held[2] == held[2][-1])
            cut = int(np.argmax(last))
            yield from found(*[x[:cut] for x in held])
            held = [x[cut:] for x in held]
        yield from found(*held)

    grouped = dealt.repartition("key", "block").sortWithinPartitions("key", "block")
    return map_arrow(grouped.select("fp", "key", "block", "member"), run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """Links ``(u, v)`` of longs to stars ``(u, root)``: each linked u with the smallest of its component.

    Alternating large-star and small-star steps; the roots' own rows are not listed.
    """
    e = written(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"
    )
    seen = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        old, e = e, written(small, "links")
        discard(old)
        row = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == (row["n"], row["h"]) or not row["n"]:
            return e.select("u", F.col("v").alias("root"))
        seen = (row["n"], row["h"])


def near_duplicate_groups(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle_words: int = 4,
    max_bits: int = 4,
    carry: list[str] | None = None,
) -> DataFrame:
    """``docs`` (or its columns ``carry``) with ``fingerprint``, ``component_id``, ``representative``.

    ``fingerprint`` has 16 hex digits. ``component_id`` is the smallest ``doc_id`` of the
    connected component, null ids aside (null if all are null). ``representative`` is
    true for exactly one row of each component, of that smallest id. A null text counts
    as empty; texts without a word have fingerprint zero and link like any other. Texts
    with fewer words than a shingle are one shingle. Repeated rows stay, each with its
    group. An empty table gives an empty result. Input columns named like an output give
    way.
    """
    w = free_prefix(docs)
    fp, did, rid = f"{w}fp", f"{w}id", f"{w}row"
    keep = docs.withColumn(did, F.col(f"`{doc_id}`"))
    carried = [c for c in (docs.columns if carry is None else carry) if c.lower() not in OUTPUTS]
    prints = with_fingerprints(keep, fp, text=text, shingle_words=shingle_words, carry=[*carried, did])
    rows = written(prints.withColumn(rid, F.monotonically_increasing_id()), "fingerprints")
    first = F.struct(F.col(did).isNull().alias("no_id"), F.col(did).alias("id"), F.col(rid).alias("row"))
    prints = written(rows.groupBy(F.col(fp).alias("fp")).agg(F.min(first).alias("first")), "distinct-fingerprints")
    n = prints.count()
    stars = components(links(prints, max_bits, parts=3 if n < 1 << 27 else 2))
    let_go_of_shuffles(docs.sparkSession)
    rooted = prints.join(stars, prints["fp"] == stars["u"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "first"
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    by_print = rooted.join(least, "root").select(F.col("fp").alias(fp), F.col("least").alias(f"{w}least"))
    return rows.join(by_print, fp).select(
        *[F.col(f"`{c}`") for c in carried],
        F.lpad(F.lower(F.hex(fp)), 16, "0").alias("fingerprint"),
        F.col(f"{w}least")["id"].alias("component_id"),
        (F.col(f"{w}least")["row"] == F.col(rid)).alias("representative"),
    )
