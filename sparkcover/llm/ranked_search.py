"""Ranked lexical search by pipelined term partitioning.

The terms of the query items are dealt to a few *owners*, rarest terms first, each owner
about an equal share of all postings. Item bundles then travel from owner to owner: one
bundle per block of documents carries, for all items, the sparse accumulators ``(item,
document, score)`` found so far; the cogroup of stage ``s`` brings it together with owner
``s``'s postings of that block, which add their integer contributions. After the last
owner the best ``k`` documents of each item are selected.

* Documents stay where they are read: a task turns them into blocks of at most
  ``block_docs``, with the postings of the items' terms packed by term. A term that is in
  every document is thus cut into one short list per block, and no list ever meets whole.
* Accumulators are kept sparse without losing a result. After a stage, the ``k``-th best
  partial score of an item in any block bounds its final ``k``-th score from below; what an
  accumulator can still gain is bounded from above by the terms yet to come. One that can't
  reach the bound goes, and none is opened for a document that can't reach it.
* Items are taken in passes of about ``pass_bytes`` of their text, each run to its end
  before the next, so vocabulary, weights and item terms (which every task holds) are
  bounded however many items there are. A pass indexes the documents once; its items then
  travel in groups, one after the other, of which a bundle holds ``bundle_cells``
  accumulators at most, and bundles are stored in row groups of a few MB.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcover.llm.common import discard, map_arrow, written
from sparkcover.llm.decontaminate import words_of
from sparkcover.session import held_settings

SCALE = 1_000_000_000


def term_weight(n_docs: int, df: int) -> int:
    """``floor(1000 * ln((2N + 2) / (2df + 1)))``, in doubles."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_factor(n_terms, n_docs: int, all_terms: int):
    """``m``: 100 for a document of average length, 75 for an empty one (whole numbers)."""
    return 100 - 25 + (25 * n_terms * n_docs) // all_terms


def saturation(tf, m):
    return (SCALE * tf) // (1000 * tf + 12 * m)


def _i32(values) -> bytes:
    return np.asarray(values, np.int32).tobytes()


# Postings of a block, about: a block of long documents has fewer of them.
BLOCK_POSTINGS = 1 << 20
# Bundles are rows of up to 16 bytes per accumulator: writers look at their size after each row, and
# readers, who take a row group's rows together, get few.
_ROW_GROUPS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1"}
_FEW_ROWS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "8"}


def _indexer(vocabulary: dict[bytes, int], block_docs: int, id_type: pa.DataType):
    """Blocks of documents: one row of ids and lengths, and one row per term with its postings."""
    schema = pa.schema(
        [("block", pa.int64()), ("ids", pa.list_(id_type)), ("lengths", pa.binary()), ("term", pa.int32())]
        + [("places", pa.binary()), ("tfs", pa.binary()), ("top_tf", pa.int64()), ("least_n", pa.int64())]
    )

    def block_rows(block: int, ids: list, lengths: list, found: list) -> pa.RecordBatch:
        n = np.asarray(lengths, np.int64)
        rows = [(block, ids, n.tobytes(), None, None, None, None, None)]
        if found:
            terms, places, tfs = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(terms, kind="stable")
            terms, places, tfs = terms[order], places[order], tfs[order]
            for cut in np.split(np.arange(len(terms)), np.flatnonzero(np.diff(terms)) + 1):
                p, tf = places[cut], tfs[cut]
                rows.append((block, None, None, int(terms[cut[0]]), _i32(p), _i32(tf), int(tf.max()), int(n[p].min())))
        arrays = [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held = TaskContext.get().partitionId(), 0, 0
        ids, lengths, found = [], [], []
        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(data)
                if not words:
                    continue
                terms, tfs = np.unique([vocabulary[w] for w in words if w in vocabulary], return_counts=True)
                if len(terms):
                    found.append((terms.astype(np.int64), np.full(len(terms), len(ids)), tfs))
                    held += len(terms)
                ids.append(doc)
                lengths.append(len(words))
                if len(ids) == block_docs or held >= BLOCK_POSTINGS:
                    yield block_rows((task << 32) + made, ids, lengths, found)
                    made, held, ids, lengths, found = made + 1, 0, [], [], []
        if ids:
            yield block_rows((task << 32) + made, ids, lengths, found)

    return run


def _stage(wanted: dict[int, list[tuple[int, int]]], bound: list[int], opens: list[int], after: list[int], k: int, facts):
    """One owner's stage: ``wanted`` has each item's terms there, ``bound`` the score it must reach,
    ``opens`` and ``after`` what the terms from this stage on and after it can add."""
    n_docs, all_terms = facts

    def run(bundle: pa.Table, postings: pa.Table) -> pa.Table:
        if not bundle.num_rows:
            return bundle
        row = {c: bundle.column(c)[0].as_py() for c in ("lengths", "items", "places", "scores")}
        m = length_factor(np.frombuffer(row["lengths"], np.int64), n_docs, all_terms)
        carried = [np.frombuffer(row[c], t) for c, t in (("items", np.int32), ("places", np.int32), ("scores", np.int64))]
        cuts = np.searchsorted(carried[0], np.arange(len(bound) + 1))
        gains = {}
        for term, w, places, tfs in zip(*(postings.column(c).to_pylist() for c in ("term", "w", "places", "tfs"))):
            at, tf = np.frombuffer(places, np.int32), np.frombuffer(tfs, np.int32).astype(np.int64)
            gains[term] = (at, w * saturation(tf, m[at]))
        out, tops = [], []
        total = np.zeros(len(m), np.int64)
        for item in range(len(bound)):
            a, b = cuts[item], cuts[item + 1]
            here = [(gains[t], q) for t, q in wanted.get(item, ()) if t in gains]
            if a == b and not here:
                continue
            total[:] = 0
            total[carried[1][a:b]] = carried[2][a:b]
            for (at, gain), q in here:
                total[at] += q * gain
            if opens[item] < bound[item]:  # too late for a document not seen before
                known = total[carried[1][a:b]].copy()
                total[:] = 0
                total[carried[1][a:b]] = known
            places = np.flatnonzero(total)
            scores = total[places]
            need = bound[item]
            if len(scores) >= k:
                kth = int(np.partition(scores, -k)[-k])
                if kth > need:
                    tops.append((item, kth))
                    need = kth
            live = scores + after[item] >= need
            if live.any():
                out.append((np.full(int(live.sum()), item, np.int32), places[live].astype(np.int32), scores[live]))
        parts = [np.concatenate(x).tobytes() for x in zip(*out)] if out else [b"", b"", b""]
        columns = [bundle.column("block"), bundle.column("ids"), bundle.column("lengths")]
        names = ["block", "ids", "lengths", "items", "places", "scores", "tops"]
        tops_type = pa.list_(pa.struct([("item", pa.int32()), ("score", pa.int64())]))
        tops_column = pa.array([[{"item": i, "score": s} for i, s in tops]], tops_type)
        return pa.table([*columns, *[pa.array([p], pa.binary()) for p in parts], tops_column], names=names)

    return run


def _found(bound: list[int], id_type: pa.DataType):
    """The accumulators that reach the bound as rows ``(item, doc, score)``."""
    schema = pa.schema([("item", pa.int32()), ("doc", id_type), ("score", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.asarray(bound, np.int64)
        for batch in batches:
            for ids, items, places, scores in zip(*(x.to_pylist() for x in batch.columns)):
                i, p, s = (np.frombuffer(x, t) for x, t in ((items, np.int32), (places, np.int32), (scores, np.int64)))
                keep = s >= least[i]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(i[keep]), pa.array([ids[x] for x in p[keep]], id_type), pa.array(s[keep])], schema=schema
                )

    return run


def _passes(items: DataFrame, pass_bytes: int) -> Iterator[list]:
    """The items in lists of about ``pass_bytes`` of text."""
    total = items.agg(F.sum(F.octet_length("t")).alias("b")).first()["b"] or 0
    n = max(1, -(-int(total) // pass_bytes))
    for p in range(n):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == p).collect()
        if rows:
            yield rows


def _search_pass(
    docs: DataFrame, rows: list, id_field, k: int, owners: int, block_docs: int, bundle_cells: int
) -> DataFrame | None:
    """The documents indexed by the words of the pass's items, then group by group of these its ranks."""
    counts = [Counter(words_of(bytes(r["t"]))) for r in rows]
    vocabulary = {w: n for n, w in enumerate(sorted(set().union(*counts)))}
    if not vocabulary:
        return None
    doc_type = docs.schema["doc"].dataType
    arrow_id = pa.schema([("x", docs.select("doc").limit(0).toArrow().schema.field(0).type)]).field(0).type
    ddl = T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("ids", T.ArrayType(doc_type)),
            T.StructField("lengths", T.BinaryType()),
            T.StructField("term", T.IntegerType()),
            T.StructField("places", T.BinaryType()),
            T.StructField("tfs", T.BinaryType()),
            T.StructField("top_tf", T.LongType()),
            T.StructField("least_n", T.LongType()),
        ]
    )
    index = written(map_arrow(docs, _indexer(vocabulary, block_docs, arrow_id), ddl), "search-index")
    lengths = index.where("lengths is not null").select(F.col("lengths"))
    n_docs, all_terms = _lengths_total(lengths)
    terms = index.where("term is not null").groupBy("term").agg(
        F.sum(F.octet_length("places") / 4).cast("bigint").alias("df"),
        F.max("top_tf").alias("top_tf"),
        F.min("least_n").alias("least_n"),
    )
    terms = [(r["term"], r["df"], r["top_tf"], r["least_n"]) for r in terms.collect()]  # bounded by the pass's text
    facts = {}
    for t, n, top_tf, least_n in terms:
        if (w := term_weight(n_docs, n)) > 0:
            facts[t] = (n, w, w * saturation(top_tf, length_factor(least_n, n_docs, all_terms)))
    size = max(1, bundle_cells // block_docs)
    found = []
    for lo in range(0, len(rows), size):
        group = [{vocabulary[w]: q for w, q in c.items() if vocabulary[w] in facts} for c in counts[lo : lo + size]]
        if any(group):
            ids = [r["i"] for r in rows[lo : lo + size]]
            found.append(_search_group(index, ids, group, facts, (n_docs, all_terms), id_field, doc_type, arrow_id, k, owners))
    discard(index)
    if len(found) < 2:
        return found[0] if found else None
    out = written(reduce(DataFrame.unionByName, found), "search")
    discard(*found)
    return out


def _search_group(
    index: DataFrame, item_ids: list, counts: list[dict[int, int]], facts: dict, totals: tuple[int, int], id_field, doc_type,
    arrow_id, k: int, owners: int,
) -> DataFrame:
    """The ranks of a group of items, of which ``counts`` has the terms; ``facts`` has each term's
    document frequency, weight and the most that it can add."""
    spark = index.sparkSession
    weight = {t: facts[t][1] for c in counts for t in c}
    df, most = {t: facts[t][0] for t in weight}, {t: facts[t][2] for t in weight}
    owner, seen, postings = {}, 0, sum(df.values())
    for t in sorted(weight, key=lambda t: (-weight[t], t)):
        owner[t] = min(owners - 1, seen * owners // max(1, postings))
        seen += df[t]
    wanted: list[dict[int, list]] = [{} for _ in range(owners)]
    gain = [[0] * len(counts) for _ in range(owners + 1)]  # what the terms from an owner on can add
    for item, terms_here in enumerate(counts):
        for t, q in terms_here.items():
            wanted[owner[t]].setdefault(item, []).append((t, q))
            for s in range(owner[t] + 1):
                gain[s][item] += q * most[t]
    weights = F.broadcast(spark.createDataFrame([(t, owner[t], weight[t]) for t in owner], "term int, owner int, w bigint"))
    owned = index.where("term is not null").join(weights, "term").select("block", "term", "w", "places", "tfs", "owner")
    nothing = F.lit(b"")
    again = spark.read.schema(index.schema).parquet(index._scratch_path)  # a cogroup wants two plans
    bundles = again.where("lengths is not null").select(
        "block", "ids", "lengths", nothing.alias("items"), nothing.alias("places"), nothing.alias("scores")
    )
    tops = T.StructField(
        "tops",
        T.ArrayType(T.StructType([T.StructField("item", T.IntegerType()), T.StructField("score", T.LongType())])),
    )
    schema = T.StructType([*bundles.schema.fields, tops])
    bound = [1] * len(counts)
    old = None
    for s in range(owners):
        if s not in owner.values():
            continue
        visit = _stage(wanted[s], list(bound), gain[s], gain[s + 1], k, totals)
        arrived = bundles.groupBy("block").cogroup(owned.where(F.col("owner") == s).drop("owner").groupBy("block"))
        bundles = written(arrived.applyInArrow(visit, schema), "search-bundles", _ROW_GROUPS)
        if old is not None:
            discard(old)
        old = bundles
        raised = bundles.select(F.explode("tops").alias("x")).groupBy("x.item").agg(F.max("x.score").alias("score"))
        for r in raised.collect():  # one number per item of the group
            bound[r["item"]] = max(bound[r["item"]], r["score"])
        bundles = bundles.drop("tops")
    hits = map_arrow(
        bundles.select("ids", "items", "places", "scores"),
        _found(list(bound), arrow_id),
        T.StructType(
            [T.StructField("item", T.IntegerType()), T.StructField("doc", doc_type), T.StructField("score", T.LongType())]
        ),
    )
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc("doc"))
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", id_field.dataType)])
    named = F.broadcast(spark.createDataFrame(list(enumerate(item_ids)), names))
    with held_settings(spark, _FEW_ROWS):
        out = written(ranked.join(named, "item").select("item_id", "rank", F.col("doc").alias("doc_id"), "score"), "search")
    discard(old)
    return out


def _lengths_total(lengths: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all their terms."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [np.frombuffer(x, np.int64) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"docs": [len(x) for x in n], "terms": [int(x.sum()) for x in n]})

    row = map_arrow(lengths, run, "docs bigint, terms bigint").agg(F.sum("docs").alias("d"), F.sum("terms").alias("t")).first()
    return int(row["d"] or 0), int(row["t"] or 0)


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    *,
    k: int = 20,
    owners: int = 4,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_docs: int = 2048,
    pass_bytes: int = 1 << 20,
    bundle_cells: int = 1 << 19,
) -> DataFrame:
    """The ``k`` best documents of each item: ``(item_id, rank, doc_id, score)``.

    ``rank`` counts from 1, equal scores by ascending ``doc_id`` (null first). Only scores
    above 0 appear, so an item may have fewer rows or none. Null and wordless texts, of
    documents as of items, have no terms and take no part. Each row of ``docs`` is a document
    of its own; rows of ``items`` that repeat both id and text are one item, those of one id
    with different texts are ranked apart. Other columns, whatever their names, are not read.
    Empty tables give no rows. Texts are read whole.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc"), F.col(f"`{text}`").cast("binary").alias("t")).where("t is not null")
    queries = (
        items.select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{item_text}`").cast("binary").alias("t"))
        .where("t is not null")
        .distinct()
    )
    id_field = queries.schema["i"]
    out = None
    for batch in _passes(queries, pass_bytes):
        found = _search_pass(rows, batch, id_field, k, owners, block_docs, bundle_cells)
        if found is not None:
            out = found if out is None else out.unionByName(found)
    if out is None:
        empty = [id_field.dataType, T.IntegerType(), rows.schema["doc"].dataType, T.LongType()]
        names = ["item_id", "rank", "doc_id", "score"]
        return docs.sparkSession.createDataFrame([], T.StructType([T.StructField(n, t) for n, t in zip(names, empty)]))
    return out
