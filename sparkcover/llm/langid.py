"""Language identification by compression with one dictionary per language.

A raw-content zstandard dictionary of sample text is kept per language. A text is
folded (lower case, every stretch without letters one space), cut into blocks of
``block_bytes``, and every block is compressed by itself with each dictionary; the
language with the smallest sum wins. Blocks keep the dictionaries decisive however
long the text is, and the whole text counts.

The dictionaries are fitted on a bounded sample: at most ``docs_per_language`` labelled
rows (those of smallest id hash) and ``dictionary_bytes`` of text per language. They
are the only thing that is sent to the tasks: number of labels times that bound.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcover.llm.common import kept_columns, map_arrow

OUTPUTS = ("lang_pred", "score", "accepted")
UNKNOWN = "und"
DOCS_PER_LANGUAGE = 128
DICTIONARY_BYTES = 1 << 15
BLOCK_BYTES = 1 << 12
MIN_MARGIN = 0.002
_NO_LETTERS = re.compile(r"[\W\d_]+")


def folded(text: str) -> bytes:
    return _NO_LETTERS.sub(" ", text.lower()).encode("utf-8")


def fit_dictionaries(
    docs: DataFrame,
    learn: Column,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    docs_per_language: int = DOCS_PER_LANGUAGE,
    dictionary_bytes: int = DICTIONARY_BYTES,
) -> dict[str, bytes]:
    """Sample text per language from rows where ``learn`` holds, ``lang`` and text are not null.

    The rows of smallest id hash are taken, equal hashes once; each text gives an
    equal share of the dictionary at most, unless others are shorter. The order of
    the result is the preference among ties: languages of more distinct rows first.
    """
    rows = docs.where(learn & F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull()).select(
        F.col(f"`{lang}`").alias("lang"), F.xxhash64(F.col(f"`{doc_id}`")).alias("h"), F.col(f"`{text}`").alias("text")
    )
    rank = Window.partitionBy("lang").orderBy("h")
    ids = rows.select("lang", "h").distinct()
    bounds = (
        ids.withColumn("k", F.row_number().over(rank)).where(F.col("k") <= docs_per_language)
        .groupBy("lang").agg(F.max("h").alias("h")).collect()
    )
    frequency = {r["lang"]: r["n"] for r in ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not bounds:
        return {}
    chosen = F.lit(False)
    for r in bounds:
        chosen = chosen | ((F.col("lang") == F.lit(r["lang"])) & (F.col("h") <= F.lit(r["h"])))
    samples: dict[str, list[bytes]] = {}
    picked = rows.where(chosen).groupBy("lang", "h").agg(
        F.min(F.substring("text", 1, dictionary_bytes)).alias("text")
    )
    for r in picked.orderBy("lang", "h").collect():
        data = folded(r["text"])
        if data not in samples.setdefault(r["lang"], []):
            samples[r["lang"]].append(data)
    out = {}
    for name, texts in samples.items():
        share, room, parts = 0, dictionary_bytes, []
        for k, data in enumerate(sorted(texts, key=len)):
            share = room // (len(texts) - k)
            parts.append(data[:share])
            room -= len(parts[-1])
        out[name] = b" ".join(parts)
    order = sorted(out, key=lambda k: (-frequency.get(k, 0), k))
    return {k: out[k] for k in order if len(out[k]) >= 8}


class Compressors:
    """Sizes of a text under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], block_bytes: int = BLOCK_BYTES):
        self.names = list(dictionaries)
        self.block = block_bytes
        self.each = []
        for data in dictionaries.values():
            tuning = zstandard.ZstdCompressionParameters(
                window_log=17,
                hash_log=15,
                chain_log=15,
                search_log=3,
                min_match=4,
                target_length=32,
                strategy=zstandard.STRATEGY_LAZY2,
                write_content_size=False,
                write_checksum=False,
                write_dict_id=False,
            )
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=tuning)
            self.each.append(zstandard.ZstdCompressor(compression_params=tuning, dict_data=d).compress)

    def sizes(self, data: bytes) -> list[int]:
        parts = [data[i : i + self.block] for i in range(0, len(data), self.block)]
        return [sum(len(c(p)) for p in parts) for c in self.each]


def classify(c: Compressors, text: str | None, min_margin: float) -> tuple[str, float, bool]:
    """(language, score, accepted). Ties go to the language listed first."""
    if text is None or not c.names or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0, False
    sizes = c.sizes(folded(text))
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
    best = sizes[order[0]]
    if len(order) == 1:
        return c.names[order[0]], 1.0, True
    second = sizes[order[1]]
    score = 1.0 / sum(math.exp(-min(50.0, 0.25 * (s - best))) for s in sizes)
    return c.names[order[0]], score, second - best > min_margin * second


def identify(
    docs: DataFrame,
    dictionaries: dict[str, bytes],
    *,
    text: str = "text",
    min_margin: float = MIN_MARGIN,
    carry: list[str] | None = None,
) -> DataFrame:
    """``docs`` (or its columns ``carry``) with ``lang_pred``, ``score`` and ``accepted``.

    ``lang_pred`` is the language of the smallest encoding, ``und`` where the text is
    null or has no letter (or nothing was learned). ``score`` (0 to 1) compares the
    sizes. ``accepted`` is false for ``und`` and where the margin to the second
    smallest is at most ``min_margin`` of its size. Repeated rows are judged alike;
    an empty table gives an empty result; input columns named like an output give way.
    """
    keep = [c for c in (docs.columns if carry is None else carry) if c.lower() not in OUTPUTS]
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("lang_pred"))
    schema = T.StructType(
        source.schema.fields
        + [T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = Compressors(dictionaries)
        for batch in batches:
            found = [classify(compressors, t, min_margin) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                    pa.array([f[2] for f in found], pa.bool_()),
                ],
                names=schema.fieldNames(),
            )

    return map_arrow(source, run, schema).select(*kept_columns(source.drop("lang_pred"), ()), *OUTPUTS)
