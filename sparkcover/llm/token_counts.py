"""Token counts per section from one encoding of the whole document.

A byte-level tokenizer encodes the whole text once; the lengths of the tokens give
their byte spans, and an interval join (two binary searches in sorted boundaries)
maps them to the sections. A token that crosses a section boundary is allotted by an
explicit rule: ``start`` (the section of its first byte), ``end`` (of its last byte)
or ``most`` (the section that holds most of its bytes; ties to the earlier one).
Every token is counted exactly once.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcover.llm.common import map_arrow

OUTPUTS = ("section", "start_char", "n_section_chars", "n_tokens", "n_crossing", "doc_tokens")
RULES = ("start", "end", "most")
_LINE = re.compile(r"[^\n]*\n|[^\n]+")


class ByteTokenizer:
    """Byte-level BPE from a rank file; its tokens' bytes joined are the text."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def ends(self, text: str) -> np.ndarray:
        """Byte offset after each token."""
        return np.cumsum(self.lengths[self.encoding.encode_ordinary(text)])


def line_sections(text: str) -> list[int]:
    """Start characters of the lines; a line keeps its newline. An empty text has none."""
    return [m.start() for m in _LINE.finditer(text)]


def allot(ends: np.ndarray, starts: np.ndarray, total: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens per section and how many of them cross a boundary.

    ``ends``: byte offset after each token; ``starts``: byte offset of each section.
    """
    begin = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    first = np.searchsorted(starts, begin, "right") - 1
    last = np.searchsorted(starts, ends - 1, "right") - 1
    crossing = first != last
    owner = first.copy() if rule != "end" else last.copy()
    if rule == "most":
        limits = np.append(starts, total)
        for i in np.flatnonzero(crossing):
            edges = np.clip(limits[first[i] : last[i] + 2], begin[i], ends[i])
            owner[i] = first[i] + int(np.argmax(np.diff(edges)))
    n = len(starts)
    return np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n)


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    pattern: str,
    *,
    text: str = "text",
    rule: str = "most",
    carry: list[str] | None = None,
) -> DataFrame:
    """One row per section (line) of each document, with its share of the document's tokens.

    Per section: the document's columns ``carry`` (default: all but the text),
    ``section`` (from 0), ``start_char`` and ``n_section_chars`` in characters,
    ``n_tokens``, ``n_crossing`` (of these, tokens that also cover another section),
    ``doc_tokens``. The counts of a document add up to ``doc_tokens``. A null or empty
    text is one empty section without tokens. Repeated rows are counted as often as
    they come; an empty table gives an empty result; carried columns named like an
    output give way.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    keep = [c for c in docs.columns if c != text] if carry is None else list(carry)
    keep = [c for c in keep if c.lower() not in OUTPUTS]
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("section"))
    schema = T.StructType(
        source.schema.fields[:-1]
        + [T.StructField("section", T.IntegerType())]
        + [T.StructField(c, T.LongType()) for c in OUTPUTS[1:]]
    )
    n = len(keep)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = ByteTokenizer(tokenizer_path, pattern)
        for batch in batches:
            row, parts = [], []
            for k, text_value in enumerate(batch.column(n).to_pylist()):
                value = text_value or ""
                starts = line_sections(value) or [0]
                chars = np.append(starts, len(value))
                if value.isascii():
                    at, total = np.array(starts, np.int64), len(value)
                else:
                    sizes = [len(value[a:b].encode("utf-8")) for a, b in zip(chars[:-1], chars[1:])]
                    at, total = np.cumsum([0, *sizes[:-1]]), sum(sizes)
                ends = tokenizer.ends(value) if value else np.array([], np.int64)
                if len(ends):
                    counts, crossing = allot(ends, at, total, rule)
                else:
                    counts = crossing = np.zeros(len(starts), np.int64)
                row.append(np.full(len(starts), k))
                parts.append((np.arange(len(starts)), chars[:-1], np.diff(chars), counts, crossing, np.full(len(starts), len(ends))))
            if not row:
                continue
            which = pa.array(np.concatenate(row))
            columns = [np.concatenate(c) for c in zip(*parts)]
            out = pa.RecordBatch.from_arrays(
                [
                    *[c.take(which) for c in batch.columns[:n]],
                    pa.array(columns[0], pa.int32()),
                    *[pa.array(c, pa.int64()) for c in columns[1:]],
                ],
                names=schema.fieldNames(),
            )
            for i in range(0, out.num_rows, 50_000):
                yield out.slice(i, 50_000)

    return map_arrow(source, run, schema)
