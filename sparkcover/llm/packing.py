"""Packing token sequences by the sum-of-squares rule.

Documents come one after the other. A document of at least one window is cut: its
whole windows are sequences of their own. The rest, of ``s`` tokens, goes to the fill
level ``h`` that leaves the smallest sum of squares of the numbers of partially filled
windows per level: taking one from level ``h`` and adding one at ``h + s``. The numbers
are kept in an array by level, so a choice is one pass over it.

At the end of a task its partially filled windows are closed: the emptiest are taken
apart and cut to top up the fullest, so at most one window per task has padding.

Packing is done where the rows lie, without a shuffle. Sequence numbers hold the
task's partition, so they are unique; a repeated task deals its rows again alike.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcover.llm.common import map_arrow

OUTPUTS = ("start", "length", "ids", "doc_tokens", "sequence_id", "offset")

_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
# what the tokenizer's own pattern finds in lower-cased ASCII, and in Latin letters with accents
_ASCII = re.compile(f"{_CONTRACTIONS}|[a-z]+|[0-9]|[^a-z0-9]+".encode())
_LATIN = re.compile(rf"{_CONTRACTIONS}|[^\W\d_]+|\d|(?:[^\w ]|_)+")
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_ODD_LATIN = frozenset("\u00b2\u00b3\u00b9\u00bc\u00bd\u00be")  # numbers that Python's classes call letters
_WESTERN = bytes([*range(0xC0), 0xC3])  # bytes of ASCII and of U+00C0 to U+00FF
_TRAILING = b".,;:!?*#%&$|()"  # no apostrophe: it may start a contraction
_END = b"\xff"  # marks a word's end; never a byte of UTF-8


def _byte_letters() -> dict[str, int]:
    """The printable letter of each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _merged(parts: list[bytes], order: dict[tuple[bytes, bytes], int]) -> list[bytes]:
    """Byte-pair merges of a word, by order of the merge rules."""
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: order.get((parts[i], parts[i + 1]), 1 << 40))
        if (parts[best], parts[best + 1]) not in order:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


def _merge_engine(path: str):
    """``bytes of one word -> bytes of ids`` by the vocabulary's merges, or None if it is of another make.

    A merge by the rank of the joined bytes equals one by the rule for the pair whenever
    every token arises from its own bytes; tokens that don't can't arise in a word either
    and are left out. So the ids are those of the tokenizer itself.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    model, split = made["model"], made["pre_tokenizer"].get("pretokenizers", [{}])[0]
    usual = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "byte_fallback": False}
    if any(model.get(k) != v for k, v in usual.items()) or split.get("pattern", {}).get("Regex") != _PATTERN:
        return None
    if [n["type"] for n in made["normalizer"].get("normalizers", [])] != ["NFC", "Replace", "Lowercase"]:
        return None
    letters = _byte_letters()

    def raw(token: str) -> bytes:
        end = token.endswith("</w>") and len(token) > 4
        return bytes(letters[c] for c in (token[:-4] if end else token)) + _END * end

    ids = {raw(t): i for t, i in model["vocab"].items() if letters.get(t[0]) != 255}
    pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    order = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
    ranks = {bytes([b]): b for b in range(256)}
    for b in range(255):
        ranks[bytes([b]) + _END] = 256 + b
    real = np.zeros(512 + len(order), np.int64)
    for token, rank in ranks.items():
        real[rank] = ids.get(token, -1)
    for (a, b), k in order.items():
        token = a + b
        first = [bytes([x]) for x in token.removesuffix(_END)]
        if token.endswith(_END):
            first[-1] += _END
        if token not in ranks and token in ids and _merged(first, order) == [token]:
            ranks[token] = 512 + k
            real[512 + k] = ids[token]
    engine = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
    coded = [struct.pack("<I", max(0, r)) for r in real.tolist()]
    return lambda word: b"".join([coded[r] for r in engine.encode_single_piece(word + _END)])


class _Filled(dict):
    """A dictionary that works out what it doesn't hold."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, key):
        value = self[key] = self.of(key)
        return value


class WordEncoder:
    """Token ids of texts under a tokenizer whose words never cross ASCII white space.

    Each distinct stretch between white space is encoded once; a bounded cache keeps its
    ids, as little-endian unsigned 32-bit bytes. Stretches of Latin script are split and
    merged here, all others by the tokenizer itself.
    """

    def __init__(self, path: str, cache_words: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = _merge_engine(path)
        self.pieces = _Filled(self.merge)  # words often differ in case or punctuation only
        self.cache = _Filled(self._encode_word)
        self.cache_words = cache_words

    def _split(self, word: bytes) -> list[bytes] | None:
        """The words a stretch is split into, or None where only the tokenizer knows."""
        if self.merge is None or b"<|" in word:  # special tokens
            return None
        if word.isascii():
            stem = word.rstrip(_TRAILING)
            if stem.isalpha():
                return [stem.lower()] if len(stem) == len(word) else [stem.lower(), word[len(stem) :]]
            return _ASCII.findall(word.lower())
        if not word.translate(None, _WESTERN):  # nothing to compose, and lower case is one letter for one
            text = word.decode("utf-8").lower()
            return [text.encode("utf-8")] if text.isalpha() else [p.encode("utf-8") for p in _LATIN.findall(text)]
        text = word.decode("utf-8")
        if max(text) >= "\u0250":
            return None
        text = self.tokenizer.normalizer.normalize_str(text)
        if max(text) >= "\u0250" or not _ODD_LATIN.isdisjoint(text):
            return None
        return [p.encode("utf-8") for p in _LATIN.findall(text)]

    def _encode_word(self, word: bytes) -> bytes:
        pieces = self._split(word)
        if pieces is None:
            return np.array(self.tokenizer.encode(word.decode("utf-8"), add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join([self.pieces[p] for p in pieces])

    def encode(self, text: bytes) -> bytes:
        for held in (self.cache, self.pieces):
            if len(held) > self.cache_words:
                held.clear()  # frequent words are back at once
        return b"".join(map(self.cache.__getitem__, text.split()))


_encoders: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """The process's encoder for a vocabulary file: later tasks find its cache filled."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class SumOfSquares:
    """Online packing of pieces into windows of ``capacity``; a piece is ``(length, payload)``."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.level = np.zeros(capacity + 1, np.int64)  # open windows by fill
        self.open: dict[int, list[list]] = {}

    def choose(self, size: int) -> int:
        """Fill level for a piece of ``size`` < capacity: 0 opens a window; ties to the fullest."""
        top = self.capacity - size
        cost = 2 * self.level[size : size + top + 1] + 1
        cost[top] = 0  # a full window is no longer partially filled
        here = self.level[: top + 1]
        cost[1:] -= 2 * here[1:] - 1
        cost[1:][here[1:] == 0] = np.iinfo(np.int64).max
        return top - int(np.argmin(cost[::-1]))

    def place(self, size: int, payload) -> list | None:
        """Put a piece; returns the window's pieces if that filled it."""
        h = self.choose(size)
        if h:
            windows = self.open[h]
            window = windows.pop()
            self.level[h] -= 1
        else:
            window = []
        window.append((size, payload))
        if h + size == self.capacity:
            return window
        self.level[h + size] += 1
        self.open.setdefault(h + size, []).append(window)
        return None

    def close(self, cut) -> Iterator[list]:
        """Windows that hold what is left, all full but one at most. ``cut(payload, at)`` splits one."""
        left = [w for h in sorted(self.open, reverse=True) for w in self.open[h]]
        fills = [sum(s for s, _ in w) for w in left]
        self.open, self.level[:] = {}, 0
        i, j = 0, len(left) - 1
        while i < j:
            gap = self.capacity - fills[i]
            size, payload = left[j].pop()
            if size > gap:
                head, tail = cut(payload, gap)
                left[j].append((size - gap, tail))
                size, payload = gap, head
            left[i].append((size, payload))
            fills[i] += size
            fills[j] -= size
            if not left[j]:
                j -= 1
            if fills[i] == self.capacity:
                yield left[i]
                i += 1
        if i == j and left[i]:
            yield left[i]


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    text: str = "text",
    carry: list[str] | None = None,
    capacity: int = 2048,
    end_id: int = 1,
) -> DataFrame:
    """Pieces of the documents' token sequences in windows of ``capacity`` tokens.

    Each document is its ids and then ``end_id``. Per piece: the columns ``carry`` of
    its document (default: all but the text), ``start`` (the document's ids before
    it), ``length``, ``ids`` (binary, little-endian unsigned 32-bit), ``doc_tokens``
    (with the end id), ``sequence_id`` and ``offset`` there, gapless from 0. Every id
    lies in exactly one piece. A null or empty text is its end id alone; a very long
    text is cut. Repeated rows are packed as often as they come; an empty table gives
    an empty result. Carried columns named like an output give way.
    """
    keep = [c for c in docs.columns if c != text] if carry is None else list(carry)
    keep = [c for c in keep if c.lower() not in OUTPUTS]
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("binary").alias("ids"))
    schema = T.StructType(
        source.schema.fields[:-1]
        + [
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("doc_tokens", T.LongType()),
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
        ]
    )
    n = len(keep)
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path)
        packer = SumOfSquares(capacity)
        base = TaskContext.get().partitionId() << 40
        kinds: list[pa.DataType] = []
        rows: list[tuple] = []
        sizes = [0, 0]  # bytes of ids in rows, windows so far

        def put(window: list) -> None:
            offset = 0
            for size, (doc, start, ids, total) in window:
                rows.append((*doc, start, size, ids, total, base + sizes[1], offset))
                offset += size
                sizes[0] += len(ids)
            sizes[1] += 1

        def flush() -> pa.RecordBatch:
            types = kinds + [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            rows.clear()
            sizes[0] = 0
            return pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

        def split(piece: tuple, at: int) -> tuple[tuple, tuple]:
            doc, start, ids, total = piece
            return (doc, start, ids[: 4 * at], total), (doc, start + at, ids[4 * at :], total)

        for batch in batches:
            kinds = [c.type for c in batch.columns[:n]]
            values = list(zip(*[c.to_pylist() for c in batch.columns[:n]])) if n else [()] * batch.num_rows
            for doc, text in zip(values, batch.column(n).to_pylist()):
                ids = encoder.encode(text or b"") + tail
                total = len(ids) // 4
                start = 0
                while total - start >= capacity:
                    put([(capacity, (doc, start, ids[4 * start : 4 * (start + capacity)], total))])
                    start += capacity
                if start < total:
                    full = packer.place(total - start, (doc, start, ids[4 * start :], total))
                    if full:
                        put(full)
                if sizes[0] > 4 << 20:
                    yield flush()
        for window in packer.close(split):
            put(window)
        if rows:
            yield flush()

    return map_arrow(source, run, schema)
