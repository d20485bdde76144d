"""Toxicity scores from a weighted lexicon matched by an Aho-Corasick automaton.

Texts are folded first: compatibility forms, lower case, look-alike letters of other
scripts to Latin ones, digits and signs that stand for letters inside a word to those
letters; everything else becomes single spaces. Lexicon words match whole words;
matches inside an exception phrase don't count. The sum of the weights of the matches
is normalised by a power of the text's length and mapped to a probability by a
monotone step function fitted on labelled rows.

The lexicon is learned on a bounded sample of at most ``sample_rows`` labelled rows,
half of them toxic where there are as many: words that occur in toxic texts more often
than by chance, of which about ``FALSE_SHARE`` at most are chance finds (Benjamini and
Hochberg). So a language with few labelled rows keeps its words. An occurrence counts by its context (the words around it), so copies and near
copies of one text count once. The automaton is built for ``block_entries`` entries at
a time; a longer lexicon takes more passes over the rows, which stay where they are.
The step function is fitted on counts over all labelled rows that are given.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcover.llm.common import free_prefix, kept_columns, map_arrow, written

OUTPUTS = ("n_hits", "raw", "n_words")
SAMPLE_ROWS = 30_000
FALSE_SHARE = 0.05
BLOCK_ENTRIES = 50_000
EXPONENTS = (0.0, 0.1, 0.25, 0.5, 1.0)
_BINS = 64

# Letters of other scripts that look like Latin ones ...
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i",
}
# ... and digits and signs written for letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
# Phrases in which a lexicon word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "lost and found", "idiot proof")

_LETTERS = str.maketrans(LOOK_ALIKES)
_LOOK_ALIKE = re.compile("[" + "".join(LOOK_ALIKES) + "]")
_MARKS = re.compile("[" + re.escape("".join(DIGITS)) + "]+")
_AS_LETTERS = str.maketrans(DIGITS)
_NO_SIGNS = str.maketrans("@$!", "   ")
_PUNCTUATION = re.compile(r"[^\w\s]|_")


def _unmask(m: re.Match) -> str:
    """Letters for a run of digits and signs that touches a word; else its digits alone."""
    text, start, end = m.string, m.start(), m.end()
    left, right = start > 0 and text[start - 1].isalpha(), end < len(text) and text[end].isalpha()
    if left and right:
        return m[0].translate(_AS_LETTERS)
    run = m[0].strip("!")  # at a word's edge that is punctuation
    if left and not m[0].startswith("!") and (end == len(text) or not text[end].isalnum()):
        return run.translate(_AS_LETTERS) + " "
    if right and not m[0].endswith("!") and (start == 0 or not text[start - 1].isalnum()):
        return " " + run.translate(_AS_LETTERS)
    return m[0].translate(_NO_SIGNS)


def folded(text: str) -> str:
    """Folded words, one space before and after each."""
    if text.isascii():
        text = text.lower()
    else:
        text = unicodedata.normalize("NFKC", text).lower()
        if _LOOK_ALIKE.search(text):
            text = text.translate(_LETTERS)
    text = _PUNCTUATION.sub(" ", _MARKS.sub(_unmask, text))
    return " " + " ".join(text.split()) + " "


def _log_ratio(a: int, b: int, p: float) -> float:
    """Likelihood ratio statistic of ``a`` toxic and ``b`` other occurrences against the common share ``p``."""
    n = a + b
    return 2 * (a * math.log(a / n / p) + (b * math.log(b / n / (1 - p)) if b else 0.0))


def _least_surprise(pairs: list[tuple[int, int, int]], p: float, words: int) -> float:
    """The smallest statistic a word needs when at most ``FALSE_SHARE`` of those taken may be chance finds.

    ``pairs``: toxic and other occurrences, and how many of the ``words`` words have them.
    """
    ranked = sorted(((_log_ratio(a, b, p), n) for a, b, n in pairs), reverse=True)
    least, taken = math.inf, 0
    for at, (statistic, n) in enumerate(ranked):
        taken += n
        if at + 1 < len(ranked) and ranked[at + 1][0] == statistic:
            continue  # equal ones are taken together
        if math.erfc(math.sqrt(max(statistic, 0.0) / 2)) / 2 <= FALSE_SHARE * taken / words:
            least = statistic
    return least


def learn_lexicon(docs: DataFrame, labels: DataFrame, *, doc_id: str, text: str, label: str, sample_rows: int) -> DataFrame:
    """``(word, weight)`` of the words that go with label 1, from a bounded sample of labelled rows."""
    known = (
        labels.where(F.col(f"`{doc_id}`").isNotNull() & F.col(f"`{label}`").isNotNull())
        .groupBy(F.col(f"`{doc_id}`").alias("i")).agg(F.max(F.col(f"`{label}`").cast("int")).alias("y"))
    )
    size = known.agg(F.count_if(F.col("y") == 1).alias("a"), F.count_if(F.col("y") != 1).alias("b")).first()
    n_toxic = min(size["a"], max(sample_rows // 2, sample_rows - size["b"]))
    drawn = lambda rows, n: rows.orderBy(F.xxhash64("i"), "i").limit(n)
    known = drawn(known.where("y = 1"), n_toxic).unionByName(drawn(known.where("y <> 1"), sample_rows - n_toxic))
    # at most sample_rows rows of an id and a number
    rows = docs.select(F.col(f"`{doc_id}`").alias("i"), F.col(f"`{text}`").cast("string").alias("t")).join(F.broadcast(known), "i")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, labelled, contexts = [], [], []
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                row = folded(t or "").split()
                first = {}
                for k in range(len(row) - 1, -1, -1):
                    first[row[k]] = k
                for word, k in first.items():
                    words.append(word)
                    labelled.append(y)
                    contexts.append(zlib.crc32(" ".join(row[max(0, k - 1) : k + 2 if k else 3]).encode("utf-8")))
                if len(words) > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(labelled, pa.int32()), pa.array(contexts, pa.int64())], names=["word", "y", "c"])
                    words, labelled, contexts = [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(labelled, pa.int32()), pa.array(contexts, pa.int64())], names=["word", "y", "c"])

    seen = map_arrow(rows.select("t", "y"), run, "word string, y int, c long").distinct()
    counts = seen.groupBy("word").agg(F.count_if(F.col("y") == 1).alias("a"), F.count_if(F.col("y") != 1).alias("b")).persist()
    total = counts.agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count(F.lit(1)).alias("v")).first()
    if not total["a"] or not total["b"]:
        counts.unpersist()
        return docs.sparkSession.createDataFrame([], "word string, weight double")
    p = total["a"] / (total["a"] + total["b"])
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    n = a + b
    # likelihood ratio against the common share p
    surprise = 2 * (a * F.log(a / n / p) + F.when(b > 0, b * F.log(F.greatest(b, F.lit(1.0)) / n / (1 - p))).otherwise(0.0))
    likely = counts.where("a > 0").where(a / n > p)
    pairs = likely.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).collect()  # few: most words are rare
    least = _least_surprise([(r["a"], r["b"], r["n"]) for r in pairs], p, total["v"])
    weight = F.log((a + 0.5) / (b + 0.5)) - math.log(p / (1 - p))
    chosen = likely.where(surprise >= F.lit(least * (1 - 1e-9)))  # sums differ in the last digits
    lexicon = written(chosen.select("word", weight.alias("weight")), "lexicon")
    counts.unpersist()
    return lexicon


def _automaton(entries: list[tuple[str, float]], exceptions: list[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, weight in entries:
        found.add_word(f" {word} ", (weight, len(word) + 2))
    for phrase in exceptions:
        found.add_word(phrase, (0.0, len(phrase)))
    found.make_automaton()
    return found


def weigh(found: ahocorasick.Automaton, text: str) -> tuple[int, float]:
    """(matches, sum of weights) outside exception phrases of a folded text."""
    hits, excused = [], []
    for end, (weight, size) in found.iter(text):
        (hits if weight else excused).append((end - size + 1, end, weight))
    if excused:
        hits = [h for h in hits if not any(s <= h[0] and h[1] <= e for s, e, _ in excused)]
    return len(hits), math.fsum(h[2] for h in hits)


def match_lexicon(
    docs: DataFrame,
    lexicon: DataFrame,
    *,
    text: str = "text",
    exceptions: Iterable[str] = EXCEPTIONS,
    carry: list[str] | None = None,
    block_entries: int = BLOCK_ENTRIES,
) -> DataFrame:
    """``docs`` (or its columns ``carry``) with ``n_hits``, ``raw`` (sum of weights) and ``n_words``.

    A null or wordless text has none of them. Input columns named like an output give way.
    """
    keep = [c for c in (docs.columns if carry is None else carry) if c.lower() not in OUTPUTS]
    w = free_prefix(docs)
    n = len(keep)
    rows = docs.select(
        *[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(f"{w}t"),
        F.lit(0).cast("bigint").alias(f"{w}h"), F.lit(0.0).alias(f"{w}r"), F.lit(0).cast("bigint").alias(f"{w}n"),
    )
    schema = rows.schema
    phrases = [folded(e) for e in exceptions]
    lexicon = lexicon.persist()
    blocks = max(1, -(-2 * lexicon.count() // block_entries)) if lexicon.count() > block_entries else 1

    def one_pass(block: list[tuple[str, float]]):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = _automaton(shared.value, phrases)
            searched = bool(shared.value)
            for batch in batches:
                hits, raw, words = [], [], []
                for t, h, r in zip(*[batch.column(n + k).to_pylist() for k in range(3)]):
                    t = folded(t or "")
                    words.append(t.count(" ") - 1 if t.strip() else 0)
                    more = weigh(found, t) if searched else (0, 0.0)
                    hits.append(h + more[0])
                    raw.append(r + more[1])
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[: n + 1], pa.array(hits, pa.int64()), pa.array(raw, pa.float64()), pa.array(words, pa.int64())],
                    names=schema.fieldNames(),
                )

        return run

    for k in range(blocks):
        block = lexicon.where(F.pmod(F.xxhash64("word"), F.lit(blocks)) == k).orderBy("word").collect()
        rows = map_arrow(rows, one_pass([(r["word"], float(r["weight"])) for r in block]), schema)
    lexicon.unpersist()
    base = docs.select(*[F.col(f"`{c}`") for c in keep])
    return rows.select(*kept_columns(base, ()), F.col(f"{w}h").alias("n_hits"), F.col(f"{w}r").alias("raw"), F.col(f"{w}n").alias("n_words"))


def _bin(raw: Column, n_words: Column, exponent: float) -> Column:
    """0 without weight, else quarter octaves of the normalised sum, 1 to ``_BINS`` - 1."""
    x = raw / F.pow(F.greatest(n_words, F.lit(1)).cast("double"), F.lit(exponent))
    step = F.floor(F.log2(F.greatest(x, F.lit(1e-9))) * 4).cast("int") + _BINS // 2
    return F.when(raw <= 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.least(F.lit(_BINS - 1), step)))


def _monotone(positive: list[float], total: list[float]) -> list[float]:
    """Least-squares non-decreasing shares (pool adjacent violators), slightly drawn to the mean."""
    mean = (sum(positive) + 0.5) / (sum(total) + 1)
    pools: list[list[float]] = []
    for p, t in zip(positive, total):
        prior = 0.2 if t else 1e-9  # an empty bin takes its neighbours' share
        pools.append([p + prior * mean, t + prior, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last)]
    return [p / t for p, t, size in pools for _ in range(int(size))]


def calibrate(matched: DataFrame, labels: DataFrame, *, doc_id: str, label: str) -> tuple[float, list[float]]:
    """Length exponent and probability per bin, from counts over all labelled rows of ``matched``."""
    known = labels.where(F.col(f"`{label}`").isNotNull()).groupBy(F.col(f"`{doc_id}`").alias("i")).agg(
        F.max(F.col(f"`{label}`").cast("int")).alias("y")
    )
    rows = matched.select(F.col(f"`{doc_id}`").alias("i"), "raw", "n_words").join(known, "i")
    bins = F.array(*[_bin(F.col("raw"), F.col("n_words"), e) for e in EXPONENTS])
    counts = (
        rows.select("y", F.posexplode(bins).alias("e", "bin")).groupBy("e", "bin")
        .agg(F.count_if(F.col("y") == 1).alias("a"), F.count(F.lit(1)).alias("n")).collect()
    )  # number of exponents times bins at most
    best = None
    for k, exponent in enumerate(EXPONENTS):
        a, n = [0.0] * _BINS, [0.0] * _BINS
        for r in counts:
            if r["e"] == k:
                a[r["bin"]], n[r["bin"]] = float(r["a"]), float(r["n"])
        shares = _monotone(a, n)
        loss = -sum(x * math.log(s) + (t - x) * math.log(1 - s) for x, t, s in zip(a, n, shares) if t)
        if best is None or loss < best[0] - 1e-9:
            best = (loss, exponent, shares)
    return best[1], best[2]


def score_of(raw: Column, n_words: Column, exponent: float, shares: list[float]) -> Column:
    table = F.array(*[F.lit(float(s)) for s in shares])
    return F.element_at(table, _bin(raw, n_words, exponent) + 1)
