"""License scan by ordered signature rules.

1. A keyword prefilter on the raw text: a document without any rule's anchor word holds no
   detection and is only counted. Almost all documents end here.
2. The rest becomes words with single spaces between them, cut into slices of
   ``SLICE_WORDS`` words that overlap by the longest match on both sides, so that the work
   on a slice is bounded however long the text is. Within a slice, the rules whose keyword
   occurs give their matches as word intervals.
3. A detection is suppressed where one of a rule of higher priority contains its interval
   (so "lesser general public license version 3" isn't also a plain general one). Every
   slice decides on the detections that start in its own words.

All of it is one expression per row, made of DataFrame functions: nothing is exchanged, and
no row is multiplied.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcover.llm.common import kept_columns, packed, word_class_lower
from sparkcover.llm.license_rules import MAX_WORDS, Rule, license_rules

SLICE_WORDS = 1000
OUTPUTS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")
_WORD_CHARS = r"0-9A-Za-z\x{80}-\x{10FFFF}"
_NONE = "array<struct<label:string,rule:int,start:bigint,end:bigint,confidence:double>>"


def _spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def _whole(regex: str) -> str:
    """``regex`` at whole words of a text with single spaces."""
    return f"(?<![^ ])(?:{regex})(?![^ ])"


def _gate(text: Column, lower: Column, keywords: list[str]) -> Column:
    """True for every text that holds one of the keywords as consecutive words, and for few others.

    A longer word of a keyword is enough to look for; keywords of short words only are looked
    for as they are.
    """
    single = set()
    for k in keywords:
        words = k.split(" ")
        word = max(words, key=lambda w: ("licen" in w, len(w)))
        if len(words) == 1 or len(word) >= 5:
            single.add(word)
    anchors = sorted(w for w in single if not any(v != w and v in w for v in single))
    short = {k for k in keywords if not any(w in k for w in anchors)}
    short = sorted(k for k in short if not any(o != k and f" {o} " in f" {k} " for o in short))
    tests = [F.contains(lower, F.lit(w)) for w in anchors]
    tests += [F.rlike(text, F.lit(f"(?i){k.replace(' ', f'[^{_WORD_CHARS}]+')}")) for k in short]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.transform(F.array(value), then)[0]


def _matches(body: Column, rule: Column) -> Column:
    """A rule's matches in a slice as word intervals, in one pass over the pieces between them."""
    found = F.regexp_extract_all(body, rule["regex"], F.lit(0))
    pieces = F.split(body, rule["regex"], -1)
    zipped = F.zip_with(pieces, found, lambda p, h: F.struct(p.alias("piece"), h.alias("hit")))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + _spaces(x["piece"])
        end = start + _spaces(x["hit"]) + 1
        span = F.struct(
            rule["label"].alias("label"),
            rule["rule"].alias("rule"),
            start.cast("bigint").alias("start"),
            end.cast("bigint").alias("end"),
            rule["confidence"].alias("confidence"),
        )
        more = F.when(x["hit"].isNull(), state["spans"]).otherwise(F.concat(state["spans"], F.array(span)))
        return F.struct((start + F.coalesce(_spaces(x["hit"]), F.lit(0))).cast("bigint").alias("at"), more.alias("spans"))

    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_NONE).alias("spans"))
    return F.when(F.size(found) > 0, F.aggregate(zipped, begin, step)["spans"]).otherwise(F.array().cast(_NONE))


def _slice_detections(part: Column, rules: Column) -> Column:
    """Detections that start in a slice's own words and that no higher rule contains."""
    fitting = F.filter(rules, lambda r: F.contains(part["body"], r["keyword"]))
    spans = F.flatten(F.transform(fitting, lambda r: _matches(part["body"], r)))

    def unsuppressed(all_spans: Column) -> Column:
        def within(d: Column, e: Column) -> Column:
            return (e["rule"] < d["rule"]) & (e["start"] <= d["start"]) & (e["end"] >= d["end"])

        return F.filter(all_spans, lambda d: ~F.exists(all_spans, lambda e: within(d, e)))

    def own(d: Column) -> Column:
        return (d["start"] + part["at"] >= part["core"]) & (d["start"] + part["at"] < part["core"] + SLICE_WORDS)

    kept = F.filter(_let(spans, unsuppressed), own)
    return F.transform(
        kept, lambda d: d.withField("start", d["start"] + part["at"]).withField("end", d["end"] + part["at"])
    )


def scan_licenses(
    docs: DataFrame,
    base_phrases: list[tuple[str, str]],
    *,
    text: str = "text",
    rules: list[Rule] | None = None,
    carry: list[str] | None = None,
) -> DataFrame:
    """``docs`` (or its columns ``carry``) with the license notices of each whole text.

    ``n_words``; ``n_base``, ``first_word``, ``last_word`` (places of the ``base_phrases``,
    pairs of words and label; null without any) and ``base_labels``; ``detections`` (array of
    ``label, rule, start, end, confidence``: word intervals, end excluded, in the rules'
    order within each slice); ``labels`` (of base phrases and detections, distinct, sorted,
    comma-joined); ``score`` (the largest confidence, 0.5 for base phrases alone, else 0).

    Null and wordless texts have no words and no label. Repeated rows are judged alike. An
    empty table gives no rows. Input columns named like an output give way to it.
    """
    rules = license_rules() if rules is None else rules
    keep = docs.columns if carry is None else carry
    row = docs.select(
        packed(docs.select(*[F.col(f"`{c}`") for c in keep]), OUTPUTS).alias("row"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    row = row.select("*", F.lower("text").alias("lower"))
    gate = _gate(F.col("text"), F.col("lower"), [r.keyword for r in rules] + [p for p, _ in base_phrases])
    spaced = F.trim(F.regexp_replace(word_class_lower(F.col("text")), f"[^{_WORD_CHARS}]+", " "))
    row = row.select(
        "row",
        F.regexp_count("text", F.lit(f"[{_WORD_CHARS}]+")).cast("bigint").alias("n_words"),
        F.when(gate, spaced).alias("words"),  # null where nothing can be found
    )
    row = row.withColumn("list", F.split("words", " "))
    table = F.array(
        *[
            F.struct(
                F.lit(r.label).alias("label"),
                F.lit(n).alias("rule"),
                F.lit(r.keyword).alias("keyword"),
                F.lit(_whole(r.regex)).alias("regex"),
                F.lit(r.confidence).alias("confidence"),
            )
            for n, r in enumerate(rules)
        ]
    )
    n_list = F.size("list")

    def part(core: Column) -> Column:
        at = F.greatest(core - MAX_WORDS, F.lit(0))
        body = F.array_join(F.slice(F.col("list"), at + 1, F.lit(SLICE_WORDS + 2 * MAX_WORDS)), " ")
        return F.struct(core.alias("core"), at.alias("at"), body.alias("body"))

    slices = F.transform(F.sequence(F.lit(0), n_list - 1, F.lit(SLICE_WORDS)), part)
    found = F.flatten(F.transform(slices, lambda x: _slice_detections(x, table)))
    row = row.withColumn("detections", F.when(F.col("words").isNotNull() & (F.col("words") != ""), found))
    words = F.col("words")
    places, first, last, named = [], [], [], []
    for phrase, label in base_phrases:
        # places may overlap: only the start is consumed
        n = F.coalesce(F.regexp_count(words, F.lit(f"(?<![^ ])(?={phrase}(?![^ ]))")), F.lit(0)).cast("bigint")
        places.append(n)
        first.append(F.when(n > 0, _spaces(F.regexp_extract(words, f"^(.*?){_whole(phrase)}", 1))))
        last.append(F.when(n > 0, _spaces(F.regexp_extract(words, f"^(.*){_whole(phrase)}", 1))))
        named.append(F.when(n > 0, F.lit(label)))
    none = F.lit(None).cast("int")  # least and greatest skip nulls, but want two columns
    row = row.select(
        "row",
        "n_words",
        reduce(lambda a, b: a + b, places).alias("n_base"),
        F.least(none, none, *first).cast("bigint").alias("first_word"),
        F.greatest(none, none, *last).cast("bigint").alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*named)))).alias("base"),
        F.coalesce("detections", F.array().cast(_NONE)).alias("detections"),
    )
    labels = F.array_sort(F.array_distinct(F.concat("base", F.transform("detections", lambda d: d["label"]))))
    best = F.array_max(F.transform("detections", lambda d: d["confidence"]))
    return row.select(
        *[F.col(f"row.`{c}`") for c in keep if c.lower() not in OUTPUTS],
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.greatest(F.when(F.col("n_base") > 0, 0.5).otherwise(0.0), F.coalesce(best, F.lit(0.0))).alias("score"),
        "detections",
    )
