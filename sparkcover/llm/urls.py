"""URL verdicts: allow/block rules, and a character language-model ratio for the rest.

Two smoothed variable-order Markov models, one of accepted and one of rejected
URLs, give each character its probability after the last ``order`` characters,
interpolated over all shorter contexts (Witten-Bell weights). The score of a URL
is the mean log-likelihood difference per character; the threshold is calibrated
on the labelled URLs, each scored with its own characters left out of the counts.

Everything is DataFrame joins and sums: one row per distinct URL text, one per
distinct character sequence. The model grows with the corpus and stays a table;
it is joined by Spark's choice of join, never forced into a broadcast.

The labels that train the models are the rules' own verdicts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcover.llm.common import free_prefix, kept_columns, word_class_lower, written

OUTPUTS = ("host", "path", "rule", "verdict", "score")
_START, _END = "\u0002", "\u0003"  # padding before, and one mark after each URL


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path). Host: after the first ``://`` up to ``/ ? #``; path: on to ``? #``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(word_class_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def rule_match(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest matching rule as ``struct(n, rule, verdict)``, null where none fits.

    ``rules``: (rule, verdict) pairs, a rule being a host directly followed by a
    path prefix. The list is a parameter and becomes one literal array.
    """
    if not rules:
        return F.lit(None).cast("struct<n:int,rule:string,verdict:string>")
    table = F.array(
        *[
            F.struct(
                F.lit(len(r)).alias("n"),
                F.lit(r).alias("rule"),
                F.lit(v).alias("verdict"),
                F.lit(r.partition("/")[0]).alias("host"),
                F.lit("/" + r.partition("/")[2]).alias("prefix"),
            )
            for r, v in rules
        ]
    )
    fits = F.filter(
        table,
        lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"])))
        & F.startswith(path, r["prefix"]),
    )
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["n"], r["rule"], r["verdict"])))
    return best


def _grams(texts: DataFrame, order: int) -> DataFrame:
    """One row per character position of each text: the character with its whole context."""
    body = F.concat(F.lit(_START * order), F.col("t"), F.lit(_END))
    return texts.select("*", body.alias("body")).select(
        *texts.columns, F.explode(F.sequence(F.lit(1), F.length("t") + 1)).alias("i"), "body"
    ).select(*texts.columns, F.substring("body", F.col("i"), F.lit(order + 1)).alias("g"))


def _levels(counts: DataFrame, order: int) -> DataFrame:
    """Log-likelihood differences per longest sequence: ``g``, ``r``, ``r_a``, ``r_b``.

    ``counts`` has ``g``, ``a``, ``b``. ``r_a`` leaves one occurrence out of the
    accepted counts, for accepted URLs' own scores; ``r_b`` likewise for rejected.
    """
    n_chars = counts.select(F.substring("g", order + 1, 1)).distinct().count()
    lower = None
    for k in range(order + 1):  # context of k characters
        at = order - k + 1
        if k == order:
            level = counts.select("g", "a", "b")
        else:
            level = counts.groupBy(F.expr(f"substring(g, {at})").alias("g")).agg(
                F.sum("a").alias("a"), F.sum("b").alias("b")
            )
        level = level.withColumn("ctx", F.expr(f"substring(g, 1, {k})"))
        stats = level.groupBy("ctx").agg(
            F.sum("a").alias("na"),
            F.sum("b").alias("nb"),
            F.count_if(F.col("a") > 0).alias("ta"),
            F.count_if(F.col("b") > 0).alias("tb"),
        )
        level = level.join(stats, "ctx")
        if lower is None:
            level = level.select(
                "*", *[F.lit(1.0 / max(1, n_chars)).alias(f"q{x}") for x in ("a", "b", "a1", "b1")]
            )
        else:
            level = level.withColumn("sfx", F.expr("substring(g, 2)")).join(
                lower.select(F.col("g").alias("sfx"), *[F.col(f"p{x}").alias(f"q{x}") for x in ("a", "b", "a1", "b1")]),
                "sfx",
            )

        def mixed(n, total, kinds, q):
            return F.when(total + kinds > 0, (n + kinds * q) / F.greatest(total + kinds, F.lit(1))).otherwise(q)

        one_out = []
        for x in ("a", "b"):
            n, total, kinds = (F.col(c) for c in (x, f"n{x}", f"t{x}"))
            rest, others = F.greatest(n - 1, F.lit(0)), F.greatest(total - 1, F.lit(0))
            left = kinds - F.when(n == 1, F.lit(1)).otherwise(F.lit(0))
            one_out.append(mixed(rest, others, left, F.col(f"q{x}1")).alias(f"p{x}1"))
        lower = level.select(
            "g",
            mixed(F.col("a"), F.col("na"), F.col("ta"), F.col("qa")).alias("pa"),
            mixed(F.col("b"), F.col("nb"), F.col("tb"), F.col("qb")).alias("pb"),
            *one_out,
        )
    return lower.select(
        "g",
        (F.log("pa") - F.log("pb")).alias("r"),
        (F.log("pa1") - F.log("pb")).alias("r_a"),
        (F.log("pa") - F.log("pb1")).alias("r_b"),
    )


def _threshold(scored: DataFrame) -> float:
    """Score from which a URL is accepted: least sum of both error rates on labelled URLs.

    Scores are compared on a grid of 1/100 clipped to [-20, 20]: 4001 rows at most.
    The middle of the best stretch is taken; without both kinds of label, 0.
    """
    bins = scored.where(F.col("label").isNotNull()).groupBy(
        F.round(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.col("score"))), 2).alias("s")
    ).agg(F.count_if(F.col("label") == "allow").alias("a"), F.count_if(F.col("label") == "block").alias("b"))
    rows = sorted((float(r["s"]), int(r["a"]), int(r["b"])) for r in bins.collect())
    all_a, all_b = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not all_a or not all_b:
        return 0.0
    best, at = None, 0.0
    low_a, low_b = 0, 0
    for i, (s, a, b) in enumerate(rows):  # threshold just below s
        loss = low_a / all_a + (all_b - low_b) / all_b
        if best is None or loss < best:
            best, at = loss, s if i == 0 else (rows[i - 1][0] + s) / 2
        low_a, low_b = low_a + a, low_b + b
    return at


def judge_urls(
    pages: DataFrame, rules: list[tuple[str, str]], *, url: str = "url", order: int = 4
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` and ``score`` (of the models).

    Verdict: the longest matching rule's; else ``allow`` if the model score
    reaches the calibrated threshold, ``block`` below. A null URL or one without
    ``://`` has empty host and path and is scored as an empty text. Equal URLs
    get equal verdicts; every row stays. Without both accepted and rejected
    training URLs the threshold is 0 and scores follow the one model there is.
    An empty table gives an empty result. Input columns named like an output
    give way to it.
    """
    host, path = split_url(F.col(f"`{url}`"))
    w = free_prefix(pages)
    c = {x: f"{w}{x}" for x in ("host", "path", "m", "t", "score")}
    rows = pages.select("*", host.alias(c["host"]), path.alias(c["path"]))
    rows = rows.withColumn(c["m"], rule_match(F.col(c["host"]), F.col(c["path"]), rules)).withColumn(
        c["t"], F.concat(c["host"], c["path"])
    )
    # the text decides the rule, so each distinct text has one label
    texts = written(
        rows.groupBy(F.col(c["t"]).alias("t")).agg(F.first(F.col(c["m"])["verdict"]).alias("label"))
        .select("t", "label", F.monotonically_increasing_id().alias("id")),
        "url-texts",
    )
    counts = _grams(texts.select("t", "label"), order).groupBy("g").agg(
        F.count_if(F.col("label") == "allow").alias("a"), F.count_if(F.col("label") == "block").alias("b")
    )
    model = written(_levels(written(counts, "url-counts"), order), "url-model")
    by_label = F.when(F.col("label") == "allow", F.col("r_a")).when(F.col("label") == "block", F.col("r_b")).otherwise(F.col("r"))
    scored = written(
        _grams(texts, order).select("id", "label", "g").join(model, "g")
        .groupBy("id", "label").agg(F.avg(by_label).alias("score")),
        "url-scores",
    )
    cut = _threshold(scored)
    by_text = texts.join(scored.select("id", "score"), "id").select(
        F.col("t").alias(c["t"]), F.col("score").alias(c["score"])
    )
    method = F.when(F.col(c["score"]) >= F.lit(cut), F.lit("allow")).otherwise(F.lit("block"))
    return rows.join(by_text, c["t"]).select(
        *kept_columns(pages, OUTPUTS),
        F.col(c["host"]).alias("host"),
        F.col(c["path"]).alias("path"),
        F.col(c["m"])["rule"].alias("rule"),
        F.coalesce(F.col(c["m"])["verdict"], method).alias("verdict"),
        F.col(c["score"]).alias("score"),
    )
