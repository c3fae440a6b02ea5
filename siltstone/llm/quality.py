"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Rules bound, for each text, how many symbols, capitals and immediate
repetitions of a word it may have.  The bounds are not fixed: for each rate a
sketch of its distribution is kept per language and source, and the bound is
an upper fence over its quartiles.

The sketch is a histogram whose cells keep the leading bits of the rate, so
that a quantile is off by one part in 32 at most.  Sketches merge by adding
counts: those of a language's sources to the language's, and those to one of
all.  Every group also borrows the weight of a few documents from either, so
that the fence of a source with few documents leans on its language and on
the whole, and ever less so the more it has: there is no size at which the
rule changes.  It needs no random choice, so results never change when a task
is run again.

A text's count is held against what a text at the fence's rate may have by
chance (Bernstein's bound), so that short texts are not judged by one symbol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siltstone.llm.common import stored

#: name: (what is counted, what it is a rate of)
RATES = {"symbol": "chars", "upper": "chars", "repeat": "words"}
SYMBOLS = r"[#$%&*|!<>{}=^~\\]"


def measures(text: Column) -> dict[str, Column]:
    """Counts that the rates are made of; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.split(text, "[ \t\r\n]+")
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("before"))
    repeats = F.aggregate(
        words,
        start,
        lambda acc, w: F.struct((acc["n"] + F.when(w == acc["before"], 1).otherwise(0)).cast("long").alias("n"), w.alias("before")),
        lambda acc: acc["n"],
    )
    return {
        "chars": F.length(text).cast("long"),
        "words": F.size(words).cast("long"),
        "symbol": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "upper": F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long"),
        "repeat": repeats,
    }


def rate(count: Column, of: Column) -> Column:
    """Per ten thousand, rounded down."""
    return F.floor(count * 10000 / F.greatest(of, F.lit(1))).cast("long")


def cell(x: str) -> Column:
    """The sketch's cell of a non-negative integer: its six leading bits."""
    shift = f"CAST(greatest(length(bin({x})) - 6, 0) AS INT)"
    return F.expr(f"shiftleft(shiftright({x}, {shift}), {shift})")


def sketches(rates: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rule, cell, n) of rows with the keys and one column for each rule's rate."""
    long = rates.select(*keys, F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(f"{r}_rate").alias("x")) for r in RATES))).alias("e"))
    return long.select(*keys, "e.rule", cell("e.x").alias("cell")).groupBy(*keys, "rule", "cell").agg(F.count("*").alias("n"))


#: Weight of one document in a merged sketch; borrowed ones are parts of it.
UNIT = 1024


def borrowed(own: DataFrame, prior: int) -> DataFrame:
    """(q_lang, q_source, rule, cell, n): the sketches of languages and sources, each with ``prior`` documents' weight of its language's and of all.

    Sums are over tables of cells, whose number does not grow with the documents of a group.
    """
    lang = own.groupBy("q_lang", "rule", "cell").agg(F.sum("n").alias("n"))
    every = lang.groupBy("rule", "cell").agg(F.sum("n").alias("n"))
    groups = own.select("q_lang", "q_source", "rule").distinct()

    def share(sketch: DataFrame, keys: list[str]) -> DataFrame:
        total = sketch.groupBy(*keys).agg(F.sum("n").alias("total")).select(*(F.col(k).alias(f"t_{k}") for k in keys), "total")
        return sketch.join(total, _same(keys, "t_")).withColumn("n", F.expr(f"(n * {UNIT * prior}L) DIV total"))

    of_lang = share(lang, ["q_lang", "rule"]).select(F.col("q_lang").alias("s_q_lang"), F.col("rule").alias("s_rule"), "cell", "n")
    of_all = share(every, ["rule"]).select(F.col("rule").alias("s_rule"), "cell", "n")
    parts = own.select("q_lang", "q_source", "rule", "cell", (F.col("n") * UNIT).alias("n"))
    for part, keys in ((of_lang, ["q_lang", "rule"]), (of_all, ["rule"])):
        parts = parts.unionByName(groups.join(part, _same(keys, "s_")).select("q_lang", "q_source", "rule", "cell", "n"))
    return parts.groupBy("q_lang", "q_source", "rule", "cell").agg(F.sum("n").alias("n"))


def _same(keys: list[str], prefix: str) -> Column:
    found = F.lit(True)
    for k in keys:
        found = found & F.col(k).eqNullSafe(F.col(prefix + k))
    return found


def fences(sketch: DataFrame, keys: list[str], reach: float, spread: int) -> DataFrame:
    """(keys, rule, fence) of a sketch: upper quartile + reach * max(quartile distance, spread)."""
    group = W.partitionBy(*keys, "rule")
    ranked = sketch.select(*keys, "rule", "cell", F.sum("n").over(group).alias("total"), F.sum("n").over(group.orderBy("cell")).alias("upto"))
    quartile = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("cell")))
    found = ranked.groupBy(*keys, "rule").agg(quartile(1).alias("low"), quartile(3).alias("high"))
    return found.select(*keys, "rule", (F.col("high") + F.lit(reach) * F.greatest(F.col("high") - F.col("low"), F.lit(spread))).cast("long").alias("fence"))


def thresholds(counted: DataFrame, reach: float = 3.0, spread: int = 100, prior: int = 100) -> DataFrame:
    """(q_lang, q_source, symbol_fence, upper_fence, repeat_fence), one row per language and source of (q_lang, q_source, counts).

    Null languages and sources are groups of their own.
    """
    rates = counted.select("q_lang", "q_source", *(rate(F.col(f"q_{r}"), F.col(f"q_{of}")).alias(f"{r}_rate") for r, of in RATES.items()))
    own = stored(sketches(rates, ["q_lang", "q_source"]), "quality-sketches")
    chosen = fences(borrowed(own, prior), ["q_lang", "q_source"], reach, spread)
    return chosen.groupBy("q_lang", "q_source").agg(*(F.max(F.when(F.col("rule") == r, F.col("fence"))).alias(f"{r}_fence") for r in RATES))


def within(count: Column, of: Column, fence: Column, surprise: float) -> Column:
    """Whether a text at the fence's rate has so many by chance: more would have a probability of exp(-surprise) at most."""
    expected = fence * of / F.lit(10000.0)
    return count - expected <= F.lit(surprise / 3) + F.sqrt(F.lit(surprise * surprise / 9) + F.lit(2 * surprise) * expected)


def _judged(docs: DataFrame, keep_cols: list[str], text_col: str, lang_col: str, source_col: str, surprise: float, **adaptive) -> DataFrame:
    m = measures(F.col(text_col))
    own = docs.select(*(F.col(c).alias(f"__d_{c}") for c in keep_cols), F.col(lang_col).alias("q_lang"), F.col(source_col).alias("q_source"), *(c.alias(f"q_{k}") for k, c in m.items()))
    # counted once, for the fences and for judging
    own = stored(own, "quality-counts")
    limits = stored(thresholds(own, **adaptive), "quality-thresholds")
    # limits is read from files, so its size is known when the join is planned
    limits = limits.withColumnsRenamed({"q_lang": "l_q_lang", "q_source": "l_q_source"})
    joined = own.join(limits, _same(["q_lang", "q_source"], "l_"), "left")
    ok = [within(F.col(f"q_{r}"), F.col(f"q_{of}"), F.col(f"{r}_fence"), surprise) for r, of in RATES.items()]
    return joined.withColumn("__keep", ok[0] & ok[1] & ok[2])


def quality(docs: DataFrame, surprise: float = 7.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **adaptive) -> DataFrame:
    """(doc_id, symbol_rate, upper_rate, repeat_rate, their fences, keep) of every row.

    Rates are per ten thousand characters (words for ``repeat``).  Null and
    empty texts have rates of 0 and are kept; very long texts are counted
    whole; a text that just reaches its bound is kept.  Repeated rows count,
    and are judged, each; null ids too; other columns are ignored; an empty
    table gives an empty result.  Options as in :func:`thresholds`.
    """
    judged = _judged(docs, [id_col], text_col, lang_col, source_col, surprise, **adaptive)
    rates = [rate(F.col(f"q_{r}"), F.col(f"q_{of}")).alias(f"{r}_rate") for r, of in RATES.items()]
    return judged.select(F.col(f"__d_{id_col}").cast("long").alias("doc_id"), *rates, *(f"{r}_fence" for r in RATES), F.col("__keep").alias("keep"))


def keep_good(docs: DataFrame, surprise: float = 7.0, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **adaptive) -> DataFrame:
    """The rows of ``docs`` that :func:`quality` keeps, all columns kept."""
    judged = _judged(docs, docs.columns, text_col, lang_col, source_col, surprise, **adaptive)
    return judged.where("__keep").select(*(F.col(f"__d_{c}").alias(c) for c in docs.columns))


QUALITY_SQL = r"""
WITH m AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, string_split_regex(coalesce(text, ''), '[ \t\r\n]+') AS w FROM {docs}
), c AS (
  SELECT doc_id, lang, source, length(t) AS chars, len(w) AS words,
         len(regexp_extract_all(t, '[#$%&*|!<>{{}}=^~\\]')) AS symbol, len(regexp_extract_all(t, '\p{{Lu}}')) AS upper,
         len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS repeat
  FROM m
), r AS (
  SELECT *, symbol * 10000 // greatest(chars, 1) AS symbol_rate, upper * 10000 // greatest(chars, 1) AS upper_rate,
         repeat * 10000 // greatest(words, 1) AS repeat_rate FROM c
), x AS (
  SELECT lang, source, 'symbol' AS rule, symbol_rate AS x FROM r UNION ALL SELECT lang, source, 'upper', upper_rate FROM r
  UNION ALL SELECT lang, source, 'repeat', repeat_rate FROM r
), s AS (
  SELECT lang, source, rule, (x >> greatest(length(bin(x)) - 6, 0)) << greatest(length(bin(x)) - 6, 0) AS cell, count(*) AS n FROM x GROUP BY ALL
), tl AS (SELECT lang, rule, sum(n) AS total FROM s GROUP BY ALL
), ta AS (SELECT rule, sum(n) AS total FROM s GROUP BY ALL
), pl AS (SELECT s.lang, rule, cell, sum(n) * 102400 // any_value(total) AS n FROM s JOIN tl USING (rule) WHERE s.lang IS NOT DISTINCT FROM tl.lang GROUP BY s.lang, rule, cell
), pa AS (SELECT rule, cell, sum(n) * 102400 // any_value(total) AS n FROM s JOIN ta USING (rule) GROUP BY rule, cell
), groups AS (SELECT DISTINCT lang, source, rule FROM s
), g AS (
  SELECT lang, source, rule, cell, n * 1024 AS n FROM s
  UNION ALL SELECT groups.lang, source, groups.rule, cell, n FROM groups JOIN pl ON groups.rule = pl.rule AND groups.lang IS NOT DISTINCT FROM pl.lang
  UNION ALL SELECT lang, source, groups.rule, cell, n FROM groups JOIN pa ON groups.rule = pa.rule
), h AS (SELECT lang, source, rule, cell, sum(n) AS n FROM g GROUP BY ALL
), k AS (
  SELECT *, sum(n) OVER (PARTITION BY lang, source, rule) AS total, sum(n) OVER (PARTITION BY lang, source, rule ORDER BY cell) AS upto FROM h
), q AS (
  SELECT lang, source, rule, min(CASE WHEN upto * 4 >= total THEN cell END) AS low, min(CASE WHEN upto * 4 >= total * 3 THEN cell END) AS high FROM k GROUP BY ALL
), t AS (SELECT lang, source, rule, CAST(high + 3 * greatest(high - low, 100) AS BIGINT) AS fence FROM q
), l AS (
  SELECT lang, source, max(fence) FILTER (rule = 'symbol') AS symbol_fence, max(fence) FILTER (rule = 'upper') AS upper_fence,
         max(fence) FILTER (rule = 'repeat') AS repeat_fence FROM t GROUP BY ALL
), e AS (
  SELECT r.*, symbol_fence, upper_fence, repeat_fence, symbol_fence * chars / 10000.0::DOUBLE AS symbol_e, upper_fence * chars / 10000.0::DOUBLE AS upper_e,
         repeat_fence * words / 10000.0::DOUBLE AS repeat_e
  FROM r LEFT JOIN l ON r.lang IS NOT DISTINCT FROM l.lang AND r.source IS NOT DISTINCT FROM l.source
)
SELECT doc_id, symbol_rate, upper_rate, repeat_rate, symbol_fence, upper_fence, repeat_fence,
       symbol - symbol_e <= 7.0::DOUBLE / 3 + sqrt(49.0::DOUBLE / 9 + 14 * symbol_e) AND upper - upper_e <= 7.0::DOUBLE / 3 + sqrt(49.0::DOUBLE / 9 + 14 * upper_e)
       AND repeat - repeat_e <= 7.0::DOUBLE / 3 + sqrt(49.0::DOUBLE / 9 + 14 * repeat_e) AS keep
FROM e
"""
