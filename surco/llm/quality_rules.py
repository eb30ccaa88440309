"""Quality rules whose thresholds follow the data: quantile sketches per language and source.

Every metric is a whole number and every sketch a count per bucket. A bucket keeps the six leading bits of
the value (relative width at most 1/32), so sketches of different rows, tasks, sources or languages merge by
adding counts, give the same answer in any order, and never hold more than a few hundred buckets. Only
built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surco.llm.common import WORD, split_words, text_of
from surco.session import written_once

WINDOW_WORDS = 5
MIN_WORDS = 10
#: Percent of the words that may lie in repeated windows.
MAX_REPEAT = 20
#: A sketch of fewer rows is replaced by the merged sketch of its language, then of all rows.
MIN_ROWS = 200
#: A document fails above the lesser of two cuts of its group: q75 + FENCE * max(q75 - q25, floor), and q99 with a quarter more, but at
#: least the floor; or below q25 - FENCE * max(q75 - q25, floor). The first cut holds where junk is more than a hundredth of the group, the second follows
#: the tail where most values are 0.
FENCE, MARGIN = 3, 4
LEAD_BITS = 6
#: Metric: (its value, the floor of its spread and of its upper cut, whether it has a lower fence).
METRICS = {
    "symbols": ("1000 * n_symbols div nullif(n_words, 0)", 30, False),
    "capitals": ("1000 * n_capitals div nullif(word_chars, 0)", 50, False),
    "dup_lines": ("1000 * n_dup_lines div nullif(n_lines, 0)", 150, False),
    "repeats": ("1000 * n_repeat_words div nullif(n_words, 0)", 70, False),
    "word_size": ("100 * word_chars div nullif(n_words, 0)", 60, True),
}


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(words: Column, size: int = WINDOW_WORDS) -> Column:
    """How many words lie in windows of ``size`` words that occur twice or more in the list.

    Windows are hashed; only where two hashes are equal the list of windows is sorted, and equal neighbours
    are compared word by word.
    """

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))

    def covered(w: Column, h: Column) -> Column:
        ranked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return _let(ranked, lambda g: total(w, g))

    def total(w: Column, g: Column) -> Column:
        def same(x: Column, y: Column) -> Column:
            return F.coalesce((x["h"] == y["h"]) & (F.slice(w, x["i"] + 1, size) == F.slice(w, y["i"] + 1, size)), F.lit(False))

        twice = F.filter(g, lambda x, j: same(F.get(g, j - 1), x) | same(x, F.get(g, j + 1)))
        at = F.array_sort(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))
        return F.aggregate(
            at, start,
            lambda a, i: F.struct((i + size).alias("end"), (a["n"] + i + size - F.greatest(a["end"], i)).alias("n")),
            lambda a: a["n"])

    def of(w: Column) -> Column:
        found = _let(hashes(w), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(w, h)).otherwise(0))
        return F.when(F.size(w) > size, found).otherwise(0)

    return _let(words, of).cast("bigint")


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source`` and the counts of every whole text; a null text counts as one without words."""
    text = text_of()
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    counted = docs.select(
        "doc_id", "lang", "source",
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("n_words"),
        F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]", "")).cast("bigint").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("bigint").alias("n_capitals"),
        _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("lines"),
        repeat_words(split_words(text)).alias("n_repeat_words"),
    )
    counts = counted.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_capitals",
        F.col("lines.n").cast("bigint").alias("n_lines"), F.col("lines.dup").cast("bigint").alias("n_dup_lines"), "n_repeat_words")
    return counts.withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words")))


def _bucket(value: Column) -> Column:
    """The value with only its leading bits."""
    cut = F.greatest(F.length(F.bin(value)) - LEAD_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, cut), cut)


def sketches(measured: DataFrame) -> DataFrame:
    """``lang, source, metric, bucket, n`` over the documents that pass the base rules."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.expr(e).alias("value")) for m, (e, _, _) in METRICS.items()])
    return (
        measured.filter(~F.col("base_failed")).select("lang", "source", F.inline(pairs))
        .groupBy("lang", "source", "metric", _bucket(F.col("value")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    )


def _quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Quartiles, 99th percentile and row count of each sketch, from its own buckets."""
    by = Window.partitionBy(*keys, "metric")
    merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    ranked = merged.withColumn("upto", F.sum("n").over(by.orderBy("bucket"))).withColumn("rows", F.sum("n").over(by))
    at = lambda p: F.min(F.when(100 * F.col("upto") >= p * F.col("rows"), F.col("bucket")))
    return ranked.groupBy(*keys, "metric").agg(F.max("rows").alias("rows"), *[at(p).alias(f"q{p}") for p in (25, 75, 99)])


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row per language and source: ``<metric>_most`` and, where it has one, ``<metric>_least``."""
    own = _quartiles(sketch, ["lang", "source"])
    lang = _quartiles(sketch, ["lang"]).select(
        F.col("lang").alias("l"), F.col("metric").alias("lm"), F.col("rows").alias("lrows"), *[F.col(f"q{p}").alias(f"l{p}") for p in (25, 75, 99)])
    whole = _quartiles(sketch, []).select(F.col("metric").alias("wm"), *[F.col(f"q{p}").alias(f"w{p}") for p in (25, 75, 99)])
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("metric") == F.col("lm"))).join(whole, F.col("metric") == F.col("wm"))
    pick = lambda q: F.when(F.col("rows") >= MIN_ROWS, F.col(f"q{q}")).when(F.col("lrows") >= MIN_ROWS, F.col(f"l{q}")).otherwise(F.col(f"w{q}"))
    low, high = pick(25), pick(75)
    spread = F.create_map(*[F.lit(x) for m, (_, s, _) in METRICS.items() for x in (m, s)])[F.col("metric")]
    spread, tail = spread.cast("bigint"), pick(99)
    wide = F.greatest(high - low, spread)
    most = F.least(high + FENCE * wide, F.greatest(tail + F.floor(tail / MARGIN), spread))
    fence = joined.select("lang", "source", "metric", most.alias("most"), (low - FENCE * wide).alias("least"))
    cuts = []
    for m, (_, _, both) in METRICS.items():
        cuts.append(F.max(F.when(F.col("metric") == m, F.col("most"))).alias(f"{m}_most"))
        if both:
            cuts.append(F.max(F.when(F.col("metric") == m, F.col("least"))).alias(f"{m}_least"))
    return fence.groupBy("lang", "source").agg(*cuts)


def judge(docs: DataFrame) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` of every document.

    A document is kept if it passes the base rules and lies within the fences of its language and source;
    nulls are a language and a source of their own. Repeated rows are judged alike, each in its row. An empty
    table gives an empty result. Columns other than id, text, lang and source are not read.
    """
    measured = written_once(measure(docs))
    cuts = thresholds(sketches(measured)).withColumnsRenamed({"lang": "cut_lang", "source": "cut_source"})
    joined = measured.join(
        cuts, F.col("lang").eqNullSafe(F.col("cut_lang")) & F.col("source").eqNullSafe(F.col("cut_source")), "left")
    within = F.lit(True)
    for m, (value, _, both) in METRICS.items():
        within = within & (F.expr(value) <= F.col(f"{m}_most"))
        if both:
            within = within & (F.expr(value) >= F.col(f"{m}_least"))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(within, F.lit(False))).alias("kept"))


def oracle() -> str:
    """The same result in DuckDB SQL."""
    w = r"[^\x20\x09-\x0D]+"
    values = {m: e.replace(" div ", " // ") for m, (e, _, _) in METRICS.items()}
    metric_rows = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {v} AS v FROM measured WHERE NOT base_failed" for m, v in values.items())
    cut = f"greatest(length(bin(v)) - {LEAD_BITS}, 0)"

    def quartiles(name: str, keys: str) -> str:
        by = f"{keys}metric"
        return f"""{name}_r AS (SELECT {keys}metric, bucket, sum(n) OVER (PARTITION BY {by} ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {by}) AS rows
          FROM (SELECT {keys}metric, bucket, sum(n) AS n FROM sketch GROUP BY {keys}metric, bucket)),
        {name} AS (SELECT {keys}metric, max(rows) AS rows, min(CASE WHEN 100 * upto >= 25 * rows THEN bucket END) AS q25, min(CASE WHEN 100 * upto >= 75 * rows THEN bucket END) AS q75,
          min(CASE WHEN 100 * upto >= 99 * rows THEN bucket END) AS q99 FROM {name}_r GROUP BY {keys}metric)"""

    pick = lambda q: f"CASE WHEN o.rows >= {MIN_ROWS} THEN o.q{q} WHEN l.rows >= {MIN_ROWS} THEN l.q{q} ELSE w.q{q} END"
    spread = " ".join(f"WHEN '{m}' THEN {s}" for m, (_, s, _) in METRICS.items())
    ok = " AND ".join(
        f"{values[m]} <= max(CASE WHEN f.metric = '{m}' THEN least(f.high + {FENCE} * f.wide, greatest(f.tail + f.tail // {MARGIN}, f.floor)) END)"
        + (f" AND {values[m]} >= max(CASE WHEN f.metric = '{m}' THEN f.low - {FENCE} * f.wide END)" if both else "")
        for m, (_, _, both) in METRICS.items())
    counts = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
    s AS (SELECT *, regexp_extract_all(t, '{w}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{w}')) AS ls FROM d),
    g AS (SELECT r, i, array_to_string(ws[i:i + {WINDOW_WORDS - 1}], ' ') AS win FROM (SELECT r, ws, unnest(range(1, len(ws) - {WINDOW_WORDS - 2})) AS i FROM s)),
    p AS (SELECT r, i, i - coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -1000) AS step
      FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS k FROM g) WHERE k > 1),
    rep AS (SELECT r, sum(least(step, {WINDOW_WORDS})) AS n FROM p GROUP BY r),
    c AS (SELECT s.r, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
      len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(t, '\\p{{Lu}}'))::BIGINT AS n_capitals, len(ls)::BIGINT AS n_lines,
      (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM s LEFT JOIN rep ON rep.r = s.r),
    measured AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed FROM c),
    sketch AS (SELECT lang, source, metric, (v >> {cut}) << {cut} AS bucket, count(*) AS n FROM ({metric_rows}) GROUP BY ALL),
    {quartiles("o", "lang, source, ")}, {quartiles("l", "lang, ")}, {quartiles("w", "")},
    f AS (SELECT *, greatest(high - low, floor) AS wide
      FROM (SELECT o.lang, o.source, o.metric, {pick(25)} AS low, {pick(75)} AS high, {pick(99)} AS tail, CASE o.metric {spread} END AS floor FROM o
        JOIN l ON l.lang IS NOT DISTINCT FROM o.lang AND l.metric = o.metric JOIN w ON w.metric = o.metric))
    SELECT {counts}, coalesce(NOT base_failed AND {ok}, false) AS kept
    FROM measured m LEFT JOIN f ON f.lang IS NOT DISTINCT FROM m.lang AND f.source IS NOT DISTINCT FROM m.source
    GROUP BY r, m.lang, m.source, n_capitals, n_lines, {counts}
    """
