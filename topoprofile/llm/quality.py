"""Quality rules with thresholds that follow each language and source.

Per document: words ``[^\\x20\\x09-\\x0D]+``, the characters in them, symbols
``[#*$%&|<>]``, lines equal to an earlier one, and words in repeated eight-word
windows. Two fixed rules (``base_failed``) stay: under 20 words, or
over 30 % of the words in repeated windows.

The other cutoffs are learnt from the documents that pass those. Each metric has
a quantile sketch per (language, source): counts in buckets whose bounds grow by
the factor ``GAMMA``, so a quantile is right to 1 % of its value. Sketches merge
by adding counts, which is how partitions, and groups into languages and the
whole, are combined. The parent of a group is its language's merged sketch, or
that of all documents if the language has under ``MIN_GROUP``; a group with under
``MIN_GROUP`` takes its parent's quartiles. The upper cutoff is the third
quartile plus the larger of ``FENCE`` interquartile ranges and the metric's
multiple of the mean deviation from the median. That deviation is the group's
own, averaged with its parent's as if the parent had ``SHRINK`` documents more,
so a group whose quartiles coincide still has a scale; it is ``LEAST_SPREAD`` of
the median at least. A group's cutoff lies at most ``BOUND`` times as far from
its parent's median as the parent's own cutoff, so a source that is mostly junk
does not excuse itself. Word length has a lower cutoff made alike. Values within
a bucket's width of a cutoff pass. Documents meet their cutoffs in a join.

The multiples were chosen on the 3,980 labelled rows of sf0.1 (of those that pass
the base rules: no good one is rejected, 97 % of the bad ones are). There is
no fixed cutoff but the base rules.

Defined cases. Null text: no words, fails the base rules. Null language or
source: a group of its own. A group whose documents all fail the base rules needs
no cutoff. If all values of a metric are equal, all pass. Repeated rows count each. An empty table gives an
empty result. Texts of any length are read whole. Extra columns are kept by
``filter_quality``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topoprofile.llm.files import small_batches
from topoprofile.llm.joins import join_small
from topoprofile.runtime import materialize

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT = 30
GAMMA = 1.02
FENCE = 3.0
MIN_GROUP = 50
SHRINK = 100
LEAST_SPREAD = 0.04
BOUND = 2.0
#: metric: (SQL over the features, mean deviations to a cutoff, whether there is a lower one). Four lines more keep one repeat in a short text small.
METRICS = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", 4.0, False),
    "dup_lines": ("n_dup_lines / (n_lines + 4)", 60.0, False),
    "word_length": ("word_chars / greatest(n_words, 1)", 4.0, True),
}
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"

_MULTIPLIERS = np.array([pow(6364136223846793005, k, 1 << 64) for k in range(WINDOW)], dtype=np.uint64)


def repeated_words(words: list[bytes]) -> int:
    """Words covered by windows of ``WINDOW`` words that occur twice or more.

    Windows are hashed all at once; those whose hash recurs are compared as
    words, so the count is exact.
    """
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    hashes = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        hashes += codes[k : k + n] * _MULTIPLIERS[k]
    ordered = np.sort(hashes)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    suspects = np.flatnonzero(np.isin(hashes, again))
    seen: dict[tuple, int] = {}
    keys = [tuple(words[i : i + WINDOW]) for i in suspects.tolist()]
    for key in keys:
        seen[key] = seen.get(key, 0) + 1
    starts = np.array([i for i, key in zip(suspects.tolist(), keys, strict=True) if seen[key] > 1], dtype=np.int64)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edges)[:-1] > 0))


def features_of(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The values of ``FEATURES`` for one text."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # on bytes: exactly the six ASCII white-space characters
    spaces = len(raw) - len(raw.translate(None, SPACE))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return len(words), len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines)


def _text_features(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([features_of(t) for t in texts], columns=[c.split()[0] for c in FEATURES.split(", ")], dtype="int64")


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the features, ``base_failed`` and ``_group`` added.

    Texts go to Python once: of a deterministic function Spark would push a filter on the features below it, and so
    call it twice in a task, each time in a worker process of its own.
    """
    small_batches(docs.sparkSession)
    features = F.pandas_udf(_text_features, FEATURES).asNondeterministic()
    named = docs.withColumn("_f", features(F.col(text)))
    names = [c.split()[0] for c in FEATURES.split(", ")]
    out = named.select(*(F.col(c) for c in docs.columns), *(F.col("_f")[n].alias(n) for n in names))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("_group", _group(F.col("lang"), F.col("source")))


def _group(lang: Column, source: Column) -> Column:
    part = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("null"))
    return F.concat_ws("\x00", part(lang), part(source))


def sketch(features: DataFrame) -> DataFrame:
    """``_group, lang, metric, bucket, n``: mergeable counts; bucket null holds zeros."""
    stacked = ", ".join(f"'{m}', cast({sql} AS double)" for m, (sql, _, _) in METRICS.items())
    long = features.select("_group", "lang", F.expr(f"stack({len(METRICS)}, {stacked}) AS (metric, value)"))
    bucket = F.when(F.col("value") > 0, F.floor(F.log(F.col("value")) / math.log(GAMMA)).cast("int"))
    return long.groupBy("_group", "lang", "metric", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))


def _levels(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Quartiles, mean deviation from the median and number of documents of each sketch."""
    by = Window.partitionBy(*keys, "metric")
    upto = F.sum("n").over(by.orderBy(F.col("bucket").asc_nulls_first()))
    value = F.coalesce(F.pow(F.lit(GAMMA), F.col("bucket") + 0.5), F.lit(0.0))
    ranked = sketches.select(*keys, "metric", "n", value.alias("value"), upto.alias("upto"), F.sum("n").over(by).alias("total"))
    at = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("value")))
    ranked = ranked.withColumn("median", at(2).over(by))
    spread = F.sum(F.col("n") * F.abs(F.col("value") - F.col("median"))) / F.max("total")
    return ranked.groupBy(*keys, "metric").agg(at(1).alias("q1"), at(2).alias("q2"), at(3).alias("q3"), spread.alias("d"), F.max("total").alias("total"))


#: SQL over a group's level and that of its language (l_) and of all (a_); the same for Spark and the oracle.
_PARENT = {c: f"CASE WHEN l_total >= {MIN_GROUP} THEN l_{c} ELSE a_{c} END" for c in ("q1", "q2", "q3", "d")}
_OWN = {c: f"CASE WHEN total >= {MIN_GROUP} THEN {c} ELSE p_{c} END" for c in ("q1", "q2", "q3")}
_SHRUNK = f"(total * d + {SHRINK} * p_d) / (total + {SHRINK})"


def _cutoff(multiple: float, upper: bool) -> str:
    """SQL over the parent's (p_) and the group's (o_) quartiles and deviation."""
    reach = lambda x: f"greatest({FENCE} * ({x}_q3 - {x}_q1), {multiple} * greatest({x}_d, {LEAST_SPREAD} * {x}_q2))"
    if upper:
        return f"least(o_q3 + {reach('o')}, p_q2 + {BOUND} * (p_q3 + {reach('p')} - p_q2)) * {GAMMA}"
    return f"greatest(o_q1 - {reach('o')}, p_q2 - {BOUND} * (p_q2 - p_q1 + {reach('p')})) / {GAMMA}"


def _cutoffs() -> dict[str, str]:
    """Name of each cutoff, and SQL for it as an aggregate over a group's metrics."""
    out = {}
    for metric, (_, multiple, low) in METRICS.items():
        for name, upper in [("high", True), ("low", False)][: 1 + low]:
            out[f"{metric}_{name}"] = f"max(CASE WHEN metric = '{metric}' THEN {_cutoff(multiple, upper)} END)"
    return out


def _verdict() -> str:
    tests = []
    for metric, (sql, _, low) in METRICS.items():
        tests += [f"{sql} <= {metric}_high", f"{sql} >= {metric}_low"][: 1 + low]
    return " AND ".join(tests)


def thresholds(sketches: DataFrame) -> DataFrame:
    """``_group`` and, for each metric, ``<metric>_high`` (and ``_low``): one row per (language, source)."""
    named = sketches.withColumn("_lang", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("null")))
    own = _levels(sketches.drop("lang"), ["_group"])
    by_lang = _levels(merge(named, ["_lang"]), ["_lang"])
    every = _levels(merge(sketches.withColumn("_all", F.lit(1)), ["_all"]), ["_all"]).drop("_all")
    rename = lambda d, p: d.select(*(F.col(c).alias(c if c in ("_lang", "metric") else p + c) for c in d.columns))
    langs = named.select("_group", "_lang").distinct()
    levels = own.join(langs, "_group").join(rename(by_lang, "l_"), ["_lang", "metric"]).join(rename(every, "a_"), "metric")
    levels = levels.withColumns({f"p_{c}": F.expr(sql) for c, sql in _PARENT.items()})
    levels = levels.withColumns({f"o_{c}": F.expr(sql) for c, sql in (_OWN | {"d": _SHRUNK}).items()})
    return levels.groupBy("_group").agg(*(F.expr(sql).alias(name) for name, sql in _cutoffs().items()))


def judge(features: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``features`` with ``kept``."""
    joined = join_small(features, cutoffs, "_group")
    good = ~F.col("base_failed") & F.expr(_verdict())
    return joined.select(*(F.col(c) for c in features.columns), F.coalesce(good, F.lit(False)).alias("kept"))


def learnt(features: DataFrame) -> DataFrame:
    """The cutoffs of each group, from all rows of ``features`` that pass the base rules."""
    return materialize(thresholds(materialize(sketch(features.where("NOT base_failed")), "sketch")), "cutoffs")


def filter_quality(docs: DataFrame) -> DataFrame:
    """The documents that are kept, columns as they came.

    Two passes over the texts: one feeds the sketches, one is judged while it
    streams; nothing but the small tables is shuffled or written. Rows travel
    whole in one struct, so their other columns may have any name.
    """
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").alias("text"), F.col("lang").alias("lang"), F.col("source").alias("source"))
    cutoffs = learnt(with_features(docs.select("text", "lang", "source")))
    return judge(with_features(packed), cutoffs).where("kept").select("_row.*")


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Features and verdict of every whole document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    features = materialize(with_features(docs).drop("text"), "features")
    cutoffs = learnt(features)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines"]
    return judge(features, cutoffs).select(*columns)


def _oracle() -> str:
    words = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
    lines = r"list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]'))"
    metric = " UNION ALL ".join(f"SELECT g, l, '{m}' AS metric, CAST({sql} AS DOUBLE) AS value FROM f WHERE NOT base_failed" for m, (sql, _, _) in METRICS.items())
    log_gamma = repr(math.log(GAMMA))
    level = lambda key: f"""SELECT k, metric, min(v) FILTER (upto * 4 >= total) AS q1, min(v) FILTER (upto * 2 >= total) AS q2, min(v) FILTER (upto * 4 >= total * 3) AS q3,
        sum(n * abs(v - median)) / max(total) AS d, max(total) AS total
      FROM (SELECT *, min(CASE WHEN upto * 2 >= total THEN v END) OVER (PARTITION BY k, metric) AS median
        FROM (SELECT {key} AS k, metric, n, coalesce(pow({GAMMA}, bucket + 0.5), 0.0) AS v,
          sum(n) OVER (PARTITION BY {key}, metric ORDER BY bucket NULLS FIRST) AS upto, sum(n) OVER (PARTITION BY {key}, metric) AS total
          FROM (SELECT {key}, metric, bucket, count(*) AS n FROM b GROUP BY ALL))) GROUP BY ALL"""  # noqa: E731
    columns = ("q1", "q2", "q3", "d", "total")
    joined = ", ".join(["o.k", "o.metric", *(f"{t}.{c} AS {p}{c}" for t, p in (("o", ""), ("ol", "l_"), ("oa", "a_")) for c in columns)])
    parent = ", ".join(f"{sql} AS p_{c}" for c, sql in _PARENT.items())
    own = ", ".join(f"{sql} AS o_{c}" for c, sql in (_OWN | {"d": _SHRUNK}).items())
    cuts = ", ".join(f"{sql} AS {name}" for name, sql in _cutoffs().items())
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce('=' || lang, 'null') AS l,
    coalesce('=' || lang, 'null') || chr(0) || coalesce('=' || source, 'null') AS g, text, {words} AS w, {lines} AS ls FROM documents),
x AS (SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS win FROM d, unnest(range(1, len(w) - {WINDOW - 2})) AS u(i)),
rw AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM x), unnest(range(i, i + {WINDOW})) AS u(j) WHERE c > 1 GROUP BY r),
m AS (SELECT doc_id, g, l, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines
  FROM d LEFT JOIN rw USING (r)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed FROM m),
v AS ({metric}),
b AS (SELECT *, 1 AS a, CASE WHEN value > 0 THEN CAST(floor(ln(value) / {log_gamma}) AS INT) END AS bucket FROM v),
o AS ({level('g')}), ol AS ({level('l')}), oa AS ({level('a')}),
e AS (SELECT {joined} FROM o JOIN (SELECT DISTINCT g, l FROM f) z ON z.g = o.k JOIN ol ON ol.k = z.l AND ol.metric = o.metric JOIN oa ON oa.metric = o.metric),
p AS (SELECT *, {parent} FROM e),
c AS (SELECT k, {cuts} FROM (SELECT *, {own} FROM p) GROUP BY k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(NOT base_failed AND {_verdict()}, false) AS kept, n_lines
FROM f LEFT JOIN c ON c.k = f.g
"""


ORACLE = _oracle()
