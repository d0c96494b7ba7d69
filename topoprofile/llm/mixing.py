"""Mixing sources to target weights by Poisson replication, in built-in functions only.

Each source gets a mean repetition rate: its target share of the mixture's
characters over its own share, times ``budget``. A document's number of copies is
a Poisson variate with that mean, found by inverting the distribution at a
uniform number hashed from the seed and the document: the count is the number of
cumulative probabilities at or below it. Rates over ``CHUNK`` are split into
equal parts with a uniform number each (sums of Poisson variates are Poisson), so
no probability underflows. The copies are shuffled globally by a hashed key.

Defined cases. Null source: a source of its own, weighted like the others. Null
text counts as one character, like the empty one. A null document id is hashed by
its text. Rows that repeat an id share its draw. A source that the weights do not
name, or weigh 0, gets no copies; an empty table gives an empty one. Extra columns
are kept, whatever their names; columns named ``copy`` or ``shuffle_key`` are
replaced.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topoprofile.llm.joins import join_small
from topoprofile.runtime import materialize

CHUNK = 16
#: P(X > 80) at mean 16 is below 2**-52, the step of the uniform numbers.
TERMS = 80
#: Without given weights a source's target is its characters to this power.
TEMPERATURE = 0.5
_NULL = "\x00null"


def source_rates(docs: DataFrame, weights: Mapping[str | None, float] | None = None, budget: float = 1.0) -> DataFrame:
    """``_source, rate, parts, cdf``: one row per source, from counts over all documents."""
    spark = docs.sparkSession
    mass = docs.groupBy(F.coalesce("source", F.lit(_NULL)).alias("_source")).agg(
        F.sum(F.greatest(F.coalesce(F.length("text"), F.lit(1)), F.lit(1)).cast("long")).alias("mass")
    )
    if weights is None:
        target = mass.withColumn("target", F.pow(F.col("mass").cast("double"), F.lit(TEMPERATURE)))
    else:
        rows = [(_NULL if k is None else str(k), float(v)) for k, v in weights.items()]
        given = spark.createDataFrame(rows, "_source string, target double")
        target = mass.join(given, "_source", "left").na.fill(0.0, ["target"])
    everything = Window.partitionBy(F.lit(0))  # a row per source
    share = F.col("target") / F.sum("target").over(everything)
    rated = target.select("_source", "target", F.round(share * F.sum("mass").over(everything) * F.lit(float(budget)) / F.col("mass"), 9).alias("rate"))
    rated = rated.where("target > 0").drop("target")
    rated = rated.withColumn("parts", F.greatest(F.ceil(F.col("rate") / CHUNK), F.lit(1)).cast("int"))
    cdf = f"""aggregate(sequence(1, {TERMS}), named_struct('p', exp(-(rate / parts)), 'c', array(exp(-(rate / parts)))),
        (a, k) -> named_struct('p', a.p * (rate / parts) / k, 'c', array_append(a.c, element_at(a.c, -1) + a.p * (rate / parts) / k)), a -> a.c)"""
    return rated.withColumn("cdf", F.expr(cdf))


def _uniform(what: str) -> str:
    """SQL: a number in [0, 1) from the first 52 bits of an MD5 digest."""
    return f"(cast(conv(substring(md5({what}), 1, 13), 16, 10) AS bigint) / 4503599627370496.0D)"


def poisson_mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, budget: float = 1.0, seed: int = 17) -> DataFrame:
    """The replicated and globally shuffled documents, with ``copy`` (from 0) and ``shuffle_key``.

    Documents meet their rates in a broadcast join of the counted source table,
    are exploded by their counts and cross the network once, dealt by the hashed
    key; inside a partition they are sorted by it, so the whole order is a
    uniform permutation that a rerun repeats.
    """
    docs = docs.drop("copy", "shuffle_key")
    rates = materialize(source_rates(docs, weights, budget), "rates")
    identity = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce("text", F.lit("")))))
    named = docs.select(F.struct(*docs.columns).alias("_row"), F.coalesce("source", F.lit(_NULL)).alias("_source"), identity.alias("_id"))
    rated = join_small(named, rates, "_source")
    draw = _uniform(f"concat('{seed}|', _id, '|', j)")
    count = f"aggregate(sequence(1, parts), 0, (n, j) -> n + size(transform(array({draw}), u -> filter(cdf, c -> c <= u))[0]))"
    counted = rated.withColumn("_n", F.expr(f"CASE WHEN parts IS NULL THEN 0 ELSE {count} END")).where("_n > 0")
    copies = counted.withColumn("copy", F.explode(F.expr("sequence(0L, cast(_n AS bigint) - 1L)")))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat(F.lit(f"{seed}|order|"), "_id", F.lit("|"), F.col("copy").cast("string"))))
    out = keyed.select("_row.*", "copy", "shuffle_key")
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def op9_poisson_mix(spark, sf_dir: str) -> DataFrame:
    """All documents, replicated to square-root weights of their sources."""
    return poisson_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT *, coalesce(source, chr(0) || 'null') AS s, coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5(coalesce(text, ''))) AS i FROM documents
), m AS (SELECT s, CAST(sum(greatest(coalesce(length(text), 1), 1)) AS BIGINT) AS mass FROM d GROUP BY s),
t AS (SELECT *, pow(CAST(mass AS DOUBLE), {TEMPERATURE}) AS target FROM m),
r AS (SELECT s, round(target / sum(target) OVER () * CAST(sum(mass) OVER () AS BIGINT) / mass, 9) AS rate FROM t),
q AS (SELECT *, greatest(ceil(rate / {CHUNK}), 1) AS parts FROM r),
c AS (
  SELECT s, 0 AS k, exp(-(rate / parts)) AS p, exp(-(rate / parts)) AS c, rate / parts AS l FROM q
  UNION ALL SELECT s, k + 1, p * l / (k + 1), c + p * l / (k + 1), l FROM c WHERE k < {TERMS}
),
cdf AS (SELECT s, list(c ORDER BY k) AS cdf FROM c GROUP BY s),
n AS (
  SELECT d.*, list_sum(list_transform(range(1, CAST(parts AS BIGINT) + 1), lambda j: len(list_filter(cdf, lambda x: x <=
     CAST(('0x' || substring(md5('17|' || i || '|' || j), 1, 13)) AS BIGINT) / 4503599627370496.0)))) AS n
  FROM d JOIN q USING (s) JOIN cdf USING (s)
)
SELECT doc_id, text, lang, source, n_chars, copy, md5('17|order|' || i || '|' || copy) AS shuffle_key
FROM n, unnest(range(0, CAST(n AS BIGINT))) AS u(copy)
"""
