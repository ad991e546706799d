"""Mixing sources to target weights that vary over training (a curriculum)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .shared import free_name, quoted

Schedule = Sequence[tuple[float, float]]

#: The largest source leads early and gives way; the others share the rest evenly.
PRODUCTION_SCHEDULES: Mapping[str, Schedule] = {"src0": ((0.0, 0.45), (0.5, 0.35), (1.0, 0.25))}
PRODUCTION_DEFAULT: Schedule = ((0.0, 0.030), (1.0, 0.038))
SEED = "mix-1"
BUCKETS_HEX = 3


def _at(schedule: Schedule, t: float) -> float:
    """The piecewise linear weight at t; constant before the first and after the last knot."""
    pts = sorted(schedule)
    if t <= pts[0][0]:
        return float(pts[0][1])
    for (a, x), (b, y) in zip(pts, pts[1:]):
        if t <= b:
            return float(x + (y - x) * (t - a) / (b - a)) if b > a else float(y)
    return float(pts[-1][1])


def knots_of(schedules: Mapping[str, Schedule], default: Schedule) -> list[float]:
    """All knots in [0, 1], with both ends."""
    ts = {0.0, 1.0} | {float(t) for s in [*schedules.values(), default] for t, _ in s if 0 < t < 1}
    return sorted(ts)


def mix_sources(
    df: DataFrame,
    schedules: Mapping[str, Schedule],
    default: Schedule,
    tokens_col: str,
    id_col: str = "doc_id",
    source_col: str = "source",
    budget_tokens: int | None = None,
    seed: str = SEED,
) -> DataFrame:
    """Training positions for documents, so that at each time the sources arrive in target weights.

    A source's schedule is piecewise linear over training time 0..1.  At each knot the weights
    of the sources present are normalised to shares; between knots shares are linear.  A
    source's demand up to time t is the budget times the integral of its share, and a document
    that starts at token c of its source is due at the time when the demand is c.  Documents of
    a source come in the order of a hash of (seed, id).  A source with less than its demand is
    repeated (column ``epoch`` counts from 0), one with more is cut.  The budget is the sum of
    all tokens unless given.

    Adds ``epoch`` (int), ``offset_tokens`` (long) and ``position`` (double), each with a number
    at the end of its name if ``df`` has a column of that name, which stays as it is.  Rows are range
    sorted by position.  The offset is a prefix sum in two levels: totals of 4096 hash buckets of
    each source, then a window inside a bucket, so that a hot source is spread over 4096 groups.

    Defined results: a null source is a source of its own with the default schedule; a null or
    non-positive token count counts as 1; null ids come first in their source; rows that
    repeat are separate documents; ties of position sort by source, id and epoch; texts, empty or long, aren't read, only
    their token counts; a weight of 0 at all knots leaves a source out; an empty table gives
    an empty table.
    """
    knots = knots_of(schedules, default)
    keep = list(df.columns)
    epoch, offset_name, position_name = (free_name(keep, c) for c in ("epoch", "offset_tokens", "position"))
    src, ident = F.col(quoted(source_col)), F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit(""))
    tok = F.greatest(F.coalesce(F.col(quoted(tokens_col)).cast("long"), F.lit(1)), F.lit(1))
    order = F.md5(F.concat(F.lit(seed), F.lit(":"), ident))
    # a key that is never null, so that window and join need one partitioning
    named = F.coalesce(F.concat(F.lit("="), src.cast("string")), F.lit(""))
    base = df.select(*[F.col(quoted(c)) for c in keep], tok.alias("__qm_tok"), named.alias("__qm_src"), order.alias("__qm_key"), F.substring(order, 1, BUCKETS_HEX).alias("__qm_bucket"))

    # small: one row for each (source, bucket), from a narrow scan
    totals = base.groupBy(F.col("__qm_src").alias("__qm_s"), F.col("__qm_bucket").alias("__qm_b")).agg(F.sum("__qm_tok").alias("__qm_bt"))
    before = Window.partitionBy("__qm_s").orderBy("__qm_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("__qm_before", F.coalesce(F.sum("__qm_bt").over(before), F.lit(0))).withColumn("__qm_supply", F.sum("__qm_bt").over(Window.partitionBy("__qm_s")))

    raw = F.array(*[F.lit(_at(default, t)) for t in knots])
    if schedules:
        listed = df.sparkSession.createDataFrame([(f"={s}", [_at(w, t) for t in knots]) for s, w in schedules.items()], "__qm_l string, __qm_w array<double>")
        per = totals.groupBy("__qm_s").agg(F.max("__qm_supply").alias("__qm_c")).join(listed, F.col("__qm_s") == F.col("__qm_l"), "left").select("__qm_s", "__qm_c", F.coalesce("__qm_w", raw).alias("__qm_w"))
    else:
        per = totals.groupBy("__qm_s").agg(F.max("__qm_supply").alias("__qm_c")).withColumn("__qm_w", raw)
    whole = per.agg(F.sum("__qm_c").alias("__qm_total"), *[F.sum(F.col("__qm_w")[k]).alias(f"__qm_sum{k}") for k in range(len(knots))])
    share = F.array(*[F.coalesce(F.col("__qm_w")[k] / F.nullif(F.col(f"__qm_sum{k}"), F.lit(0.0)), F.lit(0.0)) for k in range(len(knots))])
    per = per.crossJoin(whole).select("__qm_s", "__qm_c", share.alias("__qm_p"), (F.lit(float(budget_tokens)) if budget_tokens is not None else F.col("__qm_total").cast("double")).alias("__qm_budget"))
    area = F.lit(0.0)
    areas = [area]
    for k in range(1, len(knots)):
        area = area + (F.col("__qm_p")[k - 1] + F.col("__qm_p")[k]) / 2 * (knots[k] - knots[k - 1])
        areas.append(area)
    per = per.withColumn("__qm_i", F.array(*areas))

    buckets = totals.join(per, "__qm_s")
    inside = Window.partitionBy("__qm_src", "__qm_bucket").orderBy("__qm_key", F.col(quoted(id_col)), "__qm_tok").rowsBetween(Window.unboundedPreceding, -1)
    placed = base.withColumn("__qm_in", F.coalesce(F.sum("__qm_tok").over(inside), F.lit(0))).join(buckets, (F.col("__qm_src") == F.col("__qm_s")) & (F.col("__qm_bucket") == F.col("__qm_b")))
    start = F.col("__qm_before") + F.col("__qm_in")
    demand = F.col("__qm_budget") * F.col("__qm_i")[len(knots) - 1]
    copies = F.ceil((demand - start) / F.col("__qm_c")).cast("int")
    out = placed.filter(start < demand).withColumn("__qm_e", F.explode(F.sequence(F.lit(0), copies - 1)))
    offset = start + F.col("__qm_e").cast("long") * F.col("__qm_c")
    x = offset / F.col("__qm_budget")
    position = F.lit(1.0)
    for k in reversed(range(len(knots) - 1)):
        p0, p1, left = F.col("__qm_p")[k], F.col("__qm_p")[k + 1], F.greatest(x - F.col("__qm_i")[k], F.lit(0.0))
        root = F.sqrt(F.greatest(p0 * p0 + 2 * (p1 - p0) * left / (knots[k + 1] - knots[k]), F.lit(0.0)))
        here = F.lit(knots[k]) + 2 * left / (p0 + root)
        position = F.when((x < F.col("__qm_i")[k + 1]), F.when(p0 + root > 0, here).otherwise(F.lit(knots[k]))).otherwise(position)
    return (
        out.select(*[F.col(quoted(c)) for c in keep], F.col("__qm_e").alias(epoch), offset.alias(offset_name), position.alias(position_name))
        .orderBy(position_name, F.col(quoted(source_col)), F.col(quoted(id_col)), epoch)
    )


def text_tokens(text_col: str = "text"):
    """Estimated tokens of a text: a quarter of its UTF-8 bytes, rounded up."""
    return ((F.octet_length(F.col(quoted(text_col))) + 3) / 4).cast("long")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training positions of all documents under the production schedule."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", text_tokens().alias("tokens"))
    mixed = mix_sources(docs, PRODUCTION_SCHEDULES, PRODUCTION_DEFAULT, "tokens")
    return mixed.select("doc_id", "source", "epoch", "offset_tokens", F.round("position", 6).alias("position"))


def mixing_sql(schedules: Mapping[str, Schedule], default: Schedule) -> str:
    """The same result in DuckDB SQL, over ``documents``."""
    knots = knots_of(schedules, default)
    n = len(knots)
    lst = lambda s: "[" + ", ".join(f"{_at(s, t)!r}::DOUBLE" for t in knots) + "]"
    case = "CASE " + " ".join(f"WHEN source = '{s}' THEN {lst(w)}" for s, w in schedules.items()) + f" ELSE {lst(default)} END" if schedules else lst(default)
    area = "0.0::DOUBLE"
    areas = [area]
    for k in range(1, n):
        area += f" + (p[{k}] + p[{k + 1}]) / 2 * {knots[k] - knots[k - 1]!r}"
        areas.append(area)
    pos = "1.0"
    for k in reversed(range(n - 1)):
        left = f"greatest(x - i[{k + 1}], 0.0)"
        root = f"sqrt(greatest(p[{k + 1}] * p[{k + 1}] + 2 * (p[{k + 2}] - p[{k + 1}]) * {left} / {knots[k + 1] - knots[k]!r}, 0.0))"
        pos = f"CASE WHEN x < i[{k + 2}] THEN {knots[k]!r} + 2 * {left} / (p[{k + 1}] + {root}) ELSE {pos} END"
    return f"""
WITH d AS (SELECT doc_id, source, greatest(coalesce((strlen(text) + 3) // 4, 1), 1) AS tok, md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
r AS (SELECT *, (sum(tok) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, tok ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - tok)::BIGINT AS start FROM d),
s AS (SELECT source, sum(tok)::DOUBLE AS c, {case} AS w FROM d GROUP BY source),
w AS (SELECT sum(c) AS budget, {", ".join(f"sum(w[{k + 1}]) AS t{k}" for k in range(n))} FROM s),
p AS (SELECT source, c, budget, [{", ".join(f"w[{k + 1}] / t{k}" for k in range(n))}] AS p FROM s, w),
i AS (SELECT *, [{", ".join(areas)}] AS i FROM p),
e AS (SELECT doc_id, r.source, start, c, budget, p, i, unnest(range(0, ceil((budget * i[{n}] - start) / c)::INT)) AS epoch
      FROM r JOIN i ON r.source IS NOT DISTINCT FROM i.source WHERE start < budget * i[{n}]),
o AS (SELECT *, (start + epoch * c)::BIGINT AS offset_tokens, (start + epoch * c) / budget AS x FROM e)
SELECT doc_id, source, epoch::INT AS epoch, offset_tokens, round({pos}, 6) AS position FROM o
"""


OP3_SQL = mixing_sql(PRODUCTION_SCHEDULES, PRODUCTION_DEFAULT)
