"""Mixing sources to target weights by Pareto order sampling.

Sizes (words) are summed by source; sources ordered by code point, null last, get the weights in turn and share the
wanted total; a source's target stops at a multiple of its size and the excess is shared again by weight. Every document
of a source is taken as often as the target holds the whole source (certain copies). The rest is drawn without
replacement: documents are ranked by u / (1 - u) divided by p / (1 - p), u being a number in (0, 1) made from the
document's id and p its inclusion probability, which grows with the root of its size; the ranking is followed until the
words taken are as near to the rest as a whole document allows. So the sample has a fixed size in words.

Only a threshold per source leaves the ranking, and joins the documents: no text is shuffled, and a source that holds
most rows is ranked in many range partitions.

Defined results: a null text has size 0 and is never a reason to draw; null sources are one source; rows of equal rank and
size (equal or null ids) are one step of the ranking, and where the drawing ends inside a step, as many of its rows are
drawn as come nearest to the target, in the order of their texts (rows equal in id and text stand for each other); a source
without words has target 0; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import with_rank, with_running_sums
from ..session import broadcast_if_small, materialise
from .common import same, sealed

#: Weights by turn, share of all words wanted, copies of a document at most.
WEIGHTS, SHARE_PERCENT, MAX_COPIES = (3, 1, 2), 150, 2
SEED = "mix"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def odds(doc_id: Column, seed: str = SEED) -> Column:
    """u / (1 - u) for a reproducible u in (0, 1); a null id counts as the empty text."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    u = (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2 ** 52))
    return u / (1 - u)


def preference(size: Column) -> Column:
    """The whole root of the size: inclusion odds of the fractional copy grow with it."""
    return F.floor(F.sqrt(size.cast("double"))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT,
                   max_copies: int = MAX_COPIES) -> DataFrame:
    """``source source_size pull target``: from rows of ``source size``; ``pull`` is the sum of preference times size."""
    sources = materialise(sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum(preference(F.col("size")) * F.col("size")).alias("pull")), "mix-sources")
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = with_rank(sources, [F.col("source").isNull(), "source"], "place").select(
        "source", "source_size", "pull", turn.cast("long").alias("weight"),
        (F.lit(max_copies) * F.col("source_size")).alias("most"))
    # by rising capacity per weight, the sources that stop at their capacity come first
    summed = with_running_sums(
        weighed.withColumn("ratio", F.col("most") / F.col("weight")), ["ratio", F.col("source").isNull(), "source"],
        {"most_so_far": "most", "weight_so_far": "weight"}, totals={"all_size": "source_size", "all_weight": "weight"})
    wanted = F.lit(share_percent) * F.col("all_size") / F.lit(100)
    level = (wanted - (F.col("most_so_far") - F.col("most"))) / (
        F.col("all_weight") - (F.col("weight_so_far") - F.col("weight")))
    levels = materialise(summed.withColumn("level", level), "mix-levels")
    free = levels.where(F.col("most") > F.col("level") * F.col("weight")).agg(F.max("level")).first()[0]
    target = F.col("most").cast("double")
    if free is not None:
        target = F.least(target, F.lit(free) * F.col("weight"))
    return levels.select("source", "source_size", "pull", target.alias("target"))


def thresholds(sizes: DataFrame, targets: DataFrame, seed: str = SEED) -> DataFrame:
    """``source source_size target whole factor last divided some``: certain copies, and the last rank drawn (null: none).

    ``sizes`` has ``source size doc_id``. Documents of equal rank and size are one step of the ranking, ``last`` and ``divided``
    are steps (rank and size); of the step ``divided`` (null: none) only ``some`` documents are drawn.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    plan = targets.withColumn("whole", whole).withColumn("rest", rest).withColumn(
        "factor", F.when(F.col("pull") > 0, F.col("rest") / F.col("pull")).otherwise(0.0))
    plan = materialise(plan, "mix-plan")
    drawn = broadcast_if_small(plan.where("rest > 0").select(F.col("source").alias("s"), "factor", "rest"))
    ranked = sizes.where("size > 0").join(drawn, same(F.col("source"), F.col("s")))
    steps = ranked.groupBy("source", rank_value(F.col("doc_id"), F.col("size"), F.col("factor"), seed).alias("q"), "size").agg(
        F.sum("size").alias("words"), F.count("*").alias("n"), F.first("rest").alias("rest"))
    summed = with_running_sums(steps, ["q", "size"], {"so_far": "words"}, group_by=["source"])
    before = F.col("so_far") - F.col("words")
    some = F.floor((F.col("rest") - before) * F.col("n") / F.col("words") + F.lit(0.5)).cast("long")
    divided = (before < F.col("rest")) & (F.col("so_far") > F.col("rest")) & (some > 0) & (some < F.col("n"))
    near = F.col("so_far") + before <= 2 * F.col("rest")
    step = F.struct("q", "size")
    last = summed.groupBy(F.col("source").alias("s")).agg(
        F.max(F.when(near & ~divided, step)).alias("last"), F.max(F.when(divided, step)).alias("divided"),
        F.max(F.when(divided, some)).alias("some"))
    return plan.join(last, same(F.col("source"), F.col("s")), "left").select(
        "source", "source_size", "target", "whole", "factor", "last", "divided", "some")


def rank_value(doc_id: Column, size: Column, factor: Column, seed: str) -> Column:
    p = factor * preference(size)
    return F.when(p >= 1, F.lit(0.0)).otherwise(odds(doc_id, seed) * ((1 - p) / p))


def _with_copies(joined: DataFrame, plan: DataFrame, source: str, size: Column, doc_id: str, seed: str,
                 order: list[Column]) -> DataFrame:
    """``_copies`` of every row of a frame joined with its plan; ``order`` decides between rows of a divided step."""
    step = F.struct(rank_value(F.col(doc_id), size, F.col("_factor"), seed).alias("q"), size.alias("size"))
    drawn = (size > 0) & F.col("_last").isNotNull() & (step <= F.col("_last"))
    counted = joined.withColumn("_copies", F.col("_whole") + F.when(drawn, 1).otherwise(0))
    if plan.where("divided IS NOT NULL").isEmpty():
        return counted
    tied = F.coalesce((size > 0) & F.col("_divided").isNotNull() & (step == F.col("_divided")), F.lit(False))
    # the row's own number comes last, so that any number of equal rows is spread over the range partitions
    rows = joined.where(tied).withColumns({"_one": F.lit(1), "_row": F.monotonically_increasing_id()})
    placed = with_running_sums(rows, [*order, "_row"], {"_nth": "_one"}, group_by=[source])
    some = placed.withColumn("_copies", F.col("_whole") + F.when(F.col("_nth") <= F.col("_some"), 1).otherwise(0))
    return counted.where(~tied).unionByName(some.select(counted.columns))


def plan_mix(docs: DataFrame, text: str, source: str, doc_id: str, seed: str, **options) -> tuple[DataFrame, DataFrame]:
    """Sizes of the documents (``doc_id source size``, written once) and the plan of their sources."""
    sizes = materialise(docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"),
        word_count(F.col(f"`{text}`")).alias("size")), "mix-sizes")
    return sizes, materialise(thresholds(sizes, source_targets(sizes, **options), seed), "mix-thresholds")


def _join_plan(frame: DataFrame, source: str, plan: DataFrame) -> DataFrame:
    small = broadcast_if_small(plan.select(*[F.col(c).alias(f"_{c}") for c in plan.columns]))
    return frame.join(small, same(F.col(f"`{source}`"), F.col("_source")))


def mix_report(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id",
               seed: str = SEED, **options) -> DataFrame:
    """``doc_id size source_size target taken`` of every document."""
    sizes, plan = plan_mix(docs, text, source, doc_id, seed, **options)
    counted = _with_copies(_join_plan(sizes, "source", plan), plan, "source", F.col("size"), "doc_id", seed,
                           [F.col("doc_id")])
    return counted.select(
        "doc_id", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        (F.col("_copies") * F.col("size")).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id",
                  seed: str = SEED, **options) -> DataFrame:
    """The mix itself: every row as often as it is taken, with its own columns."""
    _, plan = plan_mix(docs, text, source, doc_id, seed, **options)
    frame, names = sealed(docs)
    content = F.col(names[text])
    counted = _with_copies(_join_plan(frame, names[source], plan), plan, names[source], word_count(content), names[doc_id], seed,
                           [F.col(names[doc_id]), F.xxhash64(content), F.xxhash64(F.lit(seed), content)])
    taken = counted.where("_copies > 0")
    return taken.select(*names.values(), F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(
        *[F.col(n).alias(c) for c, n in names.items()])


ORACLE_CORE = f"""
mix_sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM {{docs}}),
mix_sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST(sum(CAST(floor(sqrt(CAST(size AS DOUBLE))) AS BIGINT) * size) AS BIGINT) AS pull
  FROM mix_sizes GROUP BY source),
mix_weighed AS (
  SELECT *, {MAX_COPIES} * source_size AS most,
         [{', '.join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(WEIGHTS)} + 1] AS weight
  FROM mix_sources),
mix_levels AS (
  SELECT *, ({SHARE_PERCENT} * CAST(sum(source_size) OVER () AS BIGINT) / 100 - (CAST(sum(most) OVER w AS BIGINT) - most))
            / (CAST(sum(weight) OVER () AS BIGINT) - (CAST(sum(weight) OVER w AS BIGINT) - weight)) AS level
  FROM mix_weighed WINDOW w AS (ORDER BY most / weight, source IS NULL, source)),
mix_targets AS (
  SELECT source, source_size, pull, least(CAST(most AS DOUBLE), coalesce((
           SELECT max(level) FROM mix_levels WHERE most > level * weight) * weight, CAST(most AS DOUBLE))) AS target
  FROM mix_levels),
mix_plan AS (
  SELECT *, target - whole * source_size AS rest,
         CASE WHEN pull > 0 THEN (target - whole * source_size) / pull ELSE 0 END AS factor
  FROM (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole
        FROM mix_targets)),
mix_odds AS (
  SELECT s.*, p.source_size, p.target, p.whole, p.rest, p.factor * CAST(floor(sqrt(CAST(size AS DOUBLE))) AS BIGINT) AS p,
         (CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5::DOUBLE)
           / {float(2 ** 52)}::DOUBLE AS u
  FROM mix_sizes s JOIN mix_plan p ON s.source IS NOT DISTINCT FROM p.source),
mix_ranked AS (
  SELECT *, CASE WHEN p >= 1 THEN 0 WHEN p > 0 THEN u / (1 - u) * ((1 - p) / p) END AS q FROM mix_odds),
mix_steps AS (
  SELECT source, q, size, first(rest) AS rest, CAST(sum(size) AS BIGINT) AS words, count(*) AS n FROM mix_ranked
  WHERE size > 0 AND rest > 0 GROUP BY source, q, size),
mix_sums AS (
  SELECT *, CAST(sum(words) OVER (PARTITION BY source ORDER BY q, size) AS BIGINT) AS so_far FROM mix_steps),
mix_divided AS (
  SELECT *, so_far - words < rest AND so_far > rest AND few > 0 AND few < n AS divided FROM (
    SELECT *, CAST(floor((rest - (so_far - words)) * n / words + 0.5::DOUBLE) AS BIGINT) AS few FROM mix_sums)),
mix_last AS (
  SELECT source, max(so_far) FILTER (WHERE so_far + (so_far - words) <= 2 * rest AND NOT divided) AS last,
         max(so_far) FILTER (WHERE divided) AS divided, max(few) FILTER (WHERE divided) AS few
  FROM mix_divided GROUP BY source),
mix_taken AS (
  SELECT r.*, r.whole + CASE WHEN so_far <= l.last OR so_far = l.divided AND nth <= l.few THEN 1 ELSE 0 END AS copies
  FROM (SELECT *, row_number() OVER (PARTITION BY source, q, size ORDER BY doc_id) AS nth FROM mix_ranked) r
  LEFT JOIN mix_sums s ON r.source IS NOT DISTINCT FROM s.source AND r.q = s.q AND r.size = s.size
  LEFT JOIN mix_last l ON r.source IS NOT DISTINCT FROM l.source)"""

ORACLE = "WITH " + ORACLE_CORE.format(docs="documents") + """
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken FROM mix_taken"""
