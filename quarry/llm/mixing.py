"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Every source gets a target number of words. A source whose target is r times its own words
takes each of its documents floor(r) times for certain; the words still missing are a sample.
A document's inclusion probability is proportional to its size, min(1, c * size), with the c
that makes the expected words those that are missing. Documents are ranked by Pareto's
statistic, the random odds u / (1 - u) over the inclusion odds p / (1 - p), and the sample is
the start of that ranking that fills the words still missing.

The ranking is never sorted as a whole: sizes are summed by (source, slice of the ranking),
the slice in which the target falls is found on those sums, and only that slice is ranked
document by document. Then one more document may top the sample up, the one whose size fits
the words still missing best. Rows alike in source, id and text are one unit of the ranking,
however many they are; a unit that would pass the target gives the share of its rows that fits.
"""

from __future__ import annotations

from itertools import cycle

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import documents, materialize, prepare

#: Weights of the sources in code point order (null last), repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix over words of the input, and over words of any one source at most.
SHARE, MOST = 1.5, 2.0
SEED = "mix-1"
#: Units of a slice of the ranking, about, and slices of each source at least.
SLICE_UNITS, SLICES = 50_000, 64
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def digest(doc_id: Column, text: Column, seed: str) -> Column:
    """The unit of a row: an MD5 of its id, its text and the seed."""
    return F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary")), F.lit(seed)).cast("binary"))


def uniform(unit: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of a digest."""
    return (F.conv(F.substring(unit, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2 ** 52))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """source, source_size, target: one row per source.

    Targets share ``share`` of all sizes by weight; what lies above ``most`` times a source's
    size goes to the others by weight until none is above. That ends at one level L with
    target = min(most * size, L * weight): the sources that stop are the first ones by
    size / weight, so L follows from running sums in that order."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row per source from here on
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    one = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("k", F.row_number().over(one) - 1).withColumn("weight", weight)
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), "k")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(everything) * share
             - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most) / F.sum("weight").over(after)
    per = per.withColumn("level", level)
    free = F.col("level") * F.col("weight") <= F.col("source_size") * most
    # the first source in that order that does not stop has the level
    first = F.min(F.when(free, F.struct(F.col("source_size") / F.col("weight"), "k", "level"))).over(everything)["level"]
    target = F.least(F.col("source_size") * F.lit(float(most)),
                     F.coalesce(first, F.lit(float("inf"))) * F.col("weight"))
    return per.select("source", "source_size", target.alias("target"))


def inclusion(units: DataFrame, per: DataFrame) -> DataFrame:
    """source, c: inclusion probabilities min(1, c * size) whose expected words are ``missing``.

    The largest sizes are the ones that reach 1; with the first j of them at 1,
    c = (missing - their words) / (sum of the squares of the others), and the least j fits for
    which the next size stays below 1. One row per (source, size) is looked at."""
    big = lambda c: c.cast("decimal(38,0)")
    hist = units.where("size > 0").groupBy("source", "size").agg(F.sum("n").alias("m"))
    hist = hist.withColumns({"w": big(F.col("m") * F.col("size")), "w2": big(F.col("m").cast("decimal(18,0)") * F.col("size").cast("decimal(18,0)") * F.col("size").cast("decimal(10,0)"))})
    order = Window.partitionBy("source").orderBy(F.col("size").desc())
    above = F.coalesce(F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double")
    rest = F.sum("w2").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)).cast("double")
    hist = hist.select("source", "size", above.alias("above"), rest.alias("rest")).withColumnRenamed("source", "h_source")
    hist = hist.join(per.select("source", "missing"), F.col("source").eqNullSafe(F.col("h_source")))
    hist = hist.withColumn("c", (F.col("missing") - F.col("above")) / F.col("rest"))
    return hist.where(F.col("c") * F.col("size") <= 1).groupBy("source").agg(F.max_by("c", "size").alias("c"))


def rank_of(u: Column, size: Column, c: Column) -> Column:
    """Pareto's statistic q as q / (1 + q): 0 for a document that is in for certain, 1 for one without words."""
    p = c * size
    q = (u / (1 - u)) / (p / (1 - p))
    return F.when((size <= 0) | (c <= 0) | c.isNull(), F.lit(1.0)).when(p >= 1, F.lit(0.0)).otherwise(q / (1 + q))


def _decisions(units: DataFrame, weights, share, most, slices) -> DataFrame:
    """One row per source: what a document needs to know to find its number of copies."""
    per = source_targets(units.withColumn("size", F.col("n") * F.col("size")), weights, share, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    per = per.withColumn("certain", F.floor(ratio + 1e-12).cast("long"))
    per = per.withColumn("missing", F.when(ratio - F.col("certain") > 1e-9, F.col("target") - F.col("certain") * F.col("source_size")).otherwise(F.lit(0.0)))
    per = materialize(per)
    odds = inclusion(units, per).withColumnRenamed("source", "o_source")
    per = materialize(per.join(odds, F.col("source").eqNullSafe(F.col("o_source")), "left").drop("o_source"))

    p = per.select(F.col("source").alias("s_source"), "c", "missing")
    same = F.col("source").eqNullSafe(F.col("s_source"))
    keyed = units.where("size > 0").join(p.where("missing > 0"), same).drop("s_source")
    keyed = keyed.withColumns({"t": rank_of(F.col("u"), F.col("size"), F.col("c")), "words": F.col("n") * F.col("size")})
    keyed = materialize(keyed.withColumn("slice", F.floor(F.col("t") * slices).cast("int")).select("source", "unit", "n", "size", "words", "t", "slice", "missing"))
    sums = keyed.groupBy("source", "slice").agg(F.sum("words").alias("words"), F.first("missing").alias("missing"))
    run = Window.partitionBy("source").orderBy("slice")
    sums = sums.withColumn("upto", F.sum("words").over(run))
    # the slice in which the missing words run out: the first that would exceed them
    cut = materialize(sums.where(F.col("upto") > F.col("missing")).groupBy(F.col("source").alias("s_source"))
                      .agg(F.min("slice").alias("cut"), F.min_by(F.col("upto") - F.col("words"), "slice").alias("base")))  # one row per source

    within = keyed.join(cut, same & (F.col("slice") == F.col("cut"))).drop("s_source")
    rank = Window.partitionBy("source").orderBy("t", "unit")
    within = within.withColumn("upto", F.col("base") + F.sum("words").over(rank))
    last = (within.where(F.col("upto") <= F.col("missing")).groupBy(F.col("source").alias("l_source"))
            .agg(F.max(F.struct("t", "unit")).alias("last"), F.max("upto").alias("filled")))
    b = cut.join(p.select(F.col("s_source").alias("p_source"), "missing"), F.col("s_source").eqNullSafe(F.col("p_source")))
    bounds = (b.join(last, F.col("s_source").eqNullSafe(F.col("l_source")), "left")
              .select(F.col("s_source").alias("b_source"), F.coalesce("last.t", F.col("cut") / F.lit(float(slices))).alias("t_to"),
                      F.coalesce("last.unit", F.lit("")).alias("unit_to"), (F.col("missing") - F.coalesce("filled", "base")).alias("gap")))
    bounds = materialize(bounds)

    here = F.col("source").eqNullSafe(F.col("b_source"))
    rest = keyed.join(bounds, here).where(~_chosen())
    # as many of a unit's rows as fit, or one more if that comes nearer
    part = F.least(F.col("n"), F.round(F.col("gap") / F.col("size")).cast("long"))
    off = F.abs(part * F.col("size") - F.col("gap"))
    top = (rest.where((part > 0) & (off < F.col("gap"))).groupBy("b_source")
           .agg(F.min_by(F.struct("unit", (part / F.col("n")).alias("part")), F.struct(off, "t", "unit")).alias("top")).withColumnRenamed("b_source", "t_source"))
    out = per.join(bounds, here, "left").join(top, F.col("source").eqNullSafe(F.col("t_source")), "left")
    return materialize(out.select(F.col("source").alias("d_source"), "source_size", "target", "certain", "missing", "c", "t_to", "unit_to",
                                  F.col("top.unit").alias("unit_top"), F.col("top.part").alias("part")))


def _chosen() -> Column:
    """In the start of the ranking."""
    return (F.col("t") < F.col("t_to")) | ((F.col("t") == F.col("t_to")) & (F.col("unit") <= F.col("unit_to")))


def _marked(rows: DataFrame, weights, share, most, seed, slices, id_col, text_col, source_col) -> DataFrame:
    """``rows`` has one column, the struct _row; adds _mix beside it."""
    r = lambda c: F.col("_row").getField(c)
    keyed = rows.select("_row", r(source_col).alias("source"), digest(r(id_col), r(text_col), seed).alias("unit"), n_words(r(text_col)).alias("size"))
    units = materialize(keyed.groupBy("source", "unit").agg(F.count("*").alias("n"), F.max("size").alias("size")).withColumn("u", uniform(F.col("unit"))))
    if slices is None:
        slices = max(SLICES, units.count() // SLICE_UNITS)
    d = _decisions(units, weights, share, most, slices)
    keyed = keyed.join(d, F.col("source").eqNullSafe(F.col("d_source")), "left").withColumn("t", rank_of(uniform(F.col("unit")), F.col("size"), F.col("c")))
    in_part = (F.col("part") >= 1) | (F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 30)) < F.col("part") * (1 << 30))
    drawn = F.coalesce(_chosen(), F.lit(True)) | F.coalesce((F.col("unit") == F.col("unit_top")) & in_part, F.lit(False))
    copies = (F.col("certain") + F.when((F.col("missing") > 0) & (F.col("size") > 0) & drawn, 1).otherwise(0)).cast("long")
    pareto = F.when((F.col("missing") > 0) & (F.col("t") > 0) & (F.col("t") < 1), F.col("t") / (1 - F.col("t")))
    mixed = F.struct("size", F.col("source_size").cast("long").alias("source_size"), "target", copies.alias("copies"), pareto.alias("pareto"))
    return keyed.select("_row", mixed.alias("_mix"))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED,
        slices: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``_row`` (every row of ``docs``, as a struct) and ``_mix``: struct(size, source_size, target, copies, pareto).

    A null text has size 0, a null source is a source of its own. A null id is drawn by its text, like
    rows that share an id. Rows alike in all three are drawn together, but for the one unit that would
    pass the target: of its rows about the share that fits goes in. Equal statistics go by the unit's
    digest. Empty input gives no rows. Other columns, whatever their names, pass as they are."""
    return _marked(_rows(docs), weights, share, most, seed, slices, id_col, text_col, source_col)


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every document as often as it was taken, in the columns of ``docs``."""
    many = mix(docs, **how).where("_mix.copies > 0")
    return many.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix.copies")))).select("_row.*")


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    m = mix(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return m.select("_row.doc_id", "_mix.size", "_mix.source_size", "_mix.target",
                    (F.col("_mix.size") * F.col("_mix.copies")).alias("taken"))


def _sql() -> str:
    weights = ", ".join(f"{float(w)}" for w, _ in zip(cycle(WEIGHTS), WEIGHTS))
    return f"""
WITH d AS (
  SELECT source, doc_id, coalesce(len(regexp_extract_all(text, '[^ \\t-\\r]+')), 0)::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) || ':{SEED}') AS unit FROM documents),
s AS (SELECT *, (('0x' || substr(unit, 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM d),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1)::INTEGER AS k FROM s GROUP BY source),
w AS (SELECT *, [{weights}][k % {len(WEIGHTS)} + 1]::DOUBLE AS weight FROM per),
lv AS (
  SELECT *, (sum(source_size) OVER () * {SHARE}::DOUBLE
    - coalesce(sum(source_size) OVER (ORDER BY source_size / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * {MOST}::DOUBLE)
    / sum(weight) OVER (ORDER BY source_size / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (
  SELECT source, source_size, least(source_size * {MOST}::DOUBLE,
    (SELECT arg_min(level, struct_pack(a := source_size / weight, b := k)) FROM lv WHERE level * weight <= source_size * {MOST}::DOUBLE) * weight) AS target FROM lv),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12)::BIGINT ELSE 0 END AS certain FROM t),
m AS (
  SELECT *, CASE WHEN source_size > 0 AND target / source_size - certain > 1e-9 THEN target - certain * source_size ELSE 0 END AS missing FROM p),
h AS (SELECT source, size, count(*)::HUGEINT AS m FROM s WHERE size > 0 GROUP BY source, size),
o AS (
  SELECT h.source, h.size, (m.missing - coalesce(sum(h.m * h.size) OVER (PARTITION BY h.source ORDER BY h.size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / sum(h.m * h.size * h.size) OVER (PARTITION BY h.source ORDER BY h.size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS c
  FROM h JOIN m ON h.source IS NOT DISTINCT FROM m.source),
c AS (SELECT source, arg_max(c, size) AS c FROM o WHERE c * size <= 1 GROUP BY source),
q AS (
  SELECT s.*, m.source_size, m.target, m.certain, m.missing,
    CASE WHEN s.size <= 0 OR coalesce(c.c, 0) <= 0 THEN 1.0 WHEN c.c * s.size >= 1 THEN 0.0
    ELSE (s.u / (1 - s.u)) / ((c.c * s.size) / (1 - c.c * s.size)) END AS q
  FROM s JOIN m ON s.source IS NOT DISTINCT FROM m.source LEFT JOIN c ON s.source IS NOT DISTINCT FROM c.source),
r AS (
  SELECT *, CASE WHEN q.size <= 0 THEN 1.0 ELSE q / (1 + q) END AS t FROM q),
f AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY t, unit) AS upto FROM r WHERE size > 0 AND missing > 0),
g AS (
  SELECT *, upto <= missing AS chosen, missing - coalesce(max(CASE WHEN upto <= missing THEN upto END) OVER (PARTITION BY source), 0) AS gap FROM f),
top AS (
  SELECT source, arg_min(unit, struct_pack(a := abs(size - gap), b := t, c := unit)) AS unit_top FROM g
  WHERE NOT chosen AND round(gap / size) >= 1 AND abs(size - gap) < gap GROUP BY source)
SELECT r.doc_id, r.size, r.source_size, r.target,
  r.size * (r.certain + CASE WHEN g.chosen OR coalesce(g.unit = top.unit_top, false) THEN 1 ELSE 0 END) AS taken
FROM r LEFT JOIN g ON g.unit = r.unit AND g.source IS NOT DISTINCT FROM r.source LEFT JOIN top ON r.source IS NOT DISTINCT FROM top.source"""


QUERIES = {"op1_pareto_mix": op1_pareto_mix}
SQL = {"op1_pareto_mix": _sql()}
