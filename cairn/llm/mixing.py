"""Mixing sources to target weights with a time-varying curriculum. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BUCKET_ROWS, WORD, hash32, null_safe, ranked, small_side, with_place, written

SEED = 29
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
#: Relative weight over training time by weight class: the heaviest sources fade out, the lightest fade in.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sizes`` (__g, __src, source_size) plus ``cls`` and ``target``.

    Sources by code point, null last, take the weights in turn. A target stops at ``most`` times its source's size;
    what is over is shared again by weight until none is above. That fixed point has a closed form: order sources by
    cap over weight; all before the first one that its share does not fill are capped.
    One row per source, so the windows here run over a small table.
    """
    n = len(weights)
    by_name, by_ratio = Window.orderBy(F.col("__src").isNull(), "__src"), Window.orderBy("ratio", "pos")
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    t = sizes.withColumn("pos", F.row_number().over(by_name) - 1).withColumn("cls", (F.col("pos") % n).cast("int"))
    t = t.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("cls") + 1)).withColumn("cap", most * F.col("source_size"))
    t = t.withColumn("ratio", F.col("cap") / F.col("w"))
    t = t.withColumn("level", (share * F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    t = t.withColumn("open", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "pos", "level"))).over(Window.partitionBy()))
    full = F.col("open").isNull() | (F.struct("ratio", "pos") < F.struct("open.ratio", "open.pos"))
    return t.withColumn("target", F.when(full, F.col("cap")).otherwise(F.least(F.col("cap"), F.col("open.level") * F.col("w")))).select("__g", "source_size", "cls", "target")


def _inverse(fraction: Column, schedule: Sequence[tuple[float, float]]) -> Column:
    """The time at which a source with this piecewise linear weight schedule has used ``fraction`` of its demand.

    The integral of a linear piece is quadratic, so its inverse is a square root, taken in the form that also
    holds for a slope of zero. One CASE branch per piece.
    """
    area, parts, out = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:])), [], None
    done = 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        left, slope = fraction * F.lit(area) - F.lit(done), (w1 - w0) / (t1 - t0)
        root = F.lit(w0) + F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + F.lit(2 * slope) * left))
        at = F.lit(t0) + F.when(left > 0, 2 * left / root).otherwise(0.0)
        done += (t1 - t0) * (w0 + w1) / 2
        parts.append((done / area, F.least(F.lit(t1), F.greatest(F.lit(t0), at))))
    for end, at in reversed(parts):
        out = at if out is None else F.when(fraction <= F.lit(end), at).otherwise(out)
    return out


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def plan(
    docs: DataFrame,
    size: Column | None = None,
    weights: Sequence[float] = WEIGHTS,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    share: float = SHARE,
    most: float = MOST,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: Sequence[str] = (),
    rows_per_bucket: int = BUCKET_ROWS,
) -> DataFrame:
    """One row per document: id, ``keep`` columns, size, source_size, target, times, positions.

    Within a source, documents stand in the order of a seeded hash, laid out end to end by size, pass after pass,
    and the mix takes the first ``target`` words of that line; a document on the cut is taken if at least half of
    it lies before, so a source misses its target by half a document at most. A pass at word c of a source's target
    T is trained at the time t in [0, 1] where the integral of the source's weight schedule is c/T of its whole.
    ``positions`` holds those times, one for each of the ``times`` passes, of which there are ``most`` rounded up at most.

    Prefix sums are distributed (see ``ranked``), so a hot source is no single task; only slim rows are ranked, a text
    of any length is read once for its size. The hash takes id and size: rows that share both share a bucket, in
    any order, as their places in the line are alike. Empty and null texts have size 0 and are taken 0 times (they
    would add no words); null sources form the last source; null ids and repeated rows count each; an empty table
    gives an empty table. ``keep`` columns may have any name that is not among the results.
    """
    words = word_count(F.col(text_col)) if size is None else size
    rows = docs.select(*dict.fromkeys([id_col, *keep]), F.col(source_col).alias("__src"), words.alias("size"))
    rows = rows.withColumns({"__k": hash32(seed, F.col(id_col), F.col("size")), "__g": null_safe(F.col("__src"))})
    rows = written(rows, "sized")
    sizes = written(rows.groupBy("__g").agg(F.first("__src").alias("__src"), F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), "sources")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    line = ranked(rows, "__g", "__k", [id_col, "size", *keep], total, "__r", "size", "__before", rows_per_bucket)
    line = line.join(source_targets(sizes.drop("n"), weights, share, most), "__g")
    # whole passes, then the rest of the target as a prefix of the line
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    rest = F.col("target") - F.col("__whole") * F.col("source_size")
    line = line.withColumn("__whole", whole)
    extra = F.when(F.col("__before") + F.col("size") / 2 <= rest, 1).otherwise(0)
    line = line.withColumn("times", F.when(F.col("size") == 0, 0).otherwise(F.col("__whole") + extra).cast("int"))

    def at(k: Column) -> Column:
        part = F.least(F.lit(1.0), (k * F.col("source_size") + F.col("__before") + F.col("size") / 2) / F.col("target"))
        when = None
        for c, s in enumerate(schedules):
            when = F.when(F.col("cls") == c, _inverse(part, s)) if when is None else when.when(F.col("cls") == c, _inverse(part, s))
        return when

    passes = F.when(F.col("times") > 0, F.transform(F.sequence(F.lit(0), F.col("times") - 1), at)).otherwise(F.array().cast("array<double>"))
    return line.withColumn("positions", passes).select(*dict.fromkeys([id_col, *keep]), "size", "source_size", "target", "times", "positions")


def in_order(docs: DataFrame, **params) -> tuple[DataFrame, DataFrame]:
    """(planned, taken): the plan of each row of ``docs`` by its place, and the whole rows of the mix, one per pass, range-sorted
    into training order, with place and ``position``. See ``mix``."""
    placed = with_place(docs, "documents")
    named = {k: params.get(k, d) for k, d in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))}
    slim = placed.select(*[F.col(c).alias(f"__{k}") for k, c in named.items()], "__file", "__at")
    planned = written(plan(slim, keep=["__file", "__at"], **(params | {k: f"__{k}" for k in named})), "planned")
    passes = planned.where("times > 0").select("__file", "__at", "positions")
    taken = placed.join(small_side(passes), ["__file", "__at"]).withColumn("position", F.explode("positions"))
    order = ("position", named["id_col"], "__file", "__at")
    return planned, taken.repartitionByRange(*order).sortWithinPartitions(*order)


def mix(docs: DataFrame, **params) -> DataFrame:
    """The documents of the mix in training order, each as often as it is taken, plus ``position`` in [0, 1].

    Range-sorted by position (ties by id, then by place in the files of ``docs``), so the order of the rows of all files of the
    written result is the training order. Only slim rows are planned; the passes join the whole rows by place, by
    broadcast up to 1 million rows and by a shuffle beyond. A table that is not read from files is written first.
    A column named ``position`` is replaced; other columns keep whatever name they have. See ``plan`` for the rules,
    nulls, empty and repeated rows.
    """
    docs = docs.drop("position")
    return in_order(docs, **params)[1].select(*docs.columns, "position")


def op8_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: what the mix takes of each, and when it is first trained on. Both are read off the rows of the mix:
    ``taken`` counts the words of the texts in it, ``first_at`` is the position of a document's first row in training
    order. See ``plan`` for nulls, empty, very long and repeated rows, ties and empty tables; columns beside doc_id, text
    and source are ignored."""
    planned, taken = in_order(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    # numbered as they come, after the range sort
    rows = taken.select("__file", "__at", "position", word_count(F.col("text")).alias("words"), F.monotonically_increasing_id().alias("__n"))
    of = rows.groupBy("__file", "__at").agg(F.sum("words").alias("taken"), F.min_by("position", "__n").alias("first_at"))
    out = planned.join(of, ["__file", "__at"], "left")
    return out.select(F.col("__id_col").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.round("first_at", 6).alias("first_at"))


ORACLE = r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
       ('0x' || substr(md5('29|' || coalesce(doc_id::VARCHAR, chr(0)) || '|' || size), 1, 8))::BIGINT AS k FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS pos FROM sized GROUP BY source),
w AS (SELECT *, (pos % 3)::INTEGER AS cls, [5.0::DOUBLE, 2.0, 1.0][(pos % 3 + 1)::INTEGER] AS w, 2.0::DOUBLE * source_size AS cap FROM src),
lvl AS (SELECT *, cap / w AS ratio, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
       / sum(w) OVER (ORDER BY cap / w, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
fst AS (SELECT ratio AS r0, pos AS p0, level AS l0 FROM lvl WHERE level <= ratio ORDER BY ratio, pos LIMIT 1),
tgt AS (SELECT source, source_size, cls, CASE WHEN r0 IS NULL OR (ratio, pos) < (r0, p0) THEN cap ELSE least(cap, l0 * w) END AS target FROM lvl LEFT JOIN fst ON true),
line AS (SELECT s.doc_id, s.size, t.source_size, t.cls, t.target,
       (sum(s.size) OVER (PARTITION BY s.source ORDER BY k, s.doc_id NULLS FIRST, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT - s.size AS before_,
       CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole
       FROM sized s JOIN tgt t ON s.source IS NOT DISTINCT FROM t.source),
took AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE whole + CASE WHEN before_ + size / 2.0::DOUBLE <= target - whole * source_size THEN 1 ELSE 0 END END AS times,
       least(1.0::DOUBLE, (before_ + size / 2.0::DOUBLE) / target) AS f FROM line)
SELECT doc_id, size, source_size, target, (size * times)::BIGINT AS taken, CASE WHEN times > 0 THEN round(CASE cls
       WHEN 0 THEN least(1.0, 2 * f / (1.5::DOUBLE + sqrt(greatest(0.0, 2.25::DOUBLE - 2 * f))))
       WHEN 1 THEN least(1.0, 2 * f / (1.0::DOUBLE + sqrt(1.0::DOUBLE)))
       ELSE least(1.0, 2 * f / (0.5::DOUBLE + sqrt(0.25::DOUBLE + 2 * f))) END, 6) END AS first_at FROM took
"""
