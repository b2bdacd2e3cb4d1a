"""Column profiles of large tables: null rates, distinct counts, ranges, quantiles, patterns, distances between loads.

Values are unpivoted and counted per (load, column, value) with map-side combining, so a value that a third of
all rows share is one row. The counted values are range-sorted by load and column; each partition keeps running
counts of its segments, and a prefix sum over the partitions turns them into exact ranks, quantiles and distinct
counts. For two loads the merged cumulative curves, kept per segment as largest and smallest difference, give
the exact Kolmogorov-Smirnov distance.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstream.functions.text import category, number, token_class
from siltstream.session import materialise, shuffle_partitions, sized

MEASURES = ["flow_duration", "flow_byts_s", "flow_pkts_s"]
DURATION_LIMIT = 120_000_000
QUANTILES = [0.01, 0.25, 0.5, 0.75, 0.99]


def token_counts(flows: DataFrame, columns: list[str]) -> DataFrame:
    """Per load (source_file) and text measure: rows and the count of each class of token, numbers below 0 and
    above the duration limit, least and greatest number; with the file's first day where there is a file_date. One
    aggregation, no unpivot. Empty in, empty out."""
    others = [F.min("file_date").alias("day")] if "file_date" in flows.columns else []
    typed = flows.select("source_file", *[F.col("file_date") for _ in others], *[f for c in columns for f in (token_class(F.col(c)).alias(f"{c}.k"), number(F.col(c)).alias(f"{c}.v"))])
    made = []
    for c in columns:
        kind, value = F.col(f"`{c}.k`"), F.col(f"`{c}.v`")
        many = lambda name: F.count(F.when(kind == name, 1))  # noqa: B023, E731
        made.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.count(F.lit(1)).alias("n_rows"),
                many("missing").alias("n_missing"),
                many("null_marker").alias("n_null_marker"),
                many("nan").alias("n_nan"),
                many("infinite").alias("n_infinite"),
                many("other").alias("n_other"),
                F.count(value).alias("n_number"),
                F.count(F.when(value < 0, 1)).alias("n_negative"),
                F.count(F.when(value > DURATION_LIMIT, 1)).alias("n_above_limit"),
                F.min(value).alias("least"),
                F.max(value).alias("greatest"),
            ).alias(c)
        )
    return typed.groupBy("source_file").agg(*made, *others).select("source_file", *[c for c in ("day",) if others], F.inline(F.array(*[f"`{c}`" for c in columns])))


def _running(kind: pa.DataType):
    """Running count within each segment, a run of equal groups, of a sorted partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, total = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column("gid").to_numpy(zero_copy_only=False)
            n = batch.column("n").to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            sums = np.cumsum(n)
            base = np.repeat(np.r_[0, sums[starts[1:] - 1]] if len(starts) > 1 else np.zeros(1, np.int64), np.diff(np.r_[starts, len(g)]))
            upto = sums - base
            if group is not None and g[0] == group:
                upto[: starts[1] if len(starts) > 1 else len(g)] += total
            group, total = g[-1], int(upto[-1])
            yield pa.RecordBatch.from_arrays([batch.column("pid"), batch.column("gid"), batch.column("v"), batch.column("n"), pa.array(upto, pa.int64())], ["pid", "gid", "v", "n", "upto"])

    return run


def range_sorted(values: DataFrame, partitions: int | None = None) -> DataFrame:
    """(gid, v) rows counted, range-sorted by both and written to the shared folder as (pid, gid, v, n, upto).

    upto counts a gid's rows in the same partition up to and with v. Rows with a null v are left out.
    """
    kind = values.schema["v"].dataType
    counted = values.where("v is not null").groupBy("gid", "v").agg(F.count(F.lit(1)).alias("n"))
    parts = partitions or shuffle_partitions(values.sparkSession)
    ordered = counted.repartitionByRange(parts, "gid", "v").sortWithinPartitions("gid", "v").withColumn("pid", F.spark_partition_id())
    made = ordered.mapInArrow(_running(kind), f"pid int, gid bigint, v {kind.simpleString()}, n bigint, upto bigint")
    return materialise(made, "range-sorted")


def segments(ordered: DataFrame) -> DataFrame:
    """(pid, gid, m, d, low, high, offset, total): each partition's part of a gid, the gid's rows in earlier
    partitions and in all. At most one row per gid and one more per partition; written to the shared folder."""
    parts = ordered.groupBy("pid", "gid").agg(F.max("upto").alias("m"), F.count(F.lit(1)).alias("d"), F.min("v").alias("low"), F.max("v").alias("high"))
    before = Window.partitionBy("gid").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    return materialise(parts.withColumn("offset", F.coalesce(F.sum("m").over(before), F.lit(0))).withColumn("total", F.sum("m").over(Window.partitionBy("gid"))), "segments")


def quantiles(ordered: DataFrame, parts: DataFrame, shares: list[float]) -> DataFrame:
    """(gid, q, value): exact quantiles, linear between the two nearest ranks; text takes the lower rank."""
    at = F.col("q") * (F.col("total") - 1)
    wanted = parts.select("pid", "gid", "offset", "m", "total", F.explode(F.array(*map(F.lit, shares))).alias("q"))
    wanted = wanted.withColumn("at", at).withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))))
    wanted = wanted.where((F.col("rank") >= F.col("offset")) & (F.col("rank") < F.col("offset") + F.col("m")))
    wanted = wanted.select("pid", "gid", "q", "at", "rank", (F.col("rank") - F.col("offset")).alias("local"))
    found = ordered.join(sized(wanted), ["pid", "gid"]).where((F.col("local") < F.col("upto")) & (F.col("local") >= F.col("upto") - F.col("n")))
    if dict(ordered.dtypes)["v"] == "string":
        return found.groupBy("gid", "q").agg(F.min("v").alias("value"))
    share = F.max("at") - F.floor(F.max("at"))
    if dict(ordered.dtypes)["v"] == "bigint":  # as text, so that whole numbers beyond 2^53 stay whole
        return found.groupBy("gid", "q").agg(F.when(share == 0, F.min("v").cast("string")).otherwise((F.min("v") + (F.max("v") - F.min("v")) * share).cast("string")).alias("value"))
    return found.groupBy("gid", "q").agg((F.min("v") + (F.max("v") - F.min("v")) * share).alias("value"))


def _groups(flows: DataFrame, columns: list[str], pick) -> tuple[DataFrame, Column]:
    gid = lambda c: F.xxhash64("source_file", F.lit(c))
    rows = F.array(*[F.struct(gid(c).alias("gid"), pick(c).alias("v")) for c in columns])
    return flows.select(F.inline(rows))


def group_names(flows: DataFrame, columns: list[str]) -> DataFrame:
    """(gid, source_file, column_name). Groups travel as 64-bit hashes; two that meet raise an error."""
    files = flows.groupBy("source_file").agg(F.count(F.lit(1)).alias("n_rows"))
    named = files.select("source_file", "n_rows", F.explode(F.array(*map(F.lit, columns))).alias("column_name"))
    named = named.withColumn("gid", F.xxhash64("source_file", F.col("column_name")))
    met = F.count(F.lit(1)).over(Window.partitionBy("gid")) > 1
    return named.withColumn("gid", F.when(met, F.raise_error(F.lit("two groups share a hash"))).otherwise(F.col("gid")))


def _measures(flows: DataFrame, columns: list[str] = MEASURES, shares: list[float] = QUANTILES) -> DataFrame:
    counts = token_counts(flows, columns)
    ordered = range_sorted(_groups(flows, columns, lambda c: number(F.col(c))))
    return _with_order(counts.withColumn("gid", F.xxhash64("source_file", "column_name")), ordered, shares)


def measure_profile(flows: DataFrame, columns: list[str] = MEASURES, shares: list[float] = QUANTILES) -> DataFrame:
    """token_counts with n_distinct and the exact quantiles q<percent> of the numbers, per source_file and text
    measure. A group without numbers has 0 distinct values and null quantiles."""
    return _measures(flows, columns, shares).drop("day")


def _with_order(counts: DataFrame, ordered: DataFrame, shares: list[float]) -> DataFrame:
    parts = segments(ordered)
    distinct = parts.groupBy("gid").agg(F.sum("d").alias("n_distinct"))
    found = quantiles(ordered, parts, shares).groupBy("gid")
    wide = found.agg(*[F.max(F.when(F.col("q") == q, F.col("value"))).alias(f"q{round(q * 100):02d}") for q in shares])
    joined = counts.join(distinct, "gid", "left").join(wide, "gid", "left").drop("gid")
    return joined.withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0)))


def file_sites(flows: DataFrame) -> DataFrame:
    """(source_file, earlier): the file of the same site for the day before, by the date and the site in the name."""
    return _earlier(flows.groupBy("source_file").agg(F.min("file_date").alias("day")))


def _earlier(files: DataFrame) -> DataFrame:
    files = files.withColumn("site", F.regexp_extract("source_file", r"(site[0-9]+)", 1))
    earlier = files.select("site", F.date_add("day", 1).alias("day"), F.col("source_file").alias("earlier"))
    return files.join(earlier, ["site", "day"], "left").select("source_file", "earlier")


def doubtful(flows: DataFrame, report: DataFrame, columns: list[str] = MEASURES) -> DataFrame:
    """(source_file, column_name, finding) for the text measures: nan_values and infinite_values where the report
    counts otherwise (a null count is another, an absent report row none), pattern, value_range, and against the
    same site's file of the day before null_rate and shift. A repeated report row counts once."""
    # one row per file and measure, compared with itself
    profile = materialise(_measures(flows, columns, [0.5]), "profile")
    said = report.where("report_scope = 'column'").select(F.col("filename").alias("source_file"), "column_name", F.struct("nan_values", "infinite_values").alias("said"))
    said = said.groupBy("source_file", "column_name").agg(F.collect_set("said").alias("said"))
    absent = (F.col("n_missing") + F.col("n_null_marker")).alias("n_absent")
    now = profile.withColumn("n_absent", absent)
    before = now.select(F.col("source_file").alias("earlier"), "column_name", F.col("n_rows").alias("b_rows"), F.col("n_absent").alias("b_absent"), F.col("q50").alias("b_median"))
    both = now.join(said, ["source_file", "column_name"], "left").join(_earlier(now.groupBy("source_file").agg(F.first("day").alias("day"))), "source_file", "left").join(before, ["earlier", "column_name"], "left")
    other = lambda name, count: F.exists("said", lambda x: ~x[name].eqNullSafe(F.col(count)))
    above = (F.col("column_name") == "flow_duration") & (F.col("n_above_limit") > 0)
    # whole-number form of a/n - b/m >= 0.05
    rate = (F.col("n_absent") * F.col("b_rows") - F.col("b_absent") * F.col("n_rows")) * 20 >= F.col("n_rows") * F.col("b_rows")
    median, old = F.col("q50"), F.col("b_median")
    shift = (median >= 4 * old) | (median * 4 <= old)
    tests = {
        "nan_values": other("nan_values", "n_nan"),
        "infinite_values": other("infinite_values", "n_infinite"),
        "pattern": F.col("n_other") > 0,
        "value_range": (F.col("n_negative") > 0) | above,
        "null_rate": rate,
        "shift": shift,
    }
    found = F.array_compact(F.array(*[F.when(test, name) for name, test in tests.items()]))
    return both.select("source_file", "column_name", F.explode(found).alias("finding"))


WHOLE = ("byte", "short", "integer", "long", "date", "timestamp", "timestamp_ntz")


def _kinds(flows: DataFrame) -> tuple[dict[str, str], list[str], list[str], list[str]]:
    """Type names of the columns, and those that are ordered as whole numbers, as reals and as text."""
    kinds = {f.name: f.dataType.typeName() for f in flows.schema.fields}
    texts = [c for c, k in kinds.items() if k in ("string", "boolean", "binary") and c != "source_file" and c not in MEASURES]
    reals = [c for c, k in kinds.items() if k in ("float", "double") or k.startswith("decimal")] + [c for c in MEASURES if kinds.get(c) == "string"]
    return kinds, [c for c, k in kinds.items() if k in WHOLE], reals, texts


def _whole(kinds: dict[str, str], c: str) -> Column:
    """Whole numbers as they are, days and microseconds of times."""
    if kinds[c] == "date":
        return F.unix_date(F.col(c)).cast("bigint")
    if kinds[c].startswith("timestamp"):
        return F.unix_micros(F.col(c).cast("timestamp"))
    return F.col(c).cast("bigint")


def _real(kinds: dict[str, str], c: str) -> Column:
    return number(F.col(c)) if c in MEASURES and kinds[c] == "string" else F.col(c).cast("double")


def _text(c: str) -> Column:
    return category(F.col(c).cast("string"))


TOKENS = {"n_blank": "missing", "n_nan": "nan", "n_null_marker": "null_marker", "n_infinite": "infinite", "n_other": "other"}


def column_profile(flows: DataFrame) -> DataFrame:
    """Per source_file and column of flows: rows, nulls, tokens, distinct values, least and greatest value, quartiles.

    n_null counts real nulls; n_blank, n_nan, n_null_marker and n_infinite tokens of text and floating columns, n_other
    what is no number in a text measure. Numbers and times are ordered by value, text (after the comparison rule of
    categories) by code units, both given as text. Quartiles of numbers are linear between ranks, else the lower rank.
    A column that is all null has 0 distinct values and null quantiles; nested columns are left out.
    """
    kinds, wholes, reals, texts = _kinds(flows)

    def profile(columns: list[str], pick) -> DataFrame:
        classed = [c for c in columns if kinds[c] in ("string", "float", "double")]
        rows = flows.select("source_file", *[F.col(c).isNull().alias(f"null_{c}") for c in columns], *[token_class(F.col(c).cast("string")).alias(f"class_{c}") for c in classed])

        def tokens(c: str, name: str) -> Column:
            if c not in classed or (name == "n_other" and c not in MEASURES):
                return F.lit(0).cast("bigint").alias(name)
            return F.count_if((F.col(f"class_{c}") == TOKENS[name]) & ~F.col(f"null_{c}")).alias(name)

        nulls = F.array(*[F.struct(F.lit(c).alias("column_name"), F.count_if(F.col(f"null_{c}")).alias("n_null"), *[tokens(c, name) for name in TOKENS]) for c in columns])
        counts = rows.groupBy("source_file").agg(F.count(F.lit(1)).alias("n_rows"), nulls.alias("x")).select("source_file", "n_rows", F.inline("x"))
        ordered = range_sorted(_groups(flows, columns, pick))
        full = _with_order(counts.withColumn("gid", F.xxhash64("source_file", "column_name")), ordered, [0.0, 0.25, 0.5, 0.75, 1.0])
        return full.select("source_file", "column_name", "n_rows", "n_null", *TOKENS, "n_distinct", *[F.col(a).cast("string").alias(b) for a, b in (("q00", "least"), ("q25", "q25"), ("q50", "q50"), ("q75", "q75"), ("q100", "greatest"))])

    made = [profile(columns, pick) for columns, pick in ((wholes, lambda c: _whole(kinds, c)), (reals, lambda c: _real(kinds, c)), (texts, _text)) if columns]
    return functools.reduce(DataFrame.unionByName, made)


def _curve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per segment of a sorted partition: counts of both loads and extremes of the difference of their curves."""
    pid, group, c, p, high, low = 0, None, 0, 0, 0, 0
    out: list[tuple] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        g, nc, np_, tc, tp = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("gid", "c", "p", "tc", "tp"))
        pid = batch.column("pid")[0].as_py()
        edges = np.r_[np.flatnonzero(np.r_[True, g[1:] != g[:-1]]), len(g)]
        for a, b in zip(edges[:-1], edges[1:]):
            if group is not None and g[a] != group:
                out.append((pid, int(group), c, p, high, low))
                c = p = high = low = 0
            group = g[a]
            cc, pp = c + np.cumsum(nc[a:b]), p + np.cumsum(np_[a:b])
            if tc[a] < 2**31 and tp[a] < 2**31:
                gap = cc * tp[a] - pp * tc[a]
            else:
                gap = cc.astype(object) * int(tp[a]) - pp.astype(object) * int(tc[a])
            high, low, c, p = max(high, int(gap.max())), min(low, int(gap.min())), int(cc[-1]), int(pp[-1])
    if group is not None:
        out.append((pid, int(group), c, p, high, low))
    cols = list(zip(*out)) or [[]] * 6
    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(x, pa.int64()) for x in cols[1:4]], *[pa.array([Decimal(y) for y in x], pa.decimal128(38, 0)) for x in cols[4:]]], ["pid", "gid", "c", "p", "high", "low"])


def load_distances(flows: DataFrame) -> DataFrame:
    """(source_file, column_name, earlier, n, n_earlier, ks): the exact two-sample KS distance of each column between a
    file and the same site's file of the day before. Null where a side is empty.

    Numbers (finite ones) and times are ordered by value, text (after the comparison rule of categories) by code units.
    """
    kinds, wholes, reals, texts = _kinds(flows)

    def finite(c: str) -> Column:
        x = _real(kinds, c)
        return F.when(F.abs(x) < float("inf"), x + F.lit(0.0))

    made = [_distances(flows, columns, pick) for columns, pick in ((wholes, lambda c: _whole(kinds, c)), (reals, finite), (texts, _text)) if columns]
    return functools.reduce(DataFrame.unionByName, made)


def _distances(flows: DataFrame, columns: list[str], pick) -> DataFrame:
    pairs = group_names(flows, columns).join(file_sites(flows), "source_file").where("earlier is not null")
    pairs = pairs.select("gid", "source_file", "column_name", "earlier", F.xxhash64("earlier", F.col("column_name")).alias("old_gid"))
    values = _groups(flows, columns, pick).where("v is not null")
    counted = materialise(values.groupBy("gid", "v").agg(F.count(F.lit(1)).alias("n")), "counted")
    totals = counted.groupBy("gid").agg(F.sum("n").alias("n"))
    sides = pairs.join(totals.withColumnRenamed("n", "tc"), "gid", "left").join(totals.select(F.col("gid").alias("old_gid"), F.col("n").alias("tp")), "old_gid", "left")
    sides = sides.withColumn("tc", F.coalesce("tc", F.lit(0))).withColumn("tp", F.coalesce("tp", F.lit(0)))
    roles = sides.select(F.inline(F.array(F.struct(F.col("gid").alias("from_gid"), "gid", "tc", "tp", F.lit(1).alias("is_now")), F.struct(F.col("old_gid").alias("from_gid"), "gid", "tc", "tp", F.lit(0).alias("is_now")))))
    curve = counted.withColumnRenamed("gid", "from_gid").join(sized(roles), "from_gid").select("gid", "v", "tc", "tp", (F.col("n") * F.col("is_now")).alias("c"), (F.col("n") * (1 - F.col("is_now"))).alias("p"))
    curve = curve.groupBy("gid", "v").agg(F.sum("c").alias("c"), F.sum("p").alias("p"), F.first("tc").alias("tc"), F.first("tp").alias("tp"))
    ordered = curve.repartitionByRange(shuffle_partitions(flows.sparkSession), "gid", "v").sortWithinPartitions("gid", "v").withColumn("pid", F.spark_partition_id())
    parts = materialise(ordered.mapInArrow(_curve, "pid int, gid bigint, c bigint, p bigint, high decimal(38,0), low decimal(38,0)"), "curves")
    parts = parts.join(sides.select("gid", "tc", "tp"), "gid")
    before = Window.partitionBy("gid").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    many = lambda c: c.cast("decimal(18,0)")
    # products of counts, exact beyond 2^63
    start = (many(F.coalesce(F.sum("c").over(before), F.lit(0))) * many(F.col("tp")) - many(F.coalesce(F.sum("p").over(before), F.lit(0))) * many(F.col("tc"))).cast("decimal(38,0)")
    most = F.greatest(F.abs(F.col("start") + F.col("high")), F.abs(F.col("start") + F.col("low")))
    peak = parts.withColumn("start", start).groupBy("gid").agg(F.max(most).alias("most"))
    ks = F.when((F.col("tc") > 0) & (F.col("tp") > 0), F.coalesce(F.col("most").cast("double"), F.lit(0.0)) / (F.col("tc").cast("double") * F.col("tp")))
    return sides.join(peak, "gid", "left").select("source_file", "column_name", "earlier", F.col("tc").alias("n"), F.col("tp").alias("n_earlier"), ks.alias("ks"))
