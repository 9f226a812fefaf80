"""The registered queries over the star-schema tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.frame import IntervalFrame
from spanmill.functions.combine import PythonCombiner
from spanmill.functions.predicates import to_day_number
from spanmill.operators.box2d import count_2d
from spanmill.sources import bed
from spanmill.sources.workspace import fresh_path
from spanmill.streaming.enrich import enrich, enriched_batches

EPOCH = "1995-01-01"
#: Unique per line: order, line, part and supplier together.
LINE_ID = "(l_orderkey * 10 + l_linenumber) * 10000000000 + l_partkey * 10000 + l_suppkey"


def lines(spark: SparkSession, sf_dir: str, flag: str, key: str = "l_partkey") -> IntervalFrame:
    """Ship day to ship day + quantity - 1 for one return flag; contig ``k``."""
    day = to_day_number("l_shipdate", EPOCH)
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where(F.col("l_returnflag") == flag)
    df = df.select(F.col(key).alias("k"), day.alias("s"), (day + F.col("l_quantity").cast("bigint") - 1).alias("e"), F.expr(LINE_ID).alias("v"))
    return IntervalFrame(df, keys=("k",), start="s", end="e", value="v", ord="v")


def ab(spark, sf_dir, key="l_partkey"):
    return lines(spark, sf_dir, "A", key), lines(spark, sf_dir, "R", key)


def dups(spark, sf_dir):
    f = lines(spark, sf_dir, "A")
    return IntervalFrame(f.df.select("k", F.expr("start div 7").alias("start"), F.expr("start div 7 + 3").alias("end"), "value", "ord"), keys=("k",), ord="ord")


def _base(f: IntervalFrame, found: DataFrame) -> DataFrame:
    return f.df.select("k", F.col("value").alias("qv"), F.col("ord").alias("o")).join(found, F.col("o") == F.col("qid")).drop("o", "qid")


def _kse(df: DataFrame, *more) -> DataFrame:
    return df.select("k", F.col("start").alias("s"), F.col("end").alias("e"), *more)


def _value(df):
    return _kse(df, F.col("value").alias("v"))


def _on(name):
    """f(a, b) with a the probes and b the stored intervals."""
    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(*ab(spark, sf_dir))
        return f
    return register


QUERIES: dict = {}


@_on("search_values")
def _(a, b):
    return b.search_values(a).select("k", F.col("qid").alias("qv"), F.col("value").alias("bv"))


@_on("search_keys")
def _(a, b):
    return b.search_keys(a).select("k", F.col("qid").alias("qv"), F.col("start").alias("bs"), F.col("end").alias("be"))


@_on("search_items")
def _(a, b):
    return b.search_items(a).select("k", F.col("qid").alias("qv"), F.col("start").alias("bs"), F.col("end").alias("be"), F.col("value").alias("bv"))


@_on("search_idxs")
def _(a, b):
    return b.search_idxs(a).select("k", F.col("qid").alias("qv"), "idx")


@_on("search_point")
def _(a, b):
    return b.search_point(a).select("k", F.col("qid").alias("qv"), F.col("value").alias("bv"))


@_on("count_point")
def _(a, b):
    return b.count_point(a).select(F.col("qid").alias("qv"), "n")


@_on("search_idxs_batch")
def _(a, b):
    return b.search_idxs_batch(a).select(F.col("qid").alias("qv"), F.concat_ws(",", F.col("idxs").cast("array<string>")).alias("idxs"))


@_on("search_values_batch")
def _(a, b):
    return b.search_values_batch(a).select(F.col("qid").alias("qv"), F.concat_ws(",", F.col("values").cast("array<string>")).alias("bvs"))


@_on("has_overlaps")
def _(a, b):
    return b.has_overlaps(a).select(F.col("qid").alias("qv"), F.col("hit").cast("int").alias("hit"))


@_on("with_overlaps")
def _(a, b):
    return _value(b.with_overlaps(a))


@_on("no_overlaps")
def _(a, b):
    return _value(b.without_overlaps(a))


@_on("upper_bound")
def _(a, b):
    return b.upper_bound(a).select(F.col("qid").alias("qv"), "idx")


@_on("count_batch")
def _(a, b):
    return b.count(a).select(F.col("qid").alias("qv"), "n")


@_on("coverage")
def _(a, b):
    return b.coverage(a).select(F.col("qid").alias("qv"), "n", "covered")


@_on("span")
def _(a, b):
    return _kse(a.span())


@_on("merge_overlaps")
def _(a, b):
    return _kse(a.merge_overlaps(), F.col("value").alias("v"), "n")


@_on("merge_sum")
def _(a, b):
    return _value(a.merge_overlaps("sum"))


@_on("merge_collect")
def _(a, b):
    return _kse(a.merge_overlaps("collect"), F.concat_ws(",", F.col("value").cast("array<string>")).alias("vs"))


@_on("union_with")
def _(a, b):
    return _value(a.union_with(b, "max"))


@_on("gaps")
def _(a, b):
    bounds = a.df.select("k").union(b.df.select("k")).distinct().select("k", F.lit(0).alias("lo"), F.lit(2600).alias("hi"))
    return _kse(a.gaps(bounds=bounds))


@_on("intersection")
def _(a, b):
    return _kse(a.intersection(b, "collect"), F.col("value.a").alias("av"), F.col("value.b").alias("bv"))


@_on("difference")
def _(a, b):
    return _value(a.difference(b))


@_on("symmetric_difference")
def _(a, b):
    return _kse(a.symmetric_difference(b))


@_on("expand")
def _(a, b):
    return _value(a.expand(5, -2, 0, 2500))


@_on("flank")
def _(a, b):
    return _value(a.flank(5, 3, 0, 2500))


@_on("at_index")
def _(a, b):
    return _value(a.with_index().where("idx = 3"))


@_on("build_order")
def _(a, b):
    return _kse(a.build().with_index(), F.col("value").alias("v"), "idx")


@_on("size")
def _(a, b):
    return a.df.agg(F.count("*").alias("n"))


def _dense(f):
    return lambda spark, sf_dir: f(*ab(spark, sf_dir, "l_suppkey"))


QUERIES["total_overlaps"] = _dense(lambda a, b: b.total_overlaps(a))
QUERIES["count"] = _dense(lambda a, b: b.count(a, "sweep").select(F.col("qid").alias("qv"), "n"))
QUERIES["unique"] = lambda s, d: _kse(dups(s, d).unique(), F.col("value").alias("v"), "n")
QUERIES["unique_sum"] = lambda s, d: _value(dups(s, d).unique("sum"))


def _count_2d(spark, sf_dir):
    day = to_day_number("l_shipdate", EPOCH).cast("double")
    box = lambda f: spark.read.parquet(f"{sf_dir}/lineitem.parquet").where(F.col("l_returnflag") == f).select(
        F.expr(LINE_ID).alias("qid"), day.alias("x0"), (day + F.col("l_quantity")).alias("x1"), F.col("l_partkey").cast("double").alias("y0"), (F.col("l_partkey") + 3).cast("double").alias("y1")
    )
    return count_2d(box("R"), box("A")).select(F.col("qid").alias("qv"), "n")


QUERIES["count_2d"] = _count_2d


def _nations(spark, sf_dir):
    """The 25 nations as intervals by number and region, added from arrays."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey", "n_name").orderBy("n_nationkey").collect()
    return IntervalFrame.from_arrays(spark, [r[0] for r in rows], [r[0] + r[1] for r in rows], [r[2] for r in rows])


def _from_arrays(spark, sf_dir):
    probes = IntervalFrame.from_arrays(spark, range(0, 25, 5), range(2, 27, 5))
    return _nations(spark, sf_dir).search_values(probes).select("qid", F.col("value").alias("v"))


def _add(spark, sf_dir):
    frame = _nations(spark, sf_dir).add(3, 9, "one more")
    return frame.df.select(F.col("start").alias("s"), F.col("end").alias("e"), F.col("value").alias("v"))


QUERIES["from_arrays"] = _from_arrays
QUERIES["add"] = _add
QUERIES["clear"] = lambda s, d: _nations(s, d).clear().df.agg(F.count("*").alias("n"))


def _frames_by(columns):
    """Frames of the flag A and R lines by other columns: (spark, sf_dir) -> (a, b)."""
    def of(spark, sf_dir):
        df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        k, s, e = columns
        sides = [df.where(F.col("l_returnflag") == f).select(*([F.expr(k).alias("k")] if k else []), F.expr(s).alias("s"), F.expr(e).alias("e"), F.expr(LINE_ID).alias("v")) for f in "AR"]
        return [IntervalFrame(x, keys=("k",) if k else (), start="s", end="e", value="v", ord="v") for x in sides]
    return of


#: Keyless, over order numbers; keyless, over prices; keys that are NULL for every seventh part; nine tenths of all lines under one key.
_keyless = _frames_by((None, "l_orderkey", "l_orderkey + CAST(l_quantity AS BIGINT) div 4"))
_prices = _frames_by((None, "l_extendedprice", "l_extendedprice + l_quantity / 4"))
_null_keys = _frames_by(("CASE WHEN l_partkey % 7 <> 0 THEN l_partkey END", "datediff(l_shipdate, DATE '1995-01-01')", "datediff(l_shipdate, DATE '1995-01-01') + CAST(l_quantity AS BIGINT) - 1"))
_skewed = _frames_by(("CASE WHEN l_partkey % 10 = 0 THEN l_partkey ELSE -1 END", "l_orderkey", "l_orderkey + CAST(l_quantity AS BIGINT) div 4"))


def _with(frames, f):
    return lambda spark, sf_dir: f(*frames(spark, sf_dir))


def _counted(df):
    return df.select(F.col("qid").alias("qv"), "n")


def _hits(df):
    return df.select(F.col("qid").alias("qv"), F.col("hit").cast("int").alias("hit"))


def _found(df):
    return df.select(F.col("qid").alias("qv"), F.col("value").alias("bv"))


def _se(df, *more):
    return df.select(F.col("start").alias("s"), F.col("end").alias("e"), *more)


QUERIES["search_values_keyless"] = _with(_keyless, lambda a, b: _found(b.search_values(a)))
QUERIES["count_keyless"] = _with(_keyless, lambda a, b: _counted(b.count(a, "binned")))
QUERIES["with_overlaps_keyless"] = _with(_keyless, lambda a, b: _se(b.with_overlaps(a), F.col("value").alias("v")))
QUERIES["no_overlaps_keyless"] = _with(_keyless, lambda a, b: _se(b.without_overlaps(a), F.col("value").alias("v")))
QUERIES["merge_keyless"] = _with(_keyless, lambda a, b: _se(a.merge_overlaps("count"), F.col("value").alias("c"), "n"))
QUERIES["difference_keyless"] = _with(_keyless, lambda a, b: _se(a.difference(b), F.col("value").alias("v")))
QUERIES["search_values_doubles"] = _with(_prices, lambda a, b: _found(b.search_values(a)))
QUERIES["count_doubles"] = _with(_prices, lambda a, b: _counted(b.count(a, "sweep")))
QUERIES["merge_doubles"] = _with(_prices, lambda a, b: _se(a.merge_overlaps("min"), F.col("value").alias("v")))
for _how in ("equi", "binned", "sweep"):
    QUERIES[f"count_null_keys_{_how}"] = _with(_null_keys, lambda a, b, how=_how: _counted(b.count(a, how)))
    QUERIES[f"has_overlaps_null_keys_{_how}"] = _with(_null_keys, lambda a, b, how=_how: _hits(b.has_overlaps(a, how)))
QUERIES["no_overlaps_null_keys"] = _with(_null_keys, lambda a, b: _value(b.without_overlaps(a)))
QUERIES["upper_bound_null_keys"] = _with(_null_keys, lambda a, b: b.upper_bound(a).select(F.col("qid").alias("qv"), "idx"))
QUERIES["count_skewed"] = _with(_skewed, lambda a, b: _counted(b.count(a)))
QUERIES["search_idxs_skewed"] = _with(_skewed, lambda a, b: b.search_idxs(a).select("k", F.col("qid").alias("qv"), "idx"))


@_on("merge_last")
def _(a, b):
    return _value(a.merge_overlaps("last"))


@_on("merge_min")
def _(a, b):
    return _value(a.merge_overlaps("min"))


@_on("merge_lambda")
def _(a, b):
    return _value(a.merge_overlaps(lambda acc, x: acc + 2 * x))


@_on("merge_python")
def _(a, b):
    return _value(a.merge_overlaps(PythonCombiner(lambda acc, x: (acc * 31 + x) % 1_000_003, "bigint")))


@_on("merge_index_order")
def _(a, b):
    return _kse(a.merge_overlaps("collect", fold_order="index"), F.concat_ws(",", F.col("value").cast("array<string>")).alias("vs"))


@_on("coverage_inclusive")
def _(a, b):
    return b.coverage(a, inclusive=True).select(F.col("qid").alias("qv"), "n", "covered")


@_on("symmetric_difference_sum")
def _(a, b):
    return _value(a.symmetric_difference(b, "sum"))


def _round_trip(spark, sf_dir):
    """Saved and loaded again."""
    path = fresh_path(spark, "saved")
    lines(spark, sf_dir, "A").save(path)
    return _value(bed.load(spark, path, keys=("k",)).df)


QUERIES["save_load"] = _round_trip


def _bed(spark, sf_dir, flag, **options):
    """The lines of one flag, written as half-open BED text and read back."""
    path = fresh_path(spark, "bed")
    bed.write_bed(lines(spark, sf_dir, flag).df.select(F.concat(F.lit("p"), F.col("k")).alias("contig"), "start", "end"), path)
    return bed.read_bed(spark, path, **options)


def _bed_swapped(spark, sf_dir):
    """BED text whose lines of odd starts have their ends swapped, for some contigs only."""
    path = fresh_path(spark, "bed")
    df = lines(spark, sf_dir, "A").df
    odd = F.col("start") % 2 == 1
    bed.write_bed(df.select(F.concat(F.lit("p"), F.col("k") % 10).alias("contig"), F.when(odd, F.col("end")).otherwise(F.col("start")).alias("start"), F.when(odd, F.col("start")).otherwise(F.col("end")).alias("end")), path, half_open=False)
    return bed.read_bed(spark, path, half_open=False, contigs=["p3", "p7"], on_inverted="swap")


def _report(spark, sf_dir):
    """The coverage report as it is read back from the text that the sink wrote."""
    path = fresh_path(spark, "report")
    bed.write_report(bed.coverage_report(_bed(spark, sf_dir, "R"), _bed(spark, sf_dir, "A")), path)
    return spark.read.option("sep", "\t").schema("contig string, s bigint, e bigint, n bigint, covered bigint").csv(path)


_cse = lambda f: f.df.select("contig", F.col("start").alias("s"), F.col("end").alias("e"))
QUERIES["bed_scan"] = lambda s, d: _cse(_bed(s, d, "A"))
QUERIES["bed_raw"] = lambda s, d: _cse(_bed(s, d, "A", half_open=False))
QUERIES["bed_swapped"] = lambda s, d: _cse(_bed_swapped(s, d))
QUERIES["bed_coverage"] = lambda s, d: bed.coverage_report(_bed(s, d, "R"), _bed(s, d, "A")).select("contig", F.col("start").alias("s"), F.col("end").alias("e"), "n", "covered")
QUERIES["report_sink"] = _report

_EVENT = "timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)"


def _streamed(spark, sf_dir, run):
    """Events as a stream against the ranges of the purchases of the same user, through a file sink."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stored = events.where("event_type = 'purchase'").select(F.col("user_id").alias("k"), F.expr(f"{_EVENT} - 3600").alias("start"), F.expr(f"{_EVENT} + CAST(floor(value * 60) AS BIGINT)").alias("end"), F.col("event_id").alias("value"), F.col("event_id").alias("ord"))
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).select("event_id", "user_id", F.expr(_EVENT).alias("s"), F.expr(_EVENT).alias("e"))
    out = fresh_path(spark, "enriched")
    writer = run(stream, IntervalFrame(stored, keys=("k",), ord="ord"), out)
    query = writer.trigger(availableNow=True).option("checkpointLocation", fresh_path(spark, "stream")).start()
    query.awaitTermination()
    return spark.read.parquet(out).select(F.col("event_id").alias("qv"), F.col("b_value").alias("bv"))


QUERIES["stream_enrich"] = lambda s, d: _streamed(s, d, lambda x, b, out: enrich(x, b, "s", "e", {"user_id": "k"}).select("event_id", "b_value").writeStream.format("parquet").option("path", out))
QUERIES["stream_enrich_left"] = lambda s, d: _streamed(s, d, lambda x, b, out: x.writeStream.foreachBatch(enriched_batches(b, "s", "e", lambda df, n: df.select("event_id", "b_value").write.mode("append").parquet(out), {"user_id": "k"})))

# SQL ------------------------------------------------------------------------------


def _views(key="l_partkey") -> str:
    one = lambda f: (
        f"SELECT {key} k, date_diff('day', DATE '{EPOCH}', CAST(l_shipdate AS DATE)) s, date_diff('day', DATE '{EPOCH}', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS BIGINT) - 1 e, "
        f"{LINE_ID} v FROM lineitem WHERE l_returnflag = '{f}'"
    )
    return f"WITH a AS ({one('A')}), b AS ({one('R')})"


_TH = "a.k = b.k AND b.s <= a.e AND a.s <= b.e"
_BI = "(SELECT *, CAST(row_number() OVER (PARTITION BY k ORDER BY s, e DESC, v) - 1 AS BIGINT) idx FROM b)"
_NB = "x.k, x.s, x.e, x.v"


def _islands(src: str, p: str = "") -> str:
    return (
        f"{p}x AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e, v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) pm FROM {src}), "
        f"{p}y AS (SELECT *, sum(CASE WHEN pm IS NULL OR s > pm THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e, v ROWS UNBOUNDED PRECEDING) g FROM {p}x)"
    )


def _difference(a: str, b: str, p: str) -> str:
    return (
        f"{p}p AS (SELECT a.k, a.s, a.e, a.v, CASE WHEN b.s IS NOT NULL THEN greatest(a.s, b.s) END cs, CASE WHEN b.s IS NOT NULL THEN least(a.e, b.e) END ce FROM {a} a LEFT JOIN {b} b ON {_TH}), "
        f"{p}w AS (SELECT *, max(ce) OVER (PARTITION BY k, s, e, v ORDER BY cs, ce ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) pe FROM {p}p), "
        f"{p}d AS (SELECT k, coalesce(pe + 1, s) s, cs - 1 e, v FROM {p}w WHERE cs IS NOT NULL AND cs > coalesce(pe + 1, s) UNION ALL "
        f"SELECT k, coalesce(max(ce) + 1, s), e, v FROM {p}p GROUP BY k, s, e, v HAVING coalesce(max(ce) + 1, s) <= e)"
    )


_V = _views()
_COUNT = "SELECT a.v qv, count(b.s) n FROM a LEFT JOIN b ON {} GROUP BY a.v"
_DUPS = f"{_V}, d AS (SELECT k, s // 7 s, s // 7 + 3 e, v FROM a)"
_BOX = "date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE))"
ORACLE: dict[str, str] = {
    "search_values": f"{_V} SELECT a.k, a.v qv, b.v bv FROM a JOIN b ON {_TH}",
    "search_keys": f"{_V} SELECT a.k, a.v qv, b.s bs, b.e be FROM a JOIN b ON {_TH}",
    "search_items": f"{_V} SELECT a.k, a.v qv, b.s bs, b.e be, b.v bv FROM a JOIN b ON {_TH}",
    "search_idxs": f"{_V} SELECT a.k, a.v qv, b.idx FROM a JOIN {_BI} b ON {_TH}",
    "search_point": f"{_V} SELECT a.k, a.v qv, b.v bv FROM a JOIN b ON a.k = b.k AND b.s <= a.s AND a.s <= b.e",
    "count_point": f"{_V} " + _COUNT.format("a.k = b.k AND b.s <= a.s AND a.s <= b.e"),
    "search_idxs_batch": f"{_V} SELECT a.v qv, coalesce(string_agg(CAST(b.idx AS VARCHAR), ',' ORDER BY b.idx DESC), '') idxs FROM a LEFT JOIN {_BI} b ON {_TH} GROUP BY a.v",
    "search_values_batch": f"{_V} SELECT a.v qv, coalesce(string_agg(CAST(b.v AS VARCHAR), ',' ORDER BY b.idx DESC), '') bvs FROM a LEFT JOIN {_BI} b ON {_TH} GROUP BY a.v",
    "has_overlaps": f"{_V} SELECT a.v qv, CAST(EXISTS (SELECT 1 FROM b WHERE {_TH}) AS INTEGER) hit FROM a",
    "with_overlaps": f"{_V} SELECT k, s, e, v FROM a WHERE EXISTS (SELECT 1 FROM b WHERE {_TH})",
    "no_overlaps": f"{_V} SELECT k, s, e, v FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE {_TH})",
    "upper_bound": f"{_V} SELECT a.v qv, max(b.idx) idx FROM a LEFT JOIN {_BI} b ON a.k = b.k AND b.s <= a.s GROUP BY a.v",
    "count_batch": f"{_V} " + _COUNT.format(_TH),
    "coverage": f"{_V} SELECT a.v qv, count(b.s) n, CAST(coalesce(sum(CASE WHEN b.s IS NOT NULL THEN least(a.e, b.e) - greatest(a.s, b.s) END), 0) AS BIGINT) covered FROM a LEFT JOIN b ON {_TH} GROUP BY a.v",
    "span": f"{_V} SELECT k, min(s) s, max(e) e FROM a GROUP BY k",
    "merge_overlaps": f"{_V}, {_islands('a')} SELECT k, min(s) s, max(e) e, arg_min(v, (s, e, v)) v, count(*) n FROM y GROUP BY k, g",
    "merge_sum": f"{_V}, {_islands('a')} SELECT k, min(s) s, max(e) e, CAST(sum(v) AS BIGINT) v FROM y GROUP BY k, g",
    "merge_collect": f"{_V}, {_islands('a')} SELECT k, min(s) s, max(e) e, string_agg(CAST(v AS VARCHAR), ',' ORDER BY s, e, v) vs FROM y GROUP BY k, g",
    "union_with": f"{_V}, t AS (SELECT * FROM a UNION ALL SELECT * FROM b), {_islands('t')} SELECT k, min(s) s, max(e) e, max(v) v FROM y GROUP BY k, g",
    "gaps": f"{_V}, {_islands('a')}, m AS (SELECT k, min(s) s, max(e) e FROM y GROUP BY k, g), bd AS (SELECT DISTINCT k, 0 lo, 2600 hi FROM (SELECT k FROM a UNION ALL SELECT k FROM b)), "
    "mm AS (SELECT m.k, m.s, m.e, bd.lo, bd.hi, lag(m.e) OVER (PARTITION BY m.k ORDER BY m.s) pe FROM m JOIN bd ON m.k = bd.k WHERE m.e >= bd.lo AND m.s <= bd.hi) "
    "SELECT k, CAST(coalesce(greatest(pe + 1, lo), lo) AS BIGINT) s, CAST(s - 1 AS BIGINT) e FROM mm WHERE s > coalesce(greatest(pe + 1, lo), lo) UNION ALL "
    "SELECT bd.k, CAST(coalesce(max(mm.e) + 1, bd.lo) AS BIGINT), CAST(bd.hi AS BIGINT) FROM bd LEFT JOIN mm ON bd.k = mm.k GROUP BY bd.k, bd.lo, bd.hi HAVING coalesce(max(mm.e) + 1, bd.lo) <= bd.hi",
    "intersection": f"{_V} SELECT a.k, greatest(a.s, b.s) s, least(a.e, b.e) e, a.v av, b.v bv FROM a JOIN b ON {_TH}",
    "difference": f"{_V}, {_difference('a', 'b', 'f')} SELECT k, s, e, v FROM fd",
    "symmetric_difference": f"{_V}, {_difference('a', 'b', 'f')}, {_difference('b', 'a', 'h')}, t AS (SELECT * FROM fd UNION ALL SELECT * FROM hd), {_islands('t')} SELECT k, min(s) s, max(e) e FROM y GROUP BY k, g",
    "expand": f"{_V} SELECT k, greatest(s - 5, 0) s, least(e - 2, 2500) e, v FROM a WHERE greatest(s - 5, 0) <= least(e - 2, 2500)",
    "flank": f"{_V} SELECT k, greatest(s - 5, 0) s, s - 1 e, v FROM a WHERE s > 0 AND s - 1 <= 2500 UNION ALL SELECT k, e + 1, least(e + 3, 2500), v FROM a WHERE e < 2500 AND e + 1 >= 0",
    "at_index": f"{_V} SELECT k, s, e, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s, e DESC, v) - 1 i FROM a) WHERE i = 3",
    "build_order": f"{_V} SELECT k, s, e, v, CAST(row_number() OVER (PARTITION BY k ORDER BY s, e DESC, v) - 1 AS BIGINT) idx FROM a",
    "size": f"{_V} SELECT count(*) n FROM a",
    "total_overlaps": f"{_views('l_suppkey')} SELECT count(*) n FROM a JOIN b ON {_TH}",
    "count": f"{_views('l_suppkey')} " + _COUNT.format(_TH),
    "unique": f"{_DUPS} SELECT k, s, e, min(v) v, count(*) n FROM d GROUP BY k, s, e",
    "unique_sum": f"{_DUPS} SELECT k, s, e, CAST(sum(v) AS BIGINT) v FROM d GROUP BY k, s, e",
    "count_2d": f"WITH t AS (SELECT l_returnflag f, {LINE_ID} v, {_BOX} x0, {_BOX} + l_quantity x1, l_partkey y0, l_partkey + 3 y1 FROM lineitem) "
    "SELECT q.v qv, count(b.v) n FROM (SELECT * FROM t WHERE f = 'A') q LEFT JOIN (SELECT * FROM t WHERE f = 'R') b ON b.x0 <= q.x1 AND q.x0 <= b.x1 AND b.y0 <= q.y1 AND q.y0 <= b.y1 GROUP BY q.v",
    "from_arrays": "SELECT CAST(q.i AS BIGINT) qid, n_name v FROM range(5) q(i) JOIN nation ON n_nationkey <= q.i * 5 + 2 AND q.i * 5 <= n_nationkey + n_regionkey",
    "add": "SELECT n_nationkey s, n_nationkey + n_regionkey e, n_name v FROM nation UNION ALL SELECT 3, 9, 'one more'",
    "clear": "SELECT CAST(0 AS BIGINT) n",
    "bed_scan": f"{_V} SELECT 'p' || k contig, s, e FROM a WHERE e >= 0",
    "bed_coverage": f"{_V} SELECT 'p' || a.k contig, a.s, a.e, count(b.s) n, CAST(coalesce(sum(CASE WHEN b.s IS NOT NULL THEN least(a.e, b.e) - greatest(a.s, b.s) END), 0) AS BIGINT) covered FROM a LEFT JOIN b ON {_TH} GROUP BY a.k, a.s, a.e, a.v",
}


def _views_by(k: str | None, s: str, e: str) -> str:
    one = lambda f: f"SELECT {k + ' k, ' if k else ''}{s} s, {e} e, {LINE_ID} v FROM lineitem WHERE l_returnflag = '{f}'"
    return f"WITH a AS ({one('A')}), b AS ({one('R')})"


_ORDERS = ("l_orderkey", "l_orderkey + CAST(l_quantity AS BIGINT) // 4")
_VK = _views_by(None, *_ORDERS)
_VP = _views_by(None, "l_extendedprice", "l_extendedprice + l_quantity / 4")
_VN = _views_by("CASE WHEN l_partkey % 7 <> 0 THEN l_partkey END", _BOX, f"{_BOX} + CAST(l_quantity AS BIGINT) - 1")
_VS = _views_by("CASE WHEN l_partkey % 10 = 0 THEN l_partkey ELSE -1 END", *_ORDERS)
_TK = "b.s <= a.e AND a.s <= b.e"


def _keyless_sql(sql: str) -> str:
    return sql.replace("PARTITION BY k ", "").replace("PARTITION BY k, s, e, v", "PARTITION BY s, e, v").replace("a.k, ", "").replace("a.k = b.k AND ", "").replace("k, ", "")


ORACLE |= {
    "search_values_keyless": f"{_VK} SELECT a.v qv, b.v bv FROM a JOIN b ON {_TK}",
    "count_keyless": f"{_VK} " + _COUNT.format(_TK),
    "with_overlaps_keyless": f"{_VK} SELECT s, e, v FROM a WHERE EXISTS (SELECT 1 FROM b WHERE {_TK})",
    "no_overlaps_keyless": f"{_VK} SELECT s, e, v FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE {_TK})",
    "merge_keyless": f"{_VK}, {_keyless_sql(_islands('a'))} SELECT min(s) s, max(e) e, count(v) c, count(*) n FROM y GROUP BY g",
    "difference_keyless": f"{_VK}, {_keyless_sql(_difference('a', 'b', 'f'))} SELECT s, e, v FROM fd",
    "search_values_doubles": f"{_VP} SELECT a.v qv, b.v bv FROM a JOIN b ON {_TK}",
    "count_doubles": f"{_VP} " + _COUNT.format(_TK),
    "merge_doubles": f"{_VP}, {_keyless_sql(_islands('a'))} SELECT min(s) s, max(e) e, min(v) v FROM y GROUP BY g",
    "no_overlaps_null_keys": f"{_VN} SELECT k, s, e, v FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE {_TH})",
    "upper_bound_null_keys": f"{_VN} SELECT a.v qv, max(b.idx) idx FROM a LEFT JOIN {_BI} b ON a.k = b.k AND b.s <= a.s GROUP BY a.v",
    "count_skewed": f"{_VS} " + _COUNT.format(_TH),
    "search_idxs_skewed": f"{_VS} SELECT a.k, a.v qv, b.idx FROM a JOIN {_BI} b ON {_TH}",
    "merge_last": f"{_V}, {_islands('a')} SELECT k, min(s) s, max(e) e, arg_max(v, (s, e, v)) v FROM y GROUP BY k, g",
    "merge_min": f"{_V}, {_islands('a')} SELECT k, min(s) s, max(e) e, min(v) v FROM y GROUP BY k, g",
    "merge_lambda": f"{_V}, {_islands('a')} SELECT k, min(s) s, max(e) e, CAST(2 * sum(v) - arg_min(v, (s, e, v)) AS BIGINT) v FROM y GROUP BY k, g",
    "merge_python": f"{_V}, {_islands('a')} SELECT k, min(s) s, max(e) e, list_reduce(list(v ORDER BY s, e, v), lambda p, q: (p * 31 + q) % 1000003) v FROM y GROUP BY k, g",
    "merge_index_order": f"{_V}, {_islands('a')} SELECT k, min(s) s, max(e) e, string_agg(CAST(v AS VARCHAR), ',' ORDER BY s, e DESC, v) vs FROM y GROUP BY k, g",
    "coverage_inclusive": f"{_V} SELECT a.v qv, count(b.s) n, CAST(coalesce(sum(CASE WHEN b.s IS NOT NULL THEN least(a.e, b.e) - greatest(a.s, b.s) + 1 END), 0) AS BIGINT) covered FROM a LEFT JOIN b ON {_TH} GROUP BY a.v",
    "symmetric_difference_sum": ORACLE["symmetric_difference"].replace("max(e) e FROM y", "max(e) e, CAST(sum(v) AS BIGINT) v FROM y"),
    "save_load": f"{_V} SELECT k, s, e, v FROM a",
    "bed_raw": f"{_V} SELECT 'p' || k contig, s, e + 1 e FROM a",
    "bed_swapped": f"{_V} SELECT 'p' || (k % 10) contig, s, e FROM a WHERE k % 10 IN (3, 7)",
    "report_sink": ORACLE["bed_coverage"],
}
for _how in ("equi", "binned", "sweep"):
    ORACLE[f"count_null_keys_{_how}"] = f"{_VN} " + _COUNT.format(_TH)
    ORACLE[f"has_overlaps_null_keys_{_how}"] = f"{_VN} SELECT a.v qv, CAST(EXISTS (SELECT 1 FROM b WHERE {_TH}) AS INTEGER) hit FROM a"
_SECOND = "CAST(floor(epoch(ts)) AS BIGINT)"
for _name, _join in (("stream_enrich", "JOIN"), ("stream_enrich_left", "LEFT JOIN")):
    ORACLE[_name] = (
        f"WITH b AS (SELECT user_id k, {_SECOND} - 3600 s, {_SECOND} + CAST(floor(value * 60) AS BIGINT) e, event_id v FROM events WHERE event_type = 'purchase') "
        f"SELECT q.event_id qv, b.v bv FROM (SELECT event_id, user_id, {_SECOND} t FROM events) q {_join} b ON q.user_id = b.k AND b.s <= q.t AND q.t <= b.e"
    )
