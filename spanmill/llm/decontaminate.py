"""Benchmark decontamination (operator 6): hash set of normalised test n-grams, DataFrame functions only.

Words are runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z; a window
is ``WINDOW`` consecutive words of a benchmark item, or all words of a shorter one.
Training texts get a hash for every window of each length that the benchmark has,
built by doubling from word hashes; positions whose hash is in the set are kept with
their words, and those words are compared with the items' windows, so a collision
of hashes hits nothing.

The set goes to the tasks with the plan while it has at most ``MAX_SET`` windows; a
larger benchmark is joined instead, to the same result. The items of a window stay a
table: the driver sees windows only. NULL texts have no words and no hits; a NULL item
text has no windows. Repeated rows are scored each on its own, repeated items count
once, and texts may be of any length. Columns may have any names; without documents the
result is empty, without items nothing is hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.llm.common import BROADCAST_ROWS, cut, sealed

WINDOW = 10
MAX_SET = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: str) -> Column:
    return F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER)


def words(text: str) -> Column:
    """The words of a text, in order."""
    return F.filter(F.split(ascii_lower(text), SEPARATORS), lambda w: w != "")


def _windows(df: DataFrame, hashes: str, sizes: list[int]) -> DataFrame:
    """Add ``_h<size>``: hashes of all windows of each size, NULL where a window passes the end."""
    have = {1: hashes}
    made = []

    def shifted(name: str, by: int) -> Column:
        return F.slice(F.col(name), F.lit(by + 1), F.greatest(F.size(name) - by, F.lit(0)))

    def joined(a: str, b: str, by: int) -> Column:
        return F.zip_with(F.col(a), shifted(b, by), lambda x, y: F.when(x.isNotNull() & y.isNotNull(), F.xxhash64(x, y)))

    def build(m: int) -> str:
        nonlocal df
        if m not in have:
            big = 1 << (m.bit_length() - 1)
            a, b = (m // 2, m - m // 2) if m == big else (big, m - big)
            x, y = build(a), build(b)
            df = df.withColumn(f"_h{m}", joined(x, y, a))
            have[m] = f"_h{m}"
            made.append(f"_h{m}")
        return have[m]

    for m in sizes:
        build(m)
    drop = [c for c in made if int(c[2:]) not in sizes]
    return df.drop(*drop)


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """size, text, item_ids: the distinct windows of all items, words joined by spaces."""
    w = items.select("item_id", words("text").alias("w")).where(F.size("w") > 0).withColumn("size", F.least(F.size("w"), F.lit(window)))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)
    one = w.select("item_id", "size", F.explode(F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice("w", i, F.col("size")), " ")))).alias("window"))
    return one.groupBy("size", "window").agg(F.collect_set("item_id").alias("item_ids"))


def _hash(words: Column, size: int) -> Column:
    """The hash of one window, as ``_windows`` builds it."""
    if size == 1:
        return F.xxhash64(F.get(words, F.lit(0)))

    def build(at: int, m: int) -> Column:
        if m == 1:
            return F.xxhash64(F.get(words, F.lit(at)))
        big = 1 << (m.bit_length() - 1)
        a = m // 2 if m == big else big
        return F.xxhash64(build(at, a), build(at + a, m - a))

    return build(0, size)


def _inside(size: int, hashes: list[int]) -> Column:
    """Positions (from 0) of the windows of ``size`` whose hash is in the set."""
    at = F.transform(F.col("_x" if size == 1 else f"_h{size}"), lambda h, i: F.when(h.isin(hashes), i))
    return F.filter(at, lambda i: i.isNotNull())


def _named(positions: Column, size: int) -> Column:
    """position (from 1), size and words of the windows at ``positions`` (from 0)."""
    return F.transform(positions, lambda i: F.struct((i + 1).alias("position"), F.lit(size).alias("size"), F.concat_ws(" ", *[F.get(F.col("_w"), i + k) for k in range(size)]).alias("window")))


def _among(texts: list[str]):
    return lambda x: x["window"].isin(texts)


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, columns: tuple[str, ...] = ("doc_id",), max_set: int = MAX_SET) -> DataFrame:
    """``columns`` as c0_, c1_, ..., _row, n_words and, per occurrence of a window, position (from 1), size and item_ids; one row of NULLs without any."""
    wanted = cut(benchmark_windows(items, window), "windows")
    spark = docs.sparkSession
    known = wanted.select("size", "window").limit(max_set + 1).collect()
    df, names, (body,) = sealed(docs, list(columns), "text")
    scan = df.select(*names, F.monotonically_increasing_id().alias("_row"), words(body).alias("_w"))
    scan = scan.withColumn("_x", F.transform("_w", lambda w: F.xxhash64(w)))
    if len(known) <= max_set:
        sizes = sorted({r["size"] for r in known})
        scan = _windows(scan, "_x", sizes)
        by_size = _hashes(spark, known, sizes)
        found = [_named(_inside(m, by_size[m]), m) for m in sizes]
        ids = wanted.agg(F.sum(F.size("item_ids"))).first()[0] or 0
        wanted = F.broadcast(wanted) if ids <= BROADCAST_ROWS else wanted
        every = F.concat(*found) if found else F.array().cast("array<struct<position:int,size:int,window:string>>")
        flat = scan.withColumn("_found", every).select(*names, "_row", F.size("_w").cast("bigint").alias("n_words"), F.explode_outer("_found").alias("_f"))
        flat = flat.select(*names, "_row", "n_words", F.col("_f.position").alias("position"), F.col("_f.size").alias("size"), F.col("_f.window").alias("window"))
        return flat.join(wanted, ["size", "window"], "left").select(*names, "_row", "n_words", F.when(F.col("item_ids").isNotNull(), F.col("position")).alias("position"), "size", "item_ids")
    # a benchmark that no task should hold: every window meets it in a join
    sizes = [r[0] for r in wanted.select("size").distinct().collect()]
    none = F.array().cast("array<struct<position:int,size:int,window:string>>")
    windows = F.flatten(F.array(*[F.when(F.size("_w") >= m, _named(F.sequence(F.lit(0), F.size("_w") - m), m)).otherwise(none) for m in sizes]))
    base = scan.select(*names, "_row", F.size("_w").cast("bigint").alias("n_words"), F.explode_outer(windows).alias("_f"))
    base = base.select(*names, "_row", "n_words", F.col("_f.position").alias("position"), F.col("_f.size").alias("size"), F.col("_f.window").alias("window"))
    return base.join(wanted, ["size", "window"], "left").select(*names, "_row", "n_words", F.when(F.col("item_ids").isNotNull(), F.col("position")).alias("position"), "size", "item_ids")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, columns: tuple[str, ...] = ("doc_id",), max_set: int = MAX_SET) -> DataFrame:
    """``columns``, n_words, n_hit, item_ids (sorted), hit_positions for every row of ``docs``."""
    found = hits(docs, items, window, columns, max_set)
    names = found.columns[: len(columns)]
    reach = F.when(F.col("position").isNotNull(), F.sequence("position", F.col("position") + F.col("size") - 1))
    per = found.groupBy("_row").agg(*[F.first(c).alias(c) for c in names], F.first("n_words").alias("_n"), F.collect_list(reach).alias("_p"), F.collect_set("item_ids").alias("_i"))
    hit = F.array_sort(F.array_distinct(F.flatten("_p")))
    out = per.select(*names, "_n", hit.alias("_hit"), F.array_sort(F.array_distinct(F.flatten("_i"))).alias("_items"))
    return out.select(*names, "_n", "_hit", "_items", F.size("_hit").cast("bigint")).toDF(*columns, "n_words", "hit_positions", "item_ids", "n_hit")


def _hashes(spark, known: list, sizes: list[int]) -> dict[int, list[int]]:
    """size -> the distinct hashes of the windows ``known`` (size, window)."""
    out: dict[int, list[int]] = {m: [] for m in sizes}
    if known:
        local = spark.createDataFrame([(r["size"], r["window"]) for r in known], "size int, window string")
        for m, h in local.select("size", F.coalesce(*[F.when(F.col("size") == m, _hash(F.split("window", " "), m)) for m in sizes]).alias("h")).distinct().collect():
            out[m].append(h)
    return out


def flagged(docs: DataFrame, items: DataFrame, columns: list[str], text: str = "text", window: int = WINDOW) -> DataFrame:
    """``columns`` of every row with ``contaminated`` and a row number ``_at``. Texts stay where they are: only the test in the scan is needed.

    A window that only shares its hash is ruled out by comparing its words with the
    benchmark's windows, which travel with the plan while they are at most ``MAX_SET``.
    A filter that also names ``_at`` stays above the projection; else the optimizer would
    copy the window hashes into it and compute them many times over.
    """
    wanted = benchmark_windows(items, window)
    known = wanted.select("size", "window").limit(MAX_SET + 1).collect()
    if len(known) > MAX_SET:
        at = F.monotonically_increasing_id().alias("_at")
        got = contamination(docs.select(*columns, F.col(text).alias("text"), at), items, window, (*columns, "_at"))
        return got.select(*columns, (F.col("n_hit") > 0).alias("contaminated"), "_at")
    spark = docs.sparkSession
    sizes = sorted({r["size"] for r in known})
    scan = docs.select(*columns, words(text).alias("_w")).withColumn("_x", F.transform("_w", lambda w: F.xxhash64(w)))
    scan = _windows(scan, "_x", sizes)
    hit = F.lit(False)
    by_size = _hashes(spark, known, sizes)
    for m in sizes:
        texts = [r["window"] for r in known if r["size"] == m]
        hit = hit | F.exists(_named(_inside(m, by_size[m]), m), _among(texts))
    return scan.select(*columns, hit.alias("contaminated"), F.monotonically_increasing_id().alias("_at"))
