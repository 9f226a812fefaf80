"""Near-duplicate embeddings by PCA-ordered tiled comparison (operator 3).

1. Equal vectors form classes; a class is its smallest vec_id and counts its members.
2. Unit vectors are rotated to the principal axes of all vectors, so that the leading
   coordinates hold most of a product.
3. Rows are laid out by cells of the first three coordinates, as wide as two linked
   vectors can lie apart, and cut into tiles. Only tiles of the same or adjacent cells
   whose bounding boxes come near enough meet, which their descriptions tell before any
   vector moves; no cell is held by one task.
4. Neighbouring tiles form groups. A task compares two groups, so a tile is sent once
   for each group that it meets, in the numbers that it was given in (not once for each tile).
5. In a pair of tiles, products over the leading dimensions are accumulated first, as
   many as the spectrum says can tell pairs apart. What the remaining ones can add is at
   most the product of the suffix norms, so a pair stops as soon as that cannot reach the
   threshold; the rest is finished on the original vectors in double precision. Tiles so
   narrow and near that all their pairs must link skip the comparison.
6. A pair of groups gives counts per vector and spanning forests of its links, not the
   links themselves.

NULL, empty and zero vectors and those with NULL or non-finite components link with
nothing, nor do vectors of different lengths. Rows of one vec_id with the same vector
count as several vectors, as do rows of one vec_id with different ones; a NULL vec_id
links with nothing and is kept. Vectors may have any length. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.llm.common import Scratch, connected_components, counted, cut, small, small_arrow_batches

THRESHOLD = 0.9
TILE, GROUP_ROWS = 1024, 65_536
#: Numbers of leading dimensions after which pairs are dropped.
STEPS = (4, 8, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512, 768, 1024)
#: Share of a tile pair up to which what is left is finished pair by pair.
SPARSE = 0.02
#: Above what rounding can do to a product of unit vectors.
SLACK = 1e-6


def _doubles(column) -> list:
    """float64 arrays of an Arrow list column; None for NULL rows and rows with a NULL."""
    out = []
    values = column.flatten() if isinstance(column, pa.ListArray) else None
    if values is not None and not column.null_count and not values.null_count:
        v = np.asarray(values.to_numpy(zero_copy_only=False), np.float64)
        at = column.offsets.to_numpy() - column.offsets[0].as_py()
        return [v[at[i] : at[i + 1]] for i in range(len(column))]
    for x in column.to_pylist():
        out.append(None if x is None or any(c is None for c in x) else np.array(x, np.float64))
    return out


def _prepared(kind: str):
    """vec_id, digest, the components as ``kind`` and the norm; NULLs for what links with nothing."""

    def f(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 4000):
                part = batch.slice(i, 4000)
                digests, raws, norms = [], [], []
                for v in _doubles(part.column("embedding").combine_chunks() if isinstance(part.column("embedding"), pa.ChunkedArray) else part.column("embedding")):
                    ok = v is not None and len(v) and np.isfinite(v).all()
                    top = np.abs(v).max() if ok else 0
                    if not ok or top == 0:
                        for x in (digests, raws, norms):
                            x.append(None)
                        continue
                    v = v + 0.0  # -0.0 is 0.0
                    digests.append(xxhash.xxh3_128_digest(v.tobytes()))
                    if kind == "f8" and not 1e-100 < top < 1e100:
                        v = v / top  # so that the norm is finite
                    raws.append(v.astype(kind).tobytes())
                    norms.append(math.sqrt(v @ v))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(digests, pa.binary()), pa.array(raws, pa.binary()), pa.array(norms, pa.float64())], ["vec_id", "digest", "raw", "norm"])

    return f


def _units(raw: bytes, norms: np.ndarray, kind: str) -> np.ndarray:
    """Unit rows, in double precision."""
    return np.frombuffer(raw, kind).reshape(len(norms), -1).astype(np.float64) / norms[:, None]


def _by_length(batch, kind: str):
    """(length, row numbers, unit rows) of a batch."""
    raws, norms = batch.column("raw").to_pylist(), batch.column("norm").to_numpy()
    by: dict[int, list] = {}
    for i, r in enumerate(raws):
        by.setdefault(len(r) // np.dtype(kind).itemsize, []).append(i)
    for d, at in by.items():
        yield d, at, _units(b"".join(raws[i] for i in at), norms[at], kind)


def _summary(held: dict[int, list]):
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([h[0] for h in held.values()], pa.int64()), pa.array([h[1].tobytes() for h in held.values()], pa.binary()), pa.array([h[2].tobytes() for h in held.values()], pa.binary())], ["d", "n", "s", "o"])


def _moments(kind: str):
    """Per length: rows, sum and sum of outer products of one partition."""

    def f(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for d, _, x in _by_length(batch, kind):
                n, s, o = held.get(d, (0, 0.0, 0.0))
                held[d] = (n + len(x), s + x.sum(0), o + x.T @ x)
        yield from _summary(held)

    return f


def _summed(batches):
    held: dict[int, list] = {}
    for batch in batches:
        for d, n, s, o in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            m, t, p = held.get(d, (0, 0.0, 0.0))
            held[d] = (m + n, t + np.frombuffer(s), p + np.frombuffer(o))
    yield from _summary(held)


def principal_axes(vectors: DataFrame, kind: str) -> dict[int, tuple[np.ndarray, list[int]]]:
    """Per length the axes, in columns, by falling variance, and the steps at which pairs are dropped; the driver gets one matrix per length."""
    schema = "d int, n bigint, s binary, o binary"
    parts = vectors.select("raw", "norm").mapInArrow(_moments(kind), schema).repartition(16, "d", F.spark_partition_id() % 16).mapInArrow(_summed, schema)
    axes = {}
    total: dict[int, tuple] = {}
    for d, n, s, o in parts.collect():  # 16 matrices per length at most
        m, t, p = total.get(d, (0, 0.0, 0.0))
        total[d] = (m + n, t + np.frombuffer(s), p + np.frombuffer(o).reshape(d, d))
    for d, (n, s, o) in total.items():
        _, v = np.linalg.eigh(o / n - np.outer(s / n, s / n))
        v = v[:, ::-1]
        axes[d] = (v, leading(np.einsum("ij,ik,kj->j", v, o / n, v)))
    return axes


def leading(energy: np.ndarray, threshold: float = THRESHOLD) -> list[int]:
    """Steps from the first at which a usual pair falls short: its product so far, with four deviations, and the suffix energy stay under the threshold."""
    steps = [k for k in STEPS if k < len(energy)]
    enough = [k for k in steps if 4 * math.sqrt((energy[:k] ** 2).sum()) + max(0.0, 1 - energy[:k].sum()) < threshold]
    return [k for k in steps if k >= enough[0]] if enough else steps[-1:]


def _cells(axes: dict, width: float, kind: str):
    def f(batches):
        for batch in batches:
            lead, length = np.zeros((batch.num_rows, 4)), np.zeros(batch.num_rows, np.int32)
            for d, at, x in _by_length(batch, kind):
                y = x @ axes[d][0][:, :4]
                lead[at, : y.shape[1]], length[at] = y, d
            c = np.floor(lead[:, :3] / width).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(length), *(pa.array(c[:, k]) for k in range(3)), pa.array(lead[:, 3])], [*batch.schema.names, "d", "c0", "c1", "c2", "y"])

    return f


_TILE_FIELDS = "tile bigint, d int, c0 int, c1 int, c2 int, rows int, ids binary, counts binary, raw binary, norms binary, lo array<double>, hi array<double>, center array<double>, radius double"


def _tiles(axes: dict, kind: str):
    def f(batches):
        from pyspark import TaskContext

        held: list = []
        serial = TaskContext.get().partitionId() << 32

        def tile(rows):
            nonlocal serial
            d, c0, c1, c2 = rows[0][4:]
            raw, norms = b"".join(r[2] for r in rows), np.array([r[3] for r in rows])
            u = _units(raw, norms, kind)
            y = u @ axes[d][0]
            center = u.mean(0)
            center = center / max(np.linalg.norm(center), 1e-300)
            radius = float(np.arccos(np.clip((u @ center).min(), -1, 1)))
            serial += 1
            values = [serial, d, c0, c1, c2, len(rows), np.array([r[0] for r in rows], np.int64).tobytes(), np.array([r[1] for r in rows], np.int64).tobytes(), raw, norms.tobytes(), y.min(0).tolist(), y.max(0).tolist(), center.tolist(), radius]
            kinds = [pa.int64(), *[pa.int32()] * 5, *[pa.binary()] * 4, *[pa.list_(pa.float64())] * 3, pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [x.split()[0] for x in _TILE_FIELDS.split(", ")])

        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("rep", "n", "raw", "norm", "d", "c0", "c1", "c2")), strict=True):
                if held and (len(held) == TILE or r[4:] != held[-1][4:]):
                    yield tile(held)
                    held = []
                held.append(r)
        if held:
            yield tile(held)

    return f


def _near(threshold: float):
    """Tile pairs that may hold links; ``all`` where every pair must be one."""
    far = 2 - 2 * threshold + SLACK
    angle = math.acos(threshold)

    def f(batches):
        for batch in batches:
            col = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            keep, every = [], []
            for i in range(batch.num_rows):
                gap = np.maximum(0, np.maximum(np.subtract(col["alo"][i], col["bhi"][i]), np.subtract(col["blo"][i], col["ahi"][i])))
                keep.append(bool(gap @ gap <= far))
                between = math.acos(max(-1.0, min(1.0, float(np.dot(col["acenter"][i], col["bcenter"][i])))))
                every.append(between + col["aradius"][i] + col["bradius"][i] <= angle - SLACK)
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(every, pa.bool_())], ["a", "b", "every"])
            yield out.filter(pa.array(keep, pa.bool_()))

    return f


def tile_links(a: np.ndarray, b: np.ndarray, axes: np.ndarray, steps: list[int], threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of all pairs with a product of at least ``threshold``; with ``same`` those with i < j."""
    ya, yb = a @ axes, b @ axes
    total, done, i = np.zeros((len(a), len(b))), 0, None
    for k in steps:
        sa, sb = (np.sqrt(np.maximum(0, 1 - (y[:, :k] ** 2).sum(1))) for y in (ya, yb))
        if i is None:  # all pairs at once, until few are left
            total += ya[:, done:k] @ yb[:, done:k].T
            mask = total >= threshold - SLACK - np.multiply.outer(sa, sb)
            if same:
                mask &= np.tri(len(a), len(b), -1, bool).T
            if np.count_nonzero(mask) <= SPARSE * mask.size:
                i, j = np.nonzero(mask)
                part = total[i, j]
        else:
            part = part + _products(ya[:, done:k], yb[:, done:k], i, j)
            keep = part >= threshold - SLACK - sa[i] * sb[j]
            i, j, part = i[keep], j[keep], part[keep]
        done = k
    if i is None:
        mask = total + ya[:, done:] @ yb[:, done:].T >= threshold - SLACK
        if same:
            mask &= np.tri(len(a), len(b), -1, bool).T
        i, j = np.nonzero(mask)
    keep = _products(a, b, i, j) >= threshold
    return i[keep], j[keep]


def _products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of the pairs (i, j), a bounded block at a time."""
    block = max(1, 4_000_000 // max(1, a.shape[1]))
    return np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", a[i[s : s + block]], b[j[s : s + block]]) for s in range(0, len(i), block))])


def forest(i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row, its component's smallest id) that connect what the pairs (i, j) connect."""
    low = ids.copy()
    while True:
        before = low.copy()
        m = np.minimum(low[i], low[j])
        np.minimum.at(low, i, m)
        np.minimum.at(low, j, m)
        if (low == before).all():
            break
    at = np.nonzero(low != ids)[0]
    return ids[at], low[at]


def _compared(axes: dict, threshold: float, kind: str):
    """The tile pairs (a, b, every) of one pair of groups, given all their tiles."""

    def f(tiles: pa.Table, pairs: pa.Table) -> pa.Table:
        held = {}
        for t, d, ids, counts, raw, norms in zip(*(tiles.column(c).to_pylist() for c in ("tile", "d", "ids", "counts", "raw", "norms")), strict=True):
            held[t] = (d, np.frombuffer(ids, np.int64), np.frombuffer(counts, np.int64), raw, np.frombuffer(norms))
        links = {t: np.zeros(len(x[1]), np.int64) for t, x in held.items()}
        us, vs = [], []
        for a, b, every in sorted(zip(*(pairs.column(c).to_pylist() for c in ("a", "b", "every")), strict=True)):
            (d, ia, ca, ra, na), (_, ib, cb, rb, nb) = held[a], held[b]
            if every:
                links[a] += cb.sum() - (ca if a == b else 0)
                if a != b:
                    links[b] += ca.sum()
                ids = ia if a == b else np.concatenate((ia, ib))
                u = ids[ids != ids.min()]
                v = np.full(len(u), ids.min())
            else:
                i, j = tile_links(_units(ra, na, kind), _units(rb, nb, kind), *axes[d], threshold, a == b)
                links[a] += np.bincount(i, cb[j], len(ia)).astype(np.int64)
                links[b] += np.bincount(j, ca[i], len(ib)).astype(np.int64)
                u, v = forest(i, j, ia) if a == b else forest(i, j + len(ia), np.concatenate((ia, ib)))
            us.append(u)
            vs.append(v)
        some = [(held[t][1][n > 0], n[n > 0]) for t, n in links.items()]
        u, k = np.concatenate(us), sum(len(x) for x, _ in some)
        ids = np.concatenate([u, *(x for x, _ in some)])
        far = pa.array(np.concatenate([*vs, np.zeros(k, np.int64)]), mask=np.arange(len(ids)) >= len(u))
        return pa.table({"u": ids, "v": far, "n": np.concatenate([np.zeros(len(u), np.int64), *(n for _, n in some)])})

    return f


def _found(rows: DataFrame, classes: DataFrame, threshold: float, kind: str) -> DataFrame:
    """(u, v, n): links and numbers of links of the classes, in parts."""
    spark = rows.sparkSession
    whole = rows.join(classes, "digest").where("vec_id = rep").dropDuplicates(["digest"]).select("rep", "n", "raw", "norm")
    whole, n = counted(whole, "distinct")
    axes = principal_axes(whole, kind)
    width = math.sqrt(2 - 2 * threshold) + SLACK
    placed = whole.mapInArrow(_cells(axes, width, kind), "rep bigint, n bigint, raw binary, norm double, d int, c0 int, c1 int, c2 int, y double")
    # groups of bounded size, and as many as make a task for every core
    groups = max(-(-n // GROUP_ROWS), min(-(-n // TILE), math.ceil(math.sqrt(2 * spark.sparkContext.defaultParallelism))), 1)
    order = ["d", "c0", "c1", "c2", "y"]
    with small_arrow_batches(spark, 2000):
        tiles = cut(placed.repartitionByRange(groups, *order).sortWithinPartitions(*order).coalesce(groups).mapInArrow(_tiles(axes, kind), _TILE_FIELDS), "tiles")
    box = ["lo", "hi", "center", "radius"]
    meta = tiles.select("tile", "d", "c0", "c1", "c2", *box)
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    side = lambda p: meta.select(F.col("tile").alias(p), "d", "c0", "c1", "c2", *[F.col(c).alias(f"{p}{c}") for c in box])
    left = side("a")
    for c in ("c0", "c1", "c2"):
        left = left.withColumn("_s", F.explode(steps)).withColumn(c, F.col(c) + F.col("_s")).drop("_s")
    met = left.join(side("b"), ["d", "c0", "c1", "c2"]).where("a <= b")
    with small_arrow_batches(spark, 500):
        met, n = counted(met.mapInArrow(_near(threshold), "a bigint, b bigint, every boolean"), "met")
    # a tile's number begins with that of its group
    met = met.withColumns({"ga": F.shiftright("a", 32), "gb": F.shiftright("b", 32)})
    wanted, n = counted(met.select("ga", "gb", F.explode(F.array("a", "b")).alias("tile")).distinct(), "wanted")
    sent = tiles.select("tile", "d", "ids", "counts", "raw", "norms").join(small(wanted, n), "tile")
    compared = sent.groupBy("ga", "gb").cogroup(met.groupBy("ga", "gb")).applyInArrow(_compared(axes, threshold, kind), "u bigint, v bigint, n bigint")
    with small_arrow_batches(spark, 8):
        return cut(compared, "found")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    vectors = vectors.select("vec_id", "embedding")
    kind = "f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "f8"
    rows = cut(vectors.mapInArrow(_prepared(kind), "vec_id bigint, digest binary, raw binary, norm double"), "vectors")
    classes = cut(rows.where("digest IS NOT NULL AND vec_id IS NOT NULL").groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "classes")
    with Scratch(spark) as scratch:
        found = scratch.keep(_found(rows, classes, threshold, kind))
    counts = found.where("n > 0").groupBy("u").agg(F.sum("n").alias("links"))
    links = found.where("v IS NOT NULL").select("u", "v")
    labels = connected_components(links, links.count())
    per = classes.join(counts, classes["rep"] == counts["u"], "left").drop("u").join(labels, F.col("rep") == labels["node"], "left")
    per = per.select("digest", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = rows.select("vec_id", "digest").join(per, "digest", "left")
    known = F.col("vec_id").isNotNull()
    component = F.when(known, F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.when(known, F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
