"""Near-duplicate documents by b-bit MinHash (operator 2).

1. Every text gives its set of 5-word shingles (64-bit hashes), the set's digest,
   ``BANDS * ROWS`` minima, of which bands are hashed and the low four bits packed.
2. Texts with equal sets form classes; a class is its smallest doc_id.
3. Classes that share a band bucket are candidates. Small buckets give their pairs;
   in large ones all members are compared with one of them.
4. Large buckets that still hold several components hold texts that resemble each
   other and mostly are not linked. Comparing them pair by pair would grow with the
   square of the group, so they are joined exactly by what sets them apart. Buckets
   with common members form a neighbourhood with a pivot set P. As
   |X ^ Y| = |(X ^ P) ^ (Y ^ P)|, two sets are linked if and only if their
   differences from P overlap enough: a prefix filter with positions over these short
   differences, rarest shingles first. Sets so near to P that no overlap is needed
   are linked with the nearest one.
5. A candidate pair is dropped when the collision-corrected estimate from its packed
   bits lies more than six standard deviations under the threshold; all others are
   confirmed on the full sets.
6. Components come from the confirmed links.

With 50 bands of 5 rows a pair at similarity 0.75 shares no bucket with
probability (1 - 0.75**5)**50 = 1.3e-6, less above it.

Sets travel in Arrow batches of bounded bytes. A text with many candidates (the first
of a large bucket, a pivot) is not copied to each of them: such sets are broadcast while
they are at most ``BROADCAST_BYTES``, and joined beyond that.

Rows of one doc_id are one document; of several texts under it, each has its own row of
the result. A NULL text is empty; empty sets link with nothing; a NULL doc_id links with
nothing and is kept. Texts of any length are taken whole. Equal texts are one class, so
ties and repeated rows change nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.llm.common import BROADCAST_BYTES, BROADCAST_ROWS, Scratch, connected_components, counted, cut, small, small_arrow_batches

SHINGLE = 5
BANDS, ROWS, BITS = 50, 5, 4
PERCENT = 75
#: Sets X and Y are linked when WHOLE * |X ^ Y| <= APART * (|X| + |Y|).
WHOLE, APART = 100 + PERCENT, 100 - PERCENT
#: Buckets up to this size give all their pairs at once.
SMALL_BUCKET = 8
#: Cells that hold the frequencies of shingles (8 bytes each).
CELLS = 2**18
#: Candidates from which on a text's set goes to the pairs, and not the pairs to it.
HOT_PAIRS = 32

_random = np.random.default_rng(20240229)
_A = (_random.integers(0, 2**31, BANDS * ROWS, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_B = _random.integers(0, 2**32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
_MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


_bytes = np.arange(256, dtype=np.uint8)
#: A-Z lower-cased, plus one so that no byte weighs nothing.
_lower = np.where((_bytes >= 65) & (_bytes <= 90), _bytes + 32, _bytes).astype(np.uint64) + np.uint64(1)
_word_byte = ~((_bytes == 0x20) | ((_bytes >= 0x09) & (_bytes <= 0x0D)))
_weights = np.random.default_rng(97).integers(0, 2**64, 64, dtype=np.uint64)


def _position_weights(n: int) -> np.ndarray:
    """At least ``n`` random weights, always the same ones."""
    global _weights
    if len(_weights) < n:
        _weights = np.random.default_rng(97).integers(0, 2**64, max(n, 2 * len(_weights)), dtype=np.uint64)
    return _weights


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit multilinear hash of every word, in order."""
    x = np.frombuffer(text, np.uint8)
    inside = np.concatenate(([False], _word_byte[x], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    first, size = edges[0::2], edges[1::2] - edges[0::2]
    if not len(first):
        return np.empty(0, np.uint64)
    at = np.cumsum(size) - size
    letters = _lower[x[inside[1:-1]]]
    place = np.arange(len(letters)) - np.repeat(at, size)
    return np.add.reduceat(letters * _position_weights(int(size.max()))[place], at) + size.astype(np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h * _MIX1
    return (h ^ (h >> np.uint64(29))) * _MIX2


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    w = word_hashes(text) if text else np.empty(0, np.uint64)
    n = len(w)
    if not n:
        return np.empty(0, np.uint64)
    size = min(n, SHINGLE)
    h = _mix(w[: n - size + 1] + np.uint64(size))
    for k in range(1, size):
        h = _mix(h + w[k : n - size + 1 + k])
    h ^= h >> np.uint64(32)
    return np.unique(h)


def minima(s: np.ndarray) -> np.ndarray:
    x = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(out, (np.multiply.outer(_A, x[i : i + 2048]) + _B[:, None]).min(axis=1), out=out)
    return out


def band_hashes(m: np.ndarray) -> np.ndarray:
    m = m.reshape(BANDS, ROWS).astype(np.uint64)
    h = _mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for r in range(ROWS):
        h = _mix(h + m[:, r])
    return h.view(np.int64)


def packed(m: np.ndarray) -> bytes:
    low = (m & 15).astype(np.uint8)
    return (low[0::2] | (low[1::2] << 4)).tobytes()


def estimate(a: bytes, b: bytes) -> float:
    """Similarity from two packed signatures, corrected for chance collisions of the kept bits."""
    x = int.from_bytes(a, "little") ^ int.from_bytes(b, "little")
    x |= x >> 1
    x |= x >> 2
    differ = (x & _LANES).bit_count()
    chance = 2.0**-BITS
    return (1 - differ / (BANDS * ROWS) - chance) / (1 - chance)


_LANES = int.from_bytes(b"\x11" * (BANDS * ROWS // 2), "little")
_FLOOR = PERCENT / 100 - 6 * math.sqrt(PERCENT / 100 * (1 - PERCENT / 100) / (BANDS * ROWS))


def _sign(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, 1000):
            part = batch.slice(i, 1000)
            n, digest, bands, sig = [], [], [], []
            for t in part.column("text").to_pylist():
                s = shingle_set(t)
                n.append(len(s))
                if len(s):
                    m = minima(s)
                    digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                    bands.append(band_hashes(m))
                    sig.append(packed(m))
                else:
                    digest.append(None)
                    bands.append(None)
                    sig.append(None)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())], ["doc_id", "n", "digest", "bands", "sig"])


def _sets(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, 1000):
            part = batch.slice(i, 1000)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([shingle_set(t).tobytes() for t in part.column("text").to_pylist()], pa.binary())], ["node", "s"])


def _estimated(batches):
    for batch in batches:
        keep = [min(x, y) * 100 >= PERCENT * max(x, y) and estimate(a, b) >= _FLOOR for x, y, a, b in zip(*(batch.column(c).to_pylist() for c in ("nu", "nv", "su", "sv")), strict=True)]
        yield batch.filter(pa.array(keep, pa.bool_())).select(["u", "v"])


def linked(a: bytes, b: bytes) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = np.concatenate((x, y))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= PERCENT * (len(x) + len(y) - common)


def _confirmed(hot):
    """Keeps the linked pairs; a set that did not come with the row is in ``hot``."""

    def f(batches):
        known = hot.value if hot is not None else {}
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("u", "v", "a", "b")]
            keep = [linked(a if a is not None else known[u], b if b is not None else known[v]) for u, v, a, b in zip(*cols, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["u", "v"])

    return f


def _held(sets: DataFrame, wanted: DataFrame):
    """The sets of the few nodes ``wanted`` (node; a table) as a broadcast, or None where they are more than ``BROADCAST_BYTES``."""
    got = sets.join(F.broadcast(wanted), "node")
    if (got.agg(F.sum(F.octet_length("s") + 64)).first()[0] or 0) > BROADCAST_BYTES:
        return None
    return sets.sparkSession.sparkContext.broadcast({r[0]: bytes(r[1]) for r in got.select("node", "s").collect()})


def _frequencies(batches):
    """(cell, n): how many of the sets' shingles fall into each cell."""
    counts = np.zeros(CELLS, np.int64)
    for batch in batches:
        for s in batch.column("s").to_pylist():
            np.add.at(counts, _cell(np.frombuffer(s, np.uint64)), 1)
    at = np.flatnonzero(counts)
    for i in range(0, len(at), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 100_000]), pa.array(counts[at[i : i + 100_000]])], ["cell", "n"])


def _cell(s: np.ndarray) -> np.ndarray:
    return (s % np.uint64(CELLS)).astype(np.int64)


def slack(d: int, n: int) -> int:
    """What a set of ``n`` shingles, ``d`` of them and the pivot's apart, adds to the overlap a link needs: 2 * WHOLE * overlap >= sum of both."""
    return WHOLE * d - APART * n


def prefix(s: np.ndarray, counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a difference, the rarest shingles that two differences with an overlap of ``least`` or more must share one of, and how many are left from each on."""
    order = s[np.lexsort((s, counts[_cell(s)]))][: max(0, len(s) - least + 1)]
    left = len(s) - np.arange(len(order))
    shared = counts[_cell(order)] > 1
    return order[shared], left[shared]


def _differences(hot):
    """(blob, node, comp, minor, slack, s): each set less its neighbourhood's pivot, which is in ``hot`` or comes with the row."""

    def f(batches):
        known = hot.value if hot is not None else {}
        for batch in batches:
            sets = [np.frombuffer(s, np.uint64) for s in batch.column("s").to_pylist()]
            pivots = [known[n] if p is None else p for n, p in zip(batch.column("pivot").to_pylist(), batch.column("p").to_pylist(), strict=True)]
            d = [np.setxor1d(s, np.frombuffer(p, np.uint64), assume_unique=True) for s, p in zip(sets, pivots, strict=True)]
            slacks = [slack(len(x), len(s)) for x, s in zip(d, sets, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("blob", "node", "comp", "minor")), pa.array(slacks, pa.int64()), pa.array([x.tobytes() for x in d], pa.binary())], ["blob", "node", "comp", "minor", "slack", "s"])

    return f


def _prefixes(counts):
    def f(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                got = [prefix(np.frombuffer(s, np.uint64), counts.value, max(1, -(-(k + low) // (2 * WHOLE)))) for s, k, low in zip(*(part.column(c).to_pylist() for c in ("s", "slack", "low")), strict=True)]
                rows = pa.array(np.repeat(np.arange(part.num_rows), [len(g) for g, _ in got]))
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(rows) for c in ("blob", "node", "comp", "minor", "slack")), pa.array(np.concatenate([g for g, _ in got]).view(np.int64)), pa.array(np.concatenate([r for _, r in got]))], ["blob", "node", "comp", "minor", "slack", "shingle", "left"])

    return f


def _counted(differences: DataFrame):
    """How many differences hold a shingle, in ``CELLS`` cells whatever the input, as a broadcast."""
    counts = np.zeros(CELLS, np.int64)
    got = differences.select("s").mapInArrow(_frequencies, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return differences.sparkSession.sparkContext.broadcast(counts)


def resembling(live: DataFrame, sets: DataFrame, rows: int) -> DataFrame:
    """(u, v): candidates among the members of unresolved buckets (bucket, node, comp) that leave no link between components out.

    Only pairs of different components are made, so the largest component of a
    neighbourhood, which may be nearly all of it, is never joined with itself.
    """
    spark = live.sparkSession
    firsts, n = counted(live.groupBy("bucket").agg(F.min("node").alias("v")), "firsts", rows)
    spread = live.join(small(firsts, n), "bucket").select(F.col("node").alias("u"), "v").distinct()
    blobs = connected_components(cut(spread, "spread", rows), rows)
    nodes = live.groupBy("node", "comp").agg(F.count("*").alias("n")).join(blobs, "node", "left")
    nodes = cut(nodes.select("node", "comp", "n", F.coalesce("component", "node").alias("blob")), "resembling", rows)
    pivots = nodes.groupBy("blob").agg(F.max_by("node", F.struct("n", "node")).alias("pivot"))
    major = nodes.groupBy("blob", "comp").agg(F.count("*").alias("k")).groupBy("blob").agg(F.max_by("comp", F.struct("k", "comp")).alias("major"))
    pivots, n = counted(pivots.join(major, "blob"), "pivots", rows)
    hot = _held(sets, pivots.select(F.col("pivot").alias("node"))) if n <= BROADCAST_ROWS else None
    placed = nodes.join(small(pivots, n), "blob").join(sets, "node").select("blob", "node", "comp", (F.col("comp") != F.col("major")).alias("minor"), "s", "pivot")
    whole = placed.withColumn("p", F.lit(None).cast("binary")) if hot is not None else placed.join(sets.select(F.col("node").alias("pivot"), F.col("s").alias("p")), "pivot")
    schema = "blob bigint, node bigint, comp bigint, minor boolean, slack bigint, s binary"
    with small_arrow_batches(spark):
        apart = cut(whole.select("blob", "node", "comp", "minor", "s", "pivot", "p").mapInArrow(_differences(hot), schema), "differences")
    nearest = apart.groupBy("blob").agg(F.min("slack").alias("low"), F.min_by(F.struct("node", "comp"), F.struct("slack", "node")).alias("at"))
    apart = apart.join(small(*counted(nearest, "nearest", rows)), "blob")
    near = apart.where("slack + low <= 0 AND comp <> at.comp").select(F.least("node", "at.node").alias("u"), F.greatest("node", "at.node").alias("v"))
    with small_arrow_batches(spark):
        held = apart.mapInArrow(_prefixes(_counted(apart)), "blob bigint, node bigint, comp bigint, minor boolean, slack bigint, shingle bigint, left bigint")
        held = cut(held, "prefixes")
    one, two = held.where("minor").alias("x"), held.alias("y")
    enough = F.expr(f"x.comp <> y.comp AND (NOT y.minor OR x.node < y.node) AND {2 * WHOLE} * least(x.left, y.left) >= x.slack + y.slack")
    met = one.join(two, (F.col("x.blob") == F.col("y.blob")) & (F.col("x.shingle") == F.col("y.shingle")) & enough)
    return near.unionByName(met.select(F.least("x.node", "y.node").alias("u"), F.greatest("x.node", "y.node").alias("v")))


def _pairs_of_small(members: DataFrame) -> DataFrame:
    got = members.groupBy("bucket").agg(F.collect_set("node").alias("m"))
    pairs = F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: y > x), lambda y: F.struct(x.alias("u"), y.alias("v")))))
    return got.select(F.inline(pairs))


def _joined(cand: DataFrame, sets: DataFrame, sigs: DataFrame, labels: DataFrame | None) -> DataFrame | None:
    """(node, component) after the candidates (u, v) that are linked have been joined."""
    cand, n = counted(cand.distinct(), "pairs")
    often = cand.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > HOT_PAIRS).select("node")
    often, many = counted(often, "often", n)
    both = _signed(_signed(cand, "u", sigs, often, many), "v", sigs, often, many)
    cand = cut(both.mapInArrow(_estimated, "u bigint, v bigint"), "candidates")
    new, n = _linked(cand, sets, often, many)
    if not n:
        return labels
    if labels is None:
        return connected_components(new, n)
    return connected_components(new.unionByName(labels.toDF("u", "v")), n + labels.count())  # earlier links count as their components' stars


def _signed(cand: DataFrame, p: str, sigs: DataFrame, often: DataFrame, many: int) -> DataFrame:
    """The candidates with size and signature of node ``p``; those of the nodes ``often`` are broadcast where they are few."""
    side = sigs.select(F.col("rep").alias(p), F.col("nset").alias(f"n{p}"), F.col("sig").alias(f"s{p}"))
    if not 0 < many * 256 <= BROADCAST_BYTES:
        return cand.join(side, p)
    hot = F.broadcast(often.select(F.col("node").alias(p)))
    return cand.join(hot, p, "left_semi").join(F.broadcast(side.join(hot, p, "left_semi")), p).unionByName(cand.join(hot, p, "left_anti").join(side, p))


def _linked(cand: DataFrame, sets: DataFrame, often: DataFrame, many: int) -> tuple[DataFrame, int]:
    """Those of the candidates (u, v) that are linked, by their full sets, as a table; and their number."""
    schema, binary = "u bigint, v bigint", F.lit(None).cast("binary")
    left, right = (sets.select(F.col("node").alias(n), F.col("s").alias(c)) for n, c in (("u", "a"), ("v", "b")))
    hot = _held(sets, often) if 0 < many <= BROADCAST_ROWS else None
    with small_arrow_batches(sets.sparkSession):
        if hot is None:
            return counted(cand.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(_confirmed(None), schema), "links")
        for c in "uv":
            cand = cand.join(F.broadcast(often.select(F.col("node").alias(c), F.lit(True).alias(f"h{c}"))), c, "left")
        cand = cand.select("u", "v", F.coalesce("hu", F.lit(False)).alias("hu"), F.coalesce("hv", F.lit(False)).alias("hv"))
        # only the side with few candidates is joined
        one = cand.where("hu <> hv").withColumn("node", F.when(F.col("hu"), F.col("v")).otherwise(F.col("u"))).join(sets, "node")
        one = one.select("u", "v", F.when(~F.col("hu"), F.col("s")).alias("a"), F.when(F.col("hu"), F.col("s")).alias("b"))
        both = cand.where("hu AND hv").select("u", "v", binary.alias("a"), binary.alias("b"))
        none = cand.where("NOT hu AND NOT hv").join(left, "u").join(right, "v").select("u", "v", "a", "b")
        return counted(one.unionByName(both).unionByName(none).mapInArrow(_confirmed(hot), schema), "links")


def links(docs: DataFrame, classes: DataFrame) -> DataFrame | None:
    """(node, component) of every class that is linked with another; None where there is none."""
    members = classes.select(F.col("rep").alias("node"), F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("n > 1 AND lo < hi").select("bucket", "n")
    members, left = counted(members.join(shared, "bucket"), "members")
    if not left:
        return None
    spark = docs.sparkSession
    ids, n = counted(members.select(F.col("node").alias("doc_id")).distinct(), "ids", left)
    text = docs.select("doc_id", F.col("text").cast("binary").alias("text")).where("doc_id IS NOT NULL")
    with small_arrow_batches(spark, 10_000, 8 << 20):
        sets, found = counted(text.join(small(ids, n), "doc_id", "left_semi").mapInArrow(_sets, "node bigint, s binary"), "sets")
    sigs = cut(classes.join(ids.select(F.col("doc_id").alias("rep")), "rep", "left_semi").select("rep", "nset", "sig"), "sigs", n)
    if found > n:  # repeated ids
        sets = cut(sets.distinct(), "sets")
    big = members.where(F.col("n") > SMALL_BUCKET).select("bucket", "node")
    firsts, large = counted(big.groupBy("bucket").agg(F.min_by("node", F.xxhash64("node", "bucket")).alias("rnode")), "firsts", left)
    starred = big.join(small(firsts, large), "bucket").where("node <> rnode").select(F.least("node", "rnode").alias("u"), F.greatest("node", "rnode").alias("v"))
    labels = _joined(_pairs_of_small(members.where(F.col("n") <= SMALL_BUCKET)).unionByName(starred), sets, sigs, None)
    live = big.withColumn("comp", F.col("node")) if labels is None else big.join(labels, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("comp"))
    live = cut(live, "live", left)
    unresolved, n = counted(live.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket"), "unresolved", large)
    live = cut(live.join(small(unresolved, n), "bucket", "left_semi"), "unresolved", left)
    left = live.count()
    return _joined(resembling(live, sets, left), sets, sigs, labels) if left else labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    text = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    with small_arrow_batches(docs.sparkSession, 10_000, 8 << 20):
        rows = cut(text.mapInArrow(_sign, "doc_id bigint, n bigint, digest binary, bands array<bigint>, sig binary"), "signatures")
    reps = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    reps = cut(reps, "classes")
    classes = rows.join(reps, "digest").where("doc_id = rep").select("rep", F.col("n").alias("nset"), "bands", "sig").dropDuplicates(["rep", "sig"])
    with Scratch(docs.sparkSession) as scratch:
        labels = links(docs, classes)
        if labels is not None:
            scratch.keep(labels)
    if labels is not None:
        reps = reps.join(labels, reps["rep"] == labels["node"], "left").select("digest", F.coalesce("component", "rep").alias("component"))
    else:
        reps = reps.select("digest", F.col("rep").alias("component"))
    out = rows.select("doc_id", "n", "digest").join(reps, "digest", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("bigint")).otherwise(F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
