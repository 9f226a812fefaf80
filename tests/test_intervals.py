"""Unit fixtures, regression fixtures and randomized comparison with brute force."""

import random
from collections import Counter

import pytest

from spanmill import IntervalFrame
from spanmill.operators.box2d import count_2d
from spanmill.plans import rangejoin


def frame(spark, rows):
    return IntervalFrame.from_rows(spark, rows)


def bag(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


NESTED = [(100, 180, "outer"), (105, 108, "x"), (112, 115, "x"), (140, 150, "x"), (190, 230, "late")]


def test_basics(spark):
    f = frame(spark, NESTED)
    q = f.one(160, 200)
    assert f.search_values_batch(q).first()["values"] == ["late", "outer"]
    assert f.search_idxs_batch(q).first()["idxs"] == [4, 0]
    assert f.count(q).first()["n"] == 2
    assert f.coverage(f.one(100, 230)).first()[1:] == (5, 80 + 3 + 3 + 10 + 40)
    assert f.coverage(f.one(100, 230), inclusive=True).first()["covered"] == 136 + 5
    assert f.has_overlaps(q).first()["hit"] and not f.has_overlaps(f.one(1, 99)).first()["hit"]
    assert f.at(4) == (190, 230, "late") and f.size() == 5 and f.clear().size() == 0
    for i in (5, -1):
        with pytest.raises(IndexError):
            f.at(i)
    assert {tuple(r) for r in f.upper_bound(IntervalFrame.from_arrays(spark, [99, 100, 139, 500], [99, 100, 139, 500])).collect()} == {(0, None), (1, 0), (2, 2), (3, 4)}


def test_duplicates_and_shared_endpoints(spark):
    f = frame(spark, [(7, 60, 1)] * 3 + [(7, 9, 1), (55, 90, 1), (60, 61, 2), (60, 700, 2)])
    assert [f.count(f.one(*q)).first()["n"] for q in ((58, 61), (61, 62), (9, 9), (700, 800))] == [6, 3, 4, 1]


def test_predicates(spark):
    from spanmill.functions.predicates import contains_point, overlaps

    df = spark.createDataFrame([(1, 5, 5, 9), (1, 4, 5, 9), (6, 7, 5, 9)], "a int, b int, c int, d int")
    assert [r[0] for r in df.select(overlaps("a", "b", "c", "d")).collect()] == [True, False, True]
    assert [r[0] for r in df.select(contains_point("c", "d", "b")).collect()] == [True, False, True]


def test_python_combiner(spark):
    from spanmill.functions.combine import PythonCombiner

    f = frame(spark, [(1, 5, "a"), (3, 8, "b"), (20, 30, "c")])
    assert bag(f.merge_overlaps(PythonCombiner(lambda x, y: f"{x}<{y}", "string")), "start", "end", "value") == Counter([(1, 8, "a<b"), (20, 30, "c")])
    n = frame(spark, [(1, 5, None), (3, 8, 4)])
    assert n.merge_overlaps(PythonCombiner(lambda x, y: (x or 0) + (y or 0), "bigint")).first()["value"] == 4


@pytest.mark.parametrize("strategy", ["auto", "equi", "binned", "sweep"])
def test_null_keys_match_nothing(spark, strategy):
    schema = "contig string, start bigint, end bigint, ord bigint"
    f = IntervalFrame(spark.createDataFrame([(None, 1, 9, 0), ("c", 1, 9, 1)], schema), ord="ord")
    assert {tuple(r) for r in f.count(f, strategy).collect()} == {(0, 0), (1, 1)}
    assert {tuple(r) for r in f.has_overlaps(f, strategy).collect()} == {(0, False), (1, True)}
    how = "auto" if strategy == "sweep" else strategy
    assert [r["ord"] for r in f.with_overlaps(f, how).collect()] == [1] and [r["ord"] for r in f.without_overlaps(f, how).collect()] == [0]


def test_numbers_made_on_the_fly(spark):
    """Frames without ``ord`` over a shuffled input answer each row once."""
    df = spark.range(3000).selectExpr("id % 3 AS contig", "id AS start", "id + id % 7 AS end").repartition(7)
    f = IntervalFrame(df, value=None)
    for how in ("equi", "binned", "sweep"):
        got = f.count(f, how).collect()
        assert len(got) == 3000 and min(r["n"] for r in got) >= 1
    assert f.without_overlaps(f, "binned").count() == 0 and f.with_overlaps(f, "binned").count() == 3000
    assert f.difference(f, "binned").count() == 0
    kept = f.numbered()
    assert kept.size() == 3000
    kept.destroy()


def test_existence_looks_past_the_last_start(spark):
    f = frame(spark, [(1, 100, 0), (5, 6, 0)])
    assert f.has_overlaps(f.one(50, 60)).first()["hit"]


def test_empty_and_null(spark):
    e = IntervalFrame.empty(spark)
    assert e.count(e.one(1, 2)).first()["n"] == 0
    assert e.span().count() == 0
    assert bag(e.gaps(0, 50), "start", "end") == Counter([(0, 50)])
    f = frame(spark, [(1, 5, None), (3, 8, "a")])
    assert f.search_values_batch(f.one(4, 4)).first()["values"] == ["a", None]


def test_from_arrays_refuses_unequal_lengths(spark):
    with pytest.raises(ValueError):
        IntervalFrame.from_arrays(spark, [1], [2, 3])
    with pytest.raises(ValueError):
        IntervalFrame.from_arrays(spark, [1], [2], [1, 2])


def test_set_operators(spark):
    assert bag(frame(spark, [(1, 5, 10), (3, 8, 20), (20, 30, 2)]).merge_overlaps("sum"), "start", "end", "value") == Counter([(1, 8, 30), (20, 30, 2)])
    assert bag(frame(spark, [(1, 5, 0), (6, 10, 0)]).merge_overlaps(), "start", "end") == Counter([(1, 5), (6, 10)])
    assert frame(spark, [(1, 5, "x"), (3, 8, "y")]).merge_overlaps("collect").first()["value"] == ["x", "y"]
    assert frame(spark, [(1, 5, 2), (3, 8, 3)]).merge_overlaps(lambda a, b: a * b).first()["value"] == 6
    assert bag(frame(spark, [(10, 20, 0), (30, 40, 0)]).gaps(0, 50), "start", "end") == Counter([(0, 9), (21, 29), (41, 50)])
    a, b = frame(spark, [(1, 10, 0), (2, 5, 0)]), frame(spark, [(3, 4, 0)])
    assert bag(a.intersection(b), "start", "end") == Counter({(3, 4): 2})
    assert bag(frame(spark, [(1, 10, 0)]).difference(frame(spark, [(4, 6, 0)])), "start", "end") == Counter([(1, 3), (7, 10)])
    assert bag(frame(spark, [(1, 10, 0)]).symmetric_difference(frame(spark, [(5, 15, 0)])), "start", "end") == Counter([(1, 4), (11, 15)])
    assert bag(frame(spark, [(10, 20, 0)]).expand(5, 5), "start", "end") == Counter([(5, 25)])
    assert frame(spark, [(10, 12, 0)]).expand(-5, -5).count() == 0
    assert bag(frame(spark, [(10, 20, 0)]).flank(5, 5), "start", "end") == Counter([(5, 9), (21, 25)])
    assert bag(frame(spark, [(2, 20, 0)]).flank(10, 0, 0), "start", "end") == Counter([(0, 1)])
    u = frame(spark, [(10, 20, 1), (10, 20, 2), (10, 20, 3), (5, 8, 9), (5, 8, 4)])
    assert bag(u.unique(), "start", "end", "value") == Counter([(5, 8, 9), (10, 20, 1)])
    assert bag(u.unique("sum"), "start", "end", "value") == Counter([(5, 8, 13), (10, 20, 6)])


def test_inverted_rows(spark):
    df = spark.createDataFrame([(5, 1, 0), (1, 2, 1)], "start int, end int, value int")
    assert IntervalFrame(df, keys=()).size() == 1
    assert IntervalFrame(df, keys=(), on_inverted="swap").size() == 2
    with pytest.raises(Exception, match="start > end"):
        IntervalFrame(df, keys=(), on_inverted="error").df.collect()


def test_doubles_refuse_integer_operators(spark):
    f = IntervalFrame(spark.createDataFrame([(1.0, 2.0)], "start double, end double"), keys=(), value=None)
    with pytest.raises(TypeError):
        f.expand(1, 1)
    assert f.count(f).first()["n"] == 1


@pytest.mark.parametrize("strategy", ["auto", "equi", "binned", "sweep"])
def test_doubles_equal_brute_force(spark, strategy):
    rng = random.Random(8)
    rows = [(i % 3, x := rng.uniform(-1, 1), x + rng.choice([0.0, 0.01, 0.5, 1e3, float("inf")]), i) for i in range(150)] + [(0, float("-inf"), 0.2, 150), (1, float("nan"), 1.0, 151)]
    f = IntervalFrame(spark.createDataFrame(rows, "contig bigint, start double, end double, ord bigint"), ord="ord")
    want = {q[3]: sum(q[0] == b[0] and b[1] <= q[2] and q[1] <= b[2] for b in rows[:-1]) for q in rows[:-1]}
    assert {r[0]: r[1] for r in f.count(f, strategy).collect()} == want


def _random(spark, rounds, seed):
    rng, rows = random.Random(seed), []
    for c in range(rounds):
        for _ in range(rng.randrange(8)):
            s = rng.randrange(-60, 140)
            wide = rng.random() < 0.05
            rows.append((c, s, 400 if wide else s + rng.randrange(26), len(rows)))
    df = spark.createDataFrame(rows, "contig bigint, start bigint, end bigint, value bigint")
    return IntervalFrame(df, ord="value"), rows


@pytest.mark.parametrize("strategy,width", [("equi", None), ("binned", 1), ("binned", 7), ("binned", 64)])
def test_pairs_equal_brute_force(spark, strategy, width):
    (a, ra), (b, rb) = _random(spark, 120, 1), _random(spark, 120, 2)
    want = Counter((x[3], y[3]) for x in ra for y in rb if x[0] == y[0] and y[1] <= x[2] and x[1] <= y[2])
    assert bag(rangejoin.pairs(a, b, ["value"], strategy, width), "a_value", "b_value") == want


@pytest.mark.parametrize("hot", [False, True])
def test_sweeps_and_set_algebra_equal_brute_force(spark, hot, monkeypatch):
    (a, ra), (b, rb) = _random(spark, 100, 3), _random(spark, 100, 4)
    if hot:  # windows split into ranges
        monkeypatch.setattr(IntervalFrame, "window_parts", lambda self: 9)
        index = lambda f: {r["value"]: r["idx"] for r in f.with_index().collect()}
        split = index(a)
        monkeypatch.setattr(IntervalFrame, "window_parts", lambda self: None)
        assert index(a) == split
        monkeypatch.setattr(IntervalFrame, "window_parts", lambda self: 9)
    n = Counter(x[3] for x in ra for y in rb if x[0] == y[0] and y[1] <= x[2] and x[1] <= y[2])
    assert {r["qid"]: r["n"] for r in b.count(a, "sweep").collect()} == {x[3]: n[x[3]] for x in ra}
    assert {r["qid"]: r["hit"] for r in b.has_overlaps(a).collect()} == {x[3]: n[x[3]] > 0 for x in ra}
    points = lambda rows: {(r[0], p) for r in rows for p in range(r[1], r[2] + 1)}
    pa, pb = points(ra), points(rb)
    got = lambda df: points([tuple(r) for r in df.select("contig", "start", "end").collect()])
    assert got(a.merge_overlaps()) == pa
    assert got(a.union_with(b)) == pa | pb
    assert got(a.intersection(b)) == pa & pb
    assert got(a.difference(b)) == pa - pb
    assert got(a.symmetric_difference(b)) == pa ^ pb
    contigs = {r[0] for r in ra}
    assert got(a.gaps(-60, 200)) == {(c, p) for c in contigs for p in range(-60, 201)} - pa


def test_boxes(spark):
    rng = random.Random(5)
    box = lambda i: (i, x := rng.uniform(-20, 80), x + rng.uniform(0, 30), y := rng.uniform(-20, 80), y + rng.uniform(0, 30))
    a, b = [box(i) for i in range(60)], [box(i) for i in range(80)]
    schema = "qid bigint, x0 double, x1 double, y0 double, y1 double"
    got = {r[0]: r[1] for r in count_2d(spark.createDataFrame(b, schema), spark.createDataFrame(a, schema)).collect()}
    assert got == {q[0]: sum(r[1] <= q[2] and q[1] <= r[2] and r[3] <= q[4] and q[3] <= r[4] for r in b) for q in a}


def test_boxes_of_all_sizes(spark):
    rng = random.Random(9)
    size = lambda: rng.choice([0.0, 0.01, 1.0, 3000.0, 1e6])
    box = lambda i: (i, x := rng.uniform(-50, 50), x + size(), y := rng.uniform(-50, 50), y + size())
    a, b = [box(i) for i in range(70)] + [(70, 0.0, float("inf"), 0.0, 1.0)], [box(i) for i in range(90)]
    schema = "qid bigint, x0 double, x1 double, y0 double, y1 double"
    frames = spark.createDataFrame(b, schema), spark.createDataFrame(a, schema)
    want = {q[0]: sum(r[1] <= q[2] and q[1] <= r[2] and r[3] <= q[4] and q[3] <= r[4] for r in b) for q in a}
    for cell in (None, (0.5, 0.5)):
        assert {r[0]: r[1] for r in count_2d(*frames, cell=cell).collect()} == want


def test_stream_enrichment(spark, tmp_path):
    from spanmill.streaming.enrich import enrich

    spark.createDataFrame([(1, 4), (50, 60)], "s bigint, e bigint").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("s bigint, e bigint").parquet(str(tmp_path / "in"))
    q = enrich(stream, frame(spark, [(3, 9, 1), (55, 56, 2), (0, 10**9, 3)]), "s", "e", width=4).writeStream.format("memory").queryName("enriched").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert {(r["s"], r["b_value"]) for r in spark.table("enriched").collect()} == {(1, 1), (50, 2), (1, 3), (50, 3)}


def _copied(spark, ranges, copies, keyed=False):
    """Ranges that come many times, with NULL payloads among theirs."""
    k = "id div {0} % 2".format(copies) if keyed else "0"
    df = spark.range(ranges * copies).selectExpr(f"{k} AS k", f"CAST(id div {copies} % {ranges} AS DOUBLE) / 4 AS start", f"CAST(id div {copies} % {ranges} AS DOUBLE) / 4 + (id div {copies}) % 9 AS end", "CASE WHEN id % 3 > 0 THEN id END AS value", "id AS ord")
    return IntervalFrame(df, keys=("k",) if keyed else (), ord="ord")


@pytest.mark.parametrize("keyed,group", [(True, 512), (False, 5)])
def test_equal_ranges_are_put_together(spark, keyed, group, monkeypatch):
    monkeypatch.setattr(rangejoin, "GROUP_ROWS", group)
    a, b = _copied(spark, 40, 12, keyed), _copied(spark, 30, 15, keyed)
    sides = [[tuple(r) for r in f.df.select(*(["k"] if keyed else []), "start", "end", "value", "ord").collect()] for f in (a, b)]
    n = int(keyed)
    want = Counter((x[-1], y[-2], y[-1]) for x in sides[0] for y in sides[1] if x[:n] == y[:n] and y[n] <= x[n + 1] and x[n] <= y[n + 1])
    for width in (None, 0.1):  # one level and two
        assert bag(rangejoin.pairs(a, b, None, "grouped", width), "a_ord", "b_value", "b_ord") == want
    got = b.search_values(a, "grouped")
    assert bag(got, "qid", "value") == Counter({(q, v): m for (q, v), m in _summed(want).items()})


def _summed(pairs):
    out = Counter()
    for (q, v, _), m in pairs.items():
        out[q, v] += m
    return out


def test_pairs_of_copies_stay_small_on_disk(spark, tmp_path):
    """F1 of round 2: what is written for dense copies is smaller than with pairs in the order of bins."""
    a, b = _copied(spark, 100, 60), _copied(spark, 100, 60)
    assert rangejoin.choose(a, b, [], True) == "grouped"
    size = {}
    for how in ("auto", "binned"):
        b.search_values(a, how).write.parquet(str(tmp_path / how))
        size[how] = sum(p.stat().st_size for p in (tmp_path / how).glob("*.parquet"))
    assert size["auto"] < size["binned"] * 0.75
    # one range that holds most rows is not worth it
    hot = IntervalFrame(a.df.unionByName(spark.range(60_000).selectExpr("1D AS start", "1D AS end", "id AS value", "id + 1000000 AS ord")), keys=(), ord="ord")
    assert rangejoin.choose(hot, hot, [], True) == "binned"


@pytest.mark.parametrize("hot", [False, True])
def test_existence_makes_no_pairs(spark, hot, monkeypatch):
    """F2 of round 2: a million pairs under one range, and yet every row of either side moves once."""
    if hot:
        monkeypatch.setattr(IntervalFrame, "window_parts", lambda self: 5)
    many = lambda at: spark.range(3000).selectExpr(f"IF(id % 3 = 0, id * 10, {at}) AS start", f"IF(id % 3 = 0, id * 10 + 4, {at} + 3) AS end", "id AS value", "id AS ord")
    a, b = (IntervalFrame(many(at), keys=(), ord="ord") for at in (1, 5))
    b = b._with(b.df.where("start % 20 = 0 OR start = 5"))
    rows = [[tuple(r) for r in f.df.collect()] for f in (a, b)]
    have = {(y[0], y[1]) for y in rows[1]}
    hit = {x[3] for x in rows[0] if any(s <= x[1] and x[0] <= e for s, e in have)}
    got, lack = b.with_overlaps(a), b.without_overlaps(a)
    assert "Join" not in lack._jdf.queryExecution().optimizedPlan().toString() or hot
    assert {tuple(r) for r in got.collect()} == {r for r in rows[0] if r[3] in hit}
    assert {tuple(r) for r in lack.collect()} == {r for r in rows[0] if r[3] not in hit}
    assert got.columns == lack.columns == a.df.columns


def test_existence_of_floating_against_integral(spark):
    a = IntervalFrame(spark.createDataFrame([(1.5, 1.7, 0), (0.5, 1.0, 1)], "start double, end double, ord bigint"), keys=(), ord="ord")
    b = IntervalFrame.from_arrays(spark, [0], [0]).add(1, 1)
    assert {tuple(r) for r in b.has_overlaps(a).collect()} == {(0, False), (1, True)}


def test_windows_over_two_frames_count_both(spark, monkeypatch):
    monkeypatch.setattr("spanmill.frame.HOT_ROWS", 100)
    f = IntervalFrame(spark.range(80).selectExpr("id AS start", "id AS end", "id AS ord"), keys=(), ord="ord")
    assert f.window_parts() is None and f.window_parts_with(f)
    assert f.count(f, "sweep").where("n = 1").count() == f.has_overlaps(f).where("hit").count() == 80
