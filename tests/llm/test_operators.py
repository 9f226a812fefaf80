"""Training-data operators against brute force, and their defined results at the edges."""

import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanmill.llm import decontaminate, embeddings, langid, licenses, minhash, packing, pii, quality, queries, urls, warc

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EDGE = [None, "", " \n ", "a", "A b c", "ÉÀ ñ", "x " * 30_000, "same words here in this text " * 3, "same words here in this text " * 3, "mail me a.b@c.de now", "é +1 (234) 555-2345 4111 1111 1111 1111 1.2.3.4 300.1.1.1 1.1.1.1.5", "1" * 50_000, "a" * 50_000, "a@" * 2_000, "MIT License cc-by Apache License. GNU General Public License"]


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(i, t, "en" if i % 2 else None, None, None) for i, t in enumerate(EDGE)] + [(None, None, None, None, None), (3, "a", "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("_row", "bucket", "n", "node", "component", "_t", "score", "spans", "digest", "label", "word", "size", "host", "path", "kind", "token", "rule", "verdict", "lang_pred", "n_words", "position", "_w", "c0_", "a0_", "item", "block"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


# 1 ---------------------------------------------------------------------------------

BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute_spans(text):
    out = []
    for kind, pattern in BASE:
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii_base_spans(spark, edge):
    short = edge.where("length(text) < 20000 OR text IS NULL").select("doc_id", "text").unionByName(documents(spark).select("doc_id", "text"))
    got = pii.annotate(short, ["doc_id", "text"]).collect()
    assert len(got) == short.count()
    for r in got:
        assert [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] != "context"] == brute_spans(r["text"])
    assert pii.annotate(edge, ["doc_id"]).count() == edge.count()


def brute_contexts(texts):
    """The spans of kind context that the rounds add, per text."""
    tokens, edges, known = [], {}, {}
    for text in texts:
        t, base, own = re.sub("[\t\n\x0b\x0c\r]", " ", text or ""), brute_spans(text), []
        ms = list(re.finditer(r"(?<![^ ])[^ 0-9@]*[0-9@][^ ]*", t))
        for i, m in enumerate(ms):
            before, after = t[ms[i - 1].end() if i else 0 : m.start()].split(), t[m.end() : ms[i + 1].start() if i + 1 < len(ms) else len(t)].split()
            head = len(re.match(r"[^0-9A-Za-z@+]*", m[0])[0])
            core = re.sub(r"[^0-9A-Za-z]+$", "", m[0][head:])
            if not core:
                continue
            left, right = (before[-1:] or [""])[0].lower(), (after[:1] or [""])[0].lower()
            start = m.start() + head
            kind = [k for k, a, b in base if a < start + len(core) and start < b]
            own.append((start, start + len(core), core, bool(kind)))
            for side, context, ok in (("l", left, left), ("r", right, right), ("b", f"{left} {right}", left and right)):
                if ok:
                    edges.setdefault((side, context), Counter())[core] += 1
            if kind:
                known[core] = min(kind + [known.get(core, kind[0])])
        tokens.append(own)
    for _ in range(pii.ROUNDS):
        sure = {}
        for c, seen in edges.items():
            shares = Counter(known[x] for x in seen if x in known)
            kind = min(shares, key=lambda k: (-shares[k], k), default=None)
            if kind and shares[kind] >= pii.SUPPORT and shares[kind] / len(seen) >= pii.CONFIDENT:
                sure[c] = (shares[kind] / len(seen), kind)
        new = {}
        for x in {x for seen in edges.values() for x in seen} - set(known):
            mine = [c for c in edges if x in edges[c]]
            miss = np.prod([1 - min(sure[c][0], 0.95) for c in mine if c in sure] or [1.0])
            inside = max(sum(edges[c][x] for c in mine if c[0] == s and c in sure) / max(1, sum(edges[c][x] for c in mine if c[0] == s)) for s in "lrb")
            if 1 - miss >= pii.ACCEPT and inside >= pii.SHARE:
                new[x] = max((sure[c] for c in mine if c in sure))[1]
        known |= new
    return [sorted({("context", a, b) for a, b, x, seed in own if not seed and x in known}) for own in tokens]


def test_pii_contexts_equal_brute_force(spark):
    rng = random.Random(12)
    words = ["alpha", "beta", "gamma", "delta"]
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).select("doc_id", "text").collect()]
    marks = [("badge", f"u{i}@x{i % 9}.org", "today") for i in range(40)] + [("badge", f"id-{i}x", "today") for i in range(4)] + [("node", f"10.0.{i}.7", "up") for i in range(9)] + [("node", "srv9", "up")]
    marks += [("badge", "4.0", "today")] + [("version", "4.0", rng.choice(words)) for _ in range(8)]  # strays into a sure context once
    rows += [(10**6 + i, " ".join([rng.choice(words), *m, rng.choice(words), f"v{i % 3}.1"])) for i, m in enumerate(marks)]
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in pii.annotate(spark.createDataFrame(rows, "doc_id bigint, text string"), ["doc_id"]).collect()}
    want = brute_contexts([t for _, t in rows])
    assert sum(map(len, want)) == 5
    for (d, t), more in zip(rows, want, strict=True):
        assert got[d] == brute_spans(t) + more


def test_pii_takes_long_texts(spark):
    """Near linear in the tokens of one text, positions and replacement included."""
    took = {}
    for n in (1_000, 10_000, 100_000):
        text = " ".join(f"w{i} x" if i % 50 else f"a{i}@b.org x" for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
        began = time.time()
        got = pii.with_redacted(pii.annotate(df, ["text"]), "text", "spans").first()
        took[n] = time.time() - began
        base = [s for s in got["spans"] if s["kind"] == "email"]
        assert [(s["start"], s["end"]) for s in base] == [m.span() for m in re.finditer(r"a\d+@b\.org", text)]
        assert got["text"].count("[email]") == len(base) and "@" not in got["text"]
    assert took[100_000] <= 12 * took[10_000]


def test_redaction_replaces_overlaps_once(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        text = "".join(rng.choice("aé𝄞\n ") for _ in range(rng.randrange(5000)))
        cuts = [tuple(sorted((rng.randrange(len(text) + 1), rng.randrange(len(text) + 1)))) for _ in range(rng.randrange(6))]
        rows.append((text, [(rng.choice("xy"), a, b) for a, b in cuts if a < b]))
    df = spark.createDataFrame([*rows, (None, [("x", 0, 1)])], "t string, s array<struct<kind:string,start:bigint,end:bigint>>")
    want = []
    for text, spans in rows:
        at, out = 0, ""
        for a, b, k in sorted((a, b, k) for k, a, b in spans):
            if a >= at:
                out += text[at:a] + f"[{k}]"
            at = max(at, b)
        want.append(out + text[at:])
    assert [r["t"] for r in pii.with_redacted(df, "t", "s").collect()] == [*want, None]


def test_pii_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"your badge number {k} please keep") for i, k in enumerate([f"a{i}.b@mail{i}.com" for i in range(12)] + ["zx-77q"])]
    got = {r[0]: r[1] for r in pii.annotate(spark.createDataFrame(rows, "doc_id bigint, text string"), ["doc_id"]).collect()}
    assert [s["kind"] for s in got[12]] == ["context"] and (got[12][0]["start"], got[12][0]["end"]) == (18, 24)
    df = spark.createDataFrame([("é a@b.co x", [("email", 2, 8)])], "t string, s array<struct<kind:string,start:bigint,end:bigint>>")
    assert pii.with_redacted(df, "t", "s").first()["t"] == "é [email] x"


# 2 ---------------------------------------------------------------------------------


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(ids, linked):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in linked:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_minhash_equals_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(vocabulary, k=120)) for _ in range(12)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    texts = [None, "", "a b", "A  b", "c"]
    for t in base:
        w = t.split()
        for k in (0, 0, 1, 2, 4, 6):
            v = list(w)
            for _ in range(k):
                v[rng.randrange(len(v))] = "zz"
            texts.append(" ".join(v))
        texts.append(t + " " + passage)
    hot = base[0].split()
    for _ in range(60):
        v = list(hot)
        v[rng.randrange(120)] = f"q{rng.randrange(10**6)}"
        texts.append(" ".join(v))
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    want = components(sets, [(i, j) for i in sets for j in sets if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])])
    got = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_minhash_of_repeated_ids(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long), (1, long), (2, long + " x"), (3, "short"), (3, "other words"), (None, long), (4, None), (4, None)]
    got = sorted(tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).where("doc_id IS NOT NULL").collect())
    assert got == [(1, 36, 1, True), (1, 36, 1, True), (2, 37, 1, False), (3, 1, 3, True), (3, 1, 3, True), (4, 0, 4, True), (4, 0, 4, True)]


def test_estimate_is_near_the_similarity():
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 2**64, 1000, dtype=np.uint64), rng.integers(0, 2**64, 150, dtype=np.uint64)
    a, b = np.unique(x), np.unique(np.concatenate((x[:850], y)))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(minhash.estimate(minhash.packed(minhash.minima(a)), minhash.packed(minhash.minima(b))) - true) < 0.15


# 3 ---------------------------------------------------------------------------------


def test_differences_of_linked_sets_meet():
    rng = np.random.default_rng(5)
    common = rng.integers(0, 2**63, 400, dtype=np.uint64)
    sets, met, near = [], 0, 0
    for size in (1, 2, 3, 4, 5, 8, 40, 100):
        for _ in range(6):
            base = np.concatenate((rng.choice(common, size), rng.integers(0, 2**63, size, dtype=np.uint64)))
            for drop in range(0, size, max(1, size // 5)):
                sets.append(np.unique(base[drop:]))
    for pivot in (np.empty(0, np.uint64), sets[0], sets[-1], sets[-4]):
        apart = [np.setxor1d(s, pivot) for s in sets]
        slack = [minhash.slack(len(d), len(s)) for d, s in zip(apart, sets, strict=True)]
        counts = np.zeros(minhash.CELLS, np.int64)
        for d in apart:
            np.add.at(counts, minhash._cell(d), 1)
        held = [dict(zip(*(x.tolist() for x in minhash.prefix(d, counts, max(1, -(-(k + min(slack)) // (2 * minhash.WHOLE))))), strict=True)) for d, k in zip(apart, slack, strict=True)]
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                needed = slack[i] + slack[j]
                if needed <= 0:
                    near += 1
                    assert minhash.linked(a.tobytes(), b.tobytes())
                elif minhash.linked(a.tobytes(), b.tobytes()):
                    met += 1
                    assert any(2 * minhash.WHOLE * min(n, held[j].get(g, 0)) >= needed for g, n in held[i].items())
    assert met > 200 and near > 5


def test_minhash_of_unlinked_copies(spark):
    """One large group around a text, with members too far from most others, and pairs of such members that are linked."""
    rng = random.Random(6)
    base, texts = [f"b{i}" for i in range(150)], []
    for i in range(260):
        v = list(base)
        for _ in range(i % 9):
            v[rng.randrange(150)] = f"q{rng.randrange(10**6)}"
        texts.append(" ".join(v))
        if i % 9 == 8 and i % 2:
            v[3] = "other"
            texts.append(" ".join(v))
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    want = components(sets, [(i, j) for i in sets for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])])
    assert 20 < len(set(want.values())) < 200
    got = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(8, 16))
    v = [list(map(float, centers[i % 8] + rng.normal(size=16) * (0.05 + 0.3 * (i % 5 == 0)))) for i in range(400)]
    v += [v[0], [2 * x for x in v[1]], None, [0.0] * 16, [float("nan")] * 16, [None] * 16, []]
    ok = {i: np.array(x) for i, x in enumerate(v) if x and None not in x and np.isfinite(x).all() and any(x)}
    u = {i: x / np.linalg.norm(x) for i, x in ok.items()}
    pairs = [(i, j) for i in u for j in u if i < j and u[i] @ u[j] >= 0.9]
    want = components(range(len(v)), pairs)
    n = {i: sum(i in p for p in pairs) for i in range(len(v))}
    got = embeddings.near_duplicates(spark.createDataFrame(list(enumerate(v)), "vec_id bigint, embedding array<double>")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == {i: (n[i], want[i], want[i] == i) for i in range(len(v))}


def test_embeddings_of_repeated_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.1]), (None, [1.0, 0.0]), (3, [0.0, 1.0]), (3, [-1.0, 0.0])]
    got = sorted(tuple(r) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).where("vec_id IS NOT NULL").collect())
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (3, 0, 3, True)]


@pytest.mark.parametrize("d", [2, 16, 64, 200])
def test_tiles_lose_no_link(d):
    rng = np.random.default_rng(d)
    a = rng.normal(size=(150, d))
    b = np.concatenate((a[:60] + rng.normal(size=(60, d)) * 0.4, rng.normal(size=(90, d))))
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    both = np.concatenate((a, b))
    _, v = np.linalg.eigh(both.T @ both)
    v = v[:, ::-1]
    steps = embeddings.leading(((both @ v) ** 2).mean(0))
    i, j = embeddings.tile_links(a, b, v, steps, 0.9, False)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(a @ b.T >= 0.9)), strict=True))
    i, j = embeddings.tile_links(b, b, v, steps, 0.9, True)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(np.triu(b @ b.T >= 0.9, 1))), strict=True))


# 4 ---------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    html = ["x" * 200, "x" * 200, "short", "short", None, "é\r\n\r\nWARC/1.1\r\n" * 20, "x" * 200]
    pages = spark.createDataFrame([(i + 5, None if i == 3 else f"http://a/{i}\r\n", h) for i, h in enumerate(html)], "page_id bigint, url string, html string")
    got = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    for i, h in enumerate(html):
        r, b = got[i + 5], (h or "").encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(b), hashlib.sha256(b).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", 5) if i in (1, 6) else ("response", None))
        assert r["payload"] is None if i in (1, 6) else bytes(r["payload"]) == b
        assert r["url"] == ("" if i == 3 else f"http://a/{i}\r\n")
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_of_repeated_pages(spark):
    a, b = "a" * 150, "b" * 150
    rows = [(7, "u", a), (7, "u", a), (7, "t", a), (9, "u", a), (None, "u", a), (None, "u", b), (None, "u", b), (3, "u", "tiny"), (3, "u", "tiny")]
    got = Counter((r["page_id"], r["url"], r["payload_digest"][:4], r["record_type"], r["refers_to"]) for r in warc.round_trip(spark.createDataFrame(rows, "page_id bigint, url string, html string"), payloads=False).collect())
    x, y, z = (hashlib.sha256(t.encode()).hexdigest()[:4] for t in (a, b, "tiny"))
    assert got == Counter({(7, "t", x, "response", None): 1, (7, "u", x, "revisit", 7): 2, (9, "u", x, "revisit", 7): 1, (None, "u", x, "revisit", 7): 1, (None, "u", y, "response", None): 1, (None, "u", y, "revisit", None): 1, (3, "u", z, "response", None): 2})
    same = warc.round_trip(spark.createDataFrame(rows[:2], "page_id bigint, url string, html string"), payloads=False).collect()
    assert sorted(r["record_type"] for r in same) == ["response", "revisit"]


def test_revisits_name_their_response():
    one, two = (warc.parse(warc.record(p, "u", b"x" * 120, 120, "ab", p == 2, 1 if p == 2 else None))[0] for p in (1, 2))
    assert two["WARC-Refers-To"] == one["WARC-Record-ID"] != two["WARC-Record-ID"]


def test_ranges_join_neighbours():
    assert warc.ranges([(0, 10), (10, 5), (10**6, 7)]) == [(0, 15, [(0, 10), (10, 5)]), (10**6, 10**6 + 7, [(10**6, 7)])]


# 5, 9 ------------------------------------------------------------------------------


def test_language_is_learned(spark, edge):
    docs = documents(spark)
    got = queries.op5_langid(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang_pred <> 'und'").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.97 * len(got) > 10
    profiles = langid.learn(docs)
    out = {r[0]: r for r in langid.identify(edge, profiles, ["doc_id"]).collect()}
    assert out[0]["lang_pred"] == out[1]["lang_pred"] == out[11]["lang_pred"] == "und" and all(0 <= r["score"] <= 1 for r in out.values())
    assert {r["lang_pred"] for r in langid.identify(edge, langid.learn(docs.limit(0)), ["doc_id"]).collect()} == {"und"}


def brute_grams(text):
    c = Counter()
    for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
        w = f" {w} "
        c.update(w[i : i + n] for n in (1, 2, 3) for i in range(len(w) - n + 1) if n > 1 or w[i] != " ")
    return c


def test_language_distances_equal_brute_force(spark):
    """Distances up to the order of equally frequent n-grams; by the matrix and by the join."""
    texts = [(0, "aaa aa bbb aa ab", "x"), (1, "bb bb ba bbbb", "y"), (2, "ccc cab abc", "z"), (3, "aab", None), (4, "bbc", None), (5, "123", None), (6, None, None), (7, "ç", None)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, lang string")
    profiles = langid.learn(docs)
    table = langid.learn(docs, most=1)
    small = langid.identify(docs, profiles, ["doc_id"]).collect()
    assert sorted(map(tuple, small)) == sorted(map(tuple, langid.identify(docs, table, ["doc_id"]).collect()))
    assert {k: len(v) for k, v in profiles.items()} == {lang: len(brute_grams(t)) for _, t, lang in texts if lang}
    model = langid.Profiles(profiles)
    for r in small:
        own = langid.ranked(texts[r["doc_id"]][1])
        assert len(own) == len(brute_grams(texts[r["doc_id"]][1]))
        if len(own):
            d = sorted((sum(abs(k - profiles[lang].index(g)) if g in profiles[lang] else langid.TOP for k, g in enumerate(own.tolist())), lang) for lang in model.langs)
            assert (r["lang_pred"], r["score"]) == (d[0][1], (d[1][0] - d[0][0]) / d[1][0])
        else:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert langid._letters()[0x30000] and langid._letters()[ord("a")] and not langid._letters()[ord("1")]


def test_quality_scores_are_table_sums(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, len(quality.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] * x[:, 2] > 0.3)).astype(float)
    m = quality.fit(x, y)
    got = m.score(x[:50])
    for row, p in zip(x, got, strict=False):
        z = m.intercept + sum(m.tables[k][sum(e <= row[k] for e in m.edges[k])] for k in range(x.shape[1]))
        z += sum(t[sum(e <= row[i] for e in m.pair_edges[i]), sum(e <= row[j] for e in m.pair_edges[j])] for (i, j), t in zip(m.pairs, m.pair_tables, strict=True))
        assert abs(p - 1 / (1 + np.exp(-z))) < 1e-9
    assert np.mean((m.score(x) >= 0.5) == y) > 0.9
    rows = [(1, "b text"), (1, "a text"), (2, "c!"), (2, "c!")]
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "doc_id bigint, quality int")
    first, again = (quality.train(d, labels).score(x[:3]).tolist() for d in (docs, docs.orderBy("text")))
    assert first == again


def test_quality_is_learned(spark, edge):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = queries.op9_quality(spark, DATA).join(labels, "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) >= 0.9
    model = quality.train(documents(spark), labels)
    assert all(0 <= r["score"] <= 1 for r in quality.score(edge, model, ["doc_id"]).collect())
    assert {r["score"] for r in quality.score(edge, quality.train(edge, labels.limit(0)), ["doc_id"]).collect()} == {0.5}


# 6 ---------------------------------------------------------------------------------


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("max_set", [decontaminate.MAX_SET, 1])
def test_decontamination_equals_brute_force(spark, edge, max_set):
    items = [(1, "same words here in"), (2, "Mail ME"), (3, None), (4, " ".join(f"t{i}" for i in range(25))), (5, "x")]
    extra = [(100, "t3 T4 t5 t6 t7 t8 t9, t10 t11 t12 t13 zz t3"), (101, "t1 t2 t3")]
    docs = edge.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id bigint, text string"))
    got = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id bigint, text string"), columns=("doc_id", "text"), max_set=max_set).collect()
    assert len(got) == docs.count()
    for r in got:
        w, hit, found = words(r["text"]), set(), set()
        for i, t in items:
            v = words(t)
            m = min(10, len(v))
            windows = {tuple(v[k : k + m]) for k in range(len(v) - m + 1)} if v else set()
            for k in range(len(w) - m + 1) if v else []:
                if tuple(w[k : k + m]) in windows:
                    hit |= set(range(k, k + m))
                    found.add(i)
        assert (r["n_words"], r["n_hit"], r["item_ids"]) == (len(w), len(hit), sorted(found))


# 7 ---------------------------------------------------------------------------------


def test_license_scan(spark, edge):
    extra = [(100, "Licensed under the Apache License, Version 2.0."), (101, "Released under the MIT License."), (102, "licensed under CC BY-NC 4.0."), (103, "this version 2 of the licensed general text")]
    docs = edge.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id bigint, text string"))
    for r in licenses.scan(docs, ["doc_id", "text"]).collect():
        w = words(r["text"])
        at = sorted((i, label) for p, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, sorted({x for _, x in at}))
        assert 0 <= r["score"] <= 1 and set(r["base_labels"]) <= set(r["labels"])
        if (r["doc_id"] or 0) >= 100:
            assert set(r["labels"]) - set(r["base_labels"]) == [{"apache-2.0"}, {"mit-statement"}, {"cc-by-nc-4.0"}, set()][r["doc_id"] - 100]


def test_license_labels_equal_brute_force(spark, edge):
    """Statements: at least two anchors agree and the key phrase stands at its place."""
    rng = random.Random(2)
    pool = [w for t in licenses.TEMPLATES if not t.drift for w in t.words] + ["thing"] * 20
    rows = [(i, " ".join(rng.choice(["a", "b", *t.words]) if rng.random() < 0.15 else w for w in t.words)) for i in range(20) for t in licenses.TEMPLATES if not t.drift]
    rows += [(1000 + i, " ".join(rng.choices(pool, k=60))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    idf = licenses.word_idf(docs)
    n = 0
    for r in licenses.scan(docs, ["text"]).collect():
        w, want = words(r["text"]), set()
        for t in licenses.TEMPLATES:
            if not t.drift:
                (key, at), = t.keys
                for b in range(-len(t.words), len(w)):
                    agree = {x for x in licenses.anchors(t, idf) for i, y in enumerate(t.words) if x == y and 0 <= b + i < len(w) and w[b + i] == x}
                    if len(agree) >= 2 and b + at >= 0 and tuple(w[b + at : b + at + len(key)]) == key:
                        want.add(t.label)
        n += len(want)
        texts = {t.label for t in licenses.TEMPLATES if t.drift}
        assert set(r["labels"]) - set(r["base_labels"]) - texts <= want and want <= set(r["labels"])
    assert n > 50


def test_license_texts_are_found(spark):
    rng = random.Random(3)
    rows = []
    for k, (_, text, _) in enumerate(licenses.TEXTS):
        w = text.split()
        rows += [(k, text), (k, "lorem 1 ipsum " * 30 + text.upper() + " dolor" * 9), (k, "one more " + " ".join(w[:-6])), (100, " ".join(rng.sample(w, len(w))))]
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string"), ["doc_id"]).collect():
        if r["doc_id"] < 100:
            assert licenses.TEXTS[r["doc_id"]][0] in r["labels"] and r["score"] > 0.5
        else:
            assert not {t[0] for t in licenses.TEXTS} & set(r["labels"])


def test_license_scan_takes_long_texts(spark):
    took = {}
    for n in (1_000, 10_000, 100_000):
        df = spark.createDataFrame([(1, "Licensed under the Apache License, Version 2.0 and so on. " * (n // 10))], "doc_id bigint, text string")
        began = time.time()
        r = licenses.scan(df, ["doc_id"]).first()
        took[n] = time.time() - began
        assert (r["n_base"], r["last_word"], "apache-2.0" in r["labels"]) == (n // 10, (n // 10 - 1) * 11 + 3, True)
    assert took[100_000] <= 12 * took[10_000]


# 8 ---------------------------------------------------------------------------------


def test_url_rules_and_mined_rules(spark):
    given = [("http://A.example.NET/en/1?x", "a.example.net", "/en/1", "example.net/en/", "allow"), ("http://x.net/de/", "x.net", "/de/", "net/", "block"), ("https://net/", "net", "/", "net/", "block"), ("http://x.net", "x.net", "", None, None), ("nothing", "", "", None, "allow"), (None, "", "", None, "allow"), ("a://b://c/d", "b:", "//c/d", None, None), ("http://m.org/fr/#a", "m.org", "/fr/", "org/fr/", "allow")]
    rows = [(i, u) for i, (u, *_) in enumerate(given)] + [(100 + i, f"http://h{i}.net/bad/{i}") for i in range(60)] + [(300, "http://q.com/bad/7")]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id bigint, url string"), ["page_id"]).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(given):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule) and verdict in (None, got[i]["verdict"])
    assert got[300]["rule"] is None and got[300]["verdict"] == "block"


def brute_verdicts(given, support, confidence):
    """All frequent rules over tokens, the surest that a URL contains whole."""
    labelled = [(t, v) for t, v, rule in given if rule]
    rules = {}
    for t, _ in labelled:
        for k in range(1, len(t) + 1):
            for a in itertools.combinations(sorted(t), k):
                if a not in rules:
                    n = Counter(v for u, v in labelled if set(a) <= set(u))
                    rules[a] = max(((m / sum(n.values()), v) for v, m in n.items() if m >= support * len(labelled) and m >= confidence * sum(n.values())), default=None)
    out = []
    for t, v, rule in given:
        best = max((r for a, r in rules.items() if r and set(a) <= set(t)), default=None)
        out.append(v if rule else best[1] if best else "allow")
    return out


@pytest.mark.parametrize("max_rules", [urls.MAX_RULES, 0])
def test_mined_verdicts_equal_brute_force(spark, max_rules):
    rng = random.Random(11)
    rows = [(i, f"http://{rng.choice('abc')}.{rng.choice(['net', 'org', 'com', 'example.com'])}/{rng.choice(['en', 'fr', 'de'])}/{rng.choice(['x', 'y'])}?{rng.choice(['q', 'p'])}=1") for i in range(300)]
    df = spark.createDataFrame(rows, "page_id bigint, url string")
    host, path, query = urls.parts(F.col("url"))
    plain = df.select("page_id", urls.tokens(host, path, query).alias("t"), urls.fitting_rule(host, path).alias("f")).orderBy("page_id").collect()
    given = [(r["t"], r["f"] and r["f"]["verdict"], r["f"]) for r in plain]
    got = [r["verdict"] for r in urls.judge(df, ["page_id"], min_support=0.05, max_rules=max_rules).orderBy("page_id").collect()]
    assert got == brute_verdicts(given, 0.05, urls.MIN_CONFIDENCE) and len(set(got)) == 2


def test_urls_of_one_long_family(spark):
    """Forty tokens that come together are one item, not 2**40 sets; repeated rows and a very long url are judged each."""
    path = "/".join(f"part{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40))
    rows = [(i, f"http://h.net/{path}/{'x' if i % 2 else 'y'}") for i in range(50)] + [(99, f"http://q.com/{path}")] * 2 + [(100, "http://q.org/" + "z/" * 50_000)]
    got = urls.judge(spark.createDataFrame(rows, "page_id bigint, url string"), ["page_id"]).collect()
    assert len(got) == 53 and [r["verdict"] for r in got if r["page_id"] == 99] == ["block"] * 2


# 10 --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_vocabulary())


def test_packing(spark, edge, library):
    extra = spark.createDataFrame([(2 * 10**6, "a <|endoftext|> b<|endoftext|>"), (2 * 10**6 + 1, "<|endoftext|>" * 3000), (2 * 10**6 + 2, "tie"), (2 * 10**6 + 3, "tie")], "doc_id bigint, text string")
    docs = documents(spark).select("doc_id", "text").unionByName(edge.select((F.col("doc_id") + 10**6).alias("doc_id"), "text").dropDuplicates(["doc_id"])).unionByName(extra)
    texts = {r[0]: r[1] or "" for r in docs.collect()}
    rows = packing.pack_documents(docs).collect()
    by, seqs = {}, {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        seqs.setdefault(r["sequence_id"], []).append(r)
    assert set(by) == set(texts)
    for d, got in by.items():
        ids = library.encode(texts[d], add_special_tokens=False).ids + [0]
        got.sort(key=lambda r: r["piece"])
        assert [r["length"] for r in got] == packing.cut_lengths(len(ids)) and [r["start"] for r in got] == list(np.cumsum([0, *(r["length"] for r in got[:-1])]))
        for r in got:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    check_sequences(seqs.values())
    assert len(seqs) <= 1.01 * sum(r["length"] for r in rows) / 2048 + 1


def check_sequences(seqs):
    for got in seqs:
        got.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in got] == list(np.cumsum([0, *(r["length"] for r in got[:-1])])) and sum(r["length"] for r in got) <= 2048


def test_repeated_documents_are_packed_each(spark):
    rows = packing.pack_documents(spark.createDataFrame([(1, "same words"), (1, "same words"), (None, None)], "doc_id bigint, text string")).collect()
    assert len(rows) == 3 and len({r["sequence_id"] for r in rows}) == 1
    check_sequences([rows])


@pytest.mark.parametrize("lengths", ["1100", "1025 + id % 900", "1 + id * 7919 % 2048", "CASE WHEN id % 5000 = 0 THEN 1024 ELSE 1024 + id % 3 END"])
def test_blocks_are_merged_by_few_bins(spark, lengths):
    """100,000 pieces in 40 blocks: what a block sends on is bounded, and small blocks together pack within 2 % of one."""
    items = spark.range(100_000).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", f"CAST({lengths} AS BIGINT) AS length", "0L AS ids_crc32")
    path = packing.cut(items, "items")
    got = packing.pack(path, block=2500).toPandas()
    sums = got.groupby("sequence_id")["length"].sum()
    assert len(got) == 100_000 and sums.max() <= 2048
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id")["length"].cumsum() - ordered["length"] == ordered["offset"]).all()
    _, _, best = packing.best_fit(got["length"].tolist())
    assert len(sums) <= 1.02 * len(best) + 1
    assert sum(packing.rooms(best, 2048, 2040, 8)) <= 8 * 2040 + 1


@pytest.mark.parametrize("text", ["a  b", "a   b", " a", "a ", "a \n b", "it's I'll x", "tab\tx", "é  ñ 12a³", "…“q” – x", "\x1c x", "日本 go", "<|endoftext|>", "x<|endoftext|> y", "a\n\n  b \n", "\U000e0100x", " " * 9000, "a" * 9000])
def test_ids_are_the_librarys(text, library):
    assert np.frombuffer(packing.encoder(packing.default_vocabulary()).encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_ids_of_random_texts_are_the_librarys(library):
    rng, enc = random.Random(5), packing.encoder(packing.default_vocabulary())
    tokens = sorted(library.get_vocab())
    made = ["".join(rng.choice(tokens).replace("Ġ", " ").replace("Ċ", "\n") for _ in range(rng.randrange(1, 15))) for _ in range(5000)]
    made += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0xD800), rng.randrange(0xE000, 0x20000)])) for _ in range(12)) for _ in range(5000)]
    for t, want in zip(made, library.encode_batch(made, add_special_tokens=False), strict=True):
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == want.ids


# all -------------------------------------------------------------------------------


def test_empty_tables(spark, edge):
    none = edge.limit(0)
    items = spark.createDataFrame([], "item_id bigint, text string")
    pages = spark.createDataFrame([], "page_id bigint, url string")
    assert pii.annotate(none, ["doc_id"]).count() == minhash.near_duplicates(none).count() == licenses.scan(none, ["doc_id"]).count() == 0
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
    assert decontaminate.contamination(none, items).count() == urls.judge(pages, ["page_id"]).count() == packing.pack_documents(none).count() == 0
    assert decontaminate.contamination(edge, items).where("n_hit > 0").count() == 0


def test_columns_of_any_name(spark, edge):
    """Every column, whatever its name, comes back beside what an operator adds; repeated rows, too."""
    docs = edge.where("length(text) < 20000 OR text IS NULL")
    n, cols = docs.count(), docs.columns
    items = spark.createDataFrame([(1, "same words here in"), (1, "same words here in")], "item_id bigint, text string")
    pages = docs.withColumn("url", F.concat(F.lit("http://a.net/"), F.col("doc_id")))
    model, profiles = quality.Gam(), {"en": [1]}
    made = [pii.annotate(docs, cols), licenses.scan(docs, cols), decontaminate.contamination(docs, items, columns=tuple(cols)), urls.judge(pages, pages.columns), langid.identify(docs, profiles, cols), quality.score(docs, model, cols)]
    for out in made:
        assert out.count() == n and out.columns[: len(cols)] == cols
    assert minhash.near_duplicates(docs).count() == n <= packing.pack_documents(docs).count()
    assert warc.round_trip(docs.withColumns({"page_id": F.col("doc_id"), "url": F.lit("u"), "html": F.col("text")})).count() == n


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    want = con.execute(queries.ORACLE[name])
    names = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(names)
    assert Counter(tuple(r) for r in got.select(names).collect()) == Counter(want.fetchall())


def test_pipeline_equals_brute_force(spark, library):
    """All stages over the small documents, stage by stage in plain Python."""
    import corpus_pipeline as p

    rows = [(r["doc_id"], r["text"]) for r in documents(spark).select("doc_id", "text").collect()]
    rows = [(d, t) for d, t in rows if brute_grams(t)]
    sets = {d: shingles(t) for d, t in rows}
    near = components(sets, [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    rows = [(d, t) for d, t in rows if near[d] == d]
    windows = set()
    for (t,) in spark.read.parquet(f"{DATA}/benchmark.parquet").select("text").collect():
        w = words(t)
        windows |= {tuple(w[i : i + min(10, len(w))]) for i in range(len(w) - min(10, len(w)) + 1)} if w else set()
    sizes = {len(x) for x in windows}
    rows = [(d, t) for d, t in rows if not any(tuple(w[i : i + m]) in windows for w in [words(t)] for m in sizes for i in range(len(w) - m + 1))]
    want = Counter()
    for (d, t), more in zip(rows, brute_contexts([t for _, t in rows]), strict=True):
        at, out = 0, ""
        for a, b, k in sorted((a, b, k) for k, a, b in brute_spans(t) + more):
            out, at = (out + t[at:a] + f"[{k}]" if a >= at else out), max(at, b)
        ids, start = library.encode(out + t[at:], add_special_tokens=False).ids + [0], 0
        for k, n in enumerate(packing.cut_lengths(len(ids))):
            want[d, k, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())] += 1
            start += n
    got = p.run(spark, DATA).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append(r)
    check_sequences(seqs.values())


def test_pipeline_on_edges(spark, edge):
    import corpus_pipeline as p

    docs = edge
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        docs = out
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert 0 not in left and 8 not in left and "[email]" in left[9]
    assert p.pack(spark, docs, DATA).count() >= len(left)
