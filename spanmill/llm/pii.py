"""Personal data by bootstrapped contextual extraction (operator 1), DataFrame functions only.

Base patterns give the seeds. Every identifier-like token (one with a digit or an @)
has contexts: its left word, its right word and both together. Tokens and contexts
form a graph, scored in rounds. A context's confidence is the largest share of its
different tokens that are known to be of one kind (at least ``SUPPORT`` of them). A
token's score is the noisy-or of its confident contexts; it becomes known, with their
kind, when that reaches ``ACCEPT`` and when at least ``SHARE`` of its occurrences stand
in such contexts, so that a version number which strays into one stays unknown.
Occurrences of known tokens that no base span covers are added as kind ``context``.

Positions are code points, ends exclusive. Positions, overlaps and replacements take a
number of steps in proportion to n log n, for texts of any length. NULL texts are empty
and have no spans. Repeated rows each get their own result; ties between kinds go to the
first by name. Columns of any name may be carried. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.llm.common import Scratch, blocks, counted, cut, part, running_max, running_min, running_total, sealed, small

#: The kinds, in order, and their patterns. Lookbehinds and possessive
#: quantifiers only spare the engine retries that cannot succeed.
KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$"
#: White space becomes plain spaces, one for one, before words are told apart.
_BLANKS = "\t\n\x0b\x0c\r"
#: A word with a digit or an @, in such a text.
TOKEN = r"(?<![^ ])[^ 0-9@]*+[0-9@][^ ]*+"
ROUNDS, SUPPORT, CONFIDENT, ACCEPT, SHARE = 2, 3, 0.8, 0.97, 0.5


def located(pieces: Column, found: Column) -> Column:
    """array<struct<start, end, found>>: the matches ``found``, and the ``pieces`` between them, which give the positions."""
    lengths = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: (F.length(p) + F.length(m)).cast("bigint"))
    return F.zip_with(running_total(lengths), found, lambda end, m: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("found")))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def value(i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


_FOUND = "array<struct<kind:string,start:bigint,end:bigint,found:string>>"


def with_base_spans(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: array<struct<kind, start, end, found>> of the base patterns, by kind and start."""
    t = F.col(text)
    digit = t.rlike("[0-9]")
    present = {"email": F.contains(t, F.lit("@")), "ip": digit, "card": digit, "phone": F.contains(t, F.lit("+"))}
    valid = {
        "email": lambda m: F.lit(True),
        "ip": lambda m: m.rlike(_OCTETS),
        "card": lambda m: F.length(_digits(m)).between(13, 19) & luhn(_digits(m)),
        "phone": lambda m: F.length(_digits(m)).between(9, 15),
    }
    # each text is matched once for each kind: what comes of it is a column before it is used again
    df = df.withColumns({f"_m_{k}": F.when(present[k], F.regexp_extract_all(t, F.lit(PATTERNS[k]), F.lit(0))) for k in KINDS})
    df = df.withColumns({f"_p_{k}": F.when(F.size(f"_m_{k}") > 0, F.split(t, PATTERNS[k], -1)) for k in KINDS})

    def of(kind: str) -> Column:
        good = F.filter(located(F.col(f"_p_{kind}"), F.col(f"_m_{kind}")), lambda x: valid[kind](x["found"]))
        named = F.transform(good, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["found"].alias("found")))
        return F.when(F.size(f"_m_{kind}") > 0, named).otherwise(F.array().cast(_FOUND))

    return df.withColumn(out, F.concat(*map(of, KINDS))).drop(*[f"_{x}_{k}" for x in "mp" for k in KINDS])


def with_tokens(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: identifier-like tokens with their neighbouring words, array<struct<start, end, token, left, right>>; NULL without any."""
    df = df.withColumn("_u", F.when(F.col(text).rlike("[0-9@]"), F.translate(F.col(text), _BLANKS, " " * len(_BLANKS))))
    df = df.withColumn("_m", F.regexp_extract_all("_u", F.lit(TOKEN), F.lit(0)))
    df = df.withColumn("_p", F.when(F.size("_m") > 0, F.split("_u", TOKEN, -1)))
    df = df.withColumn("_at", F.when(F.size("_m") > 0, located(F.col("_p"), F.col("_m"))))
    left = F.transform(F.slice("_p", F.lit(1), F.size("_m")), lambda b: F.lower(F.substring_index(F.rtrim(b), " ", -1)))
    right = F.transform(F.slice("_p", F.lit(2), F.size("_m")), lambda a: F.lower(F.substring_index(F.ltrim(a), " ", 1)))

    def one(x: Column, words: Column) -> Column:
        head = F.length(F.regexp_extract(x["found"], r"^[^0-9A-Za-z@+]*", 0))
        core = F.regexp_replace(F.substr(x["found"], head + 1), r"[^0-9A-Za-z]+$", "")
        start = x["start"] + head
        return F.struct(start.alias("start"), (start + F.length(core)).alias("end"), core.alias("token"), words["l"].alias("left"), words["r"].alias("right"))

    words = F.zip_with(left, right, lambda x, y: F.struct(x.alias("l"), y.alias("r")))
    tokens = F.filter(F.zip_with("_at", words, one), lambda x: x["token"] != "")
    return df.withColumn(out, F.when(F.size("_m") > 0, tokens)).drop("_u", "_m", "_p", "_at")


def seeded(tokens: str, base: str) -> Column:
    """The tokens with the kind of a base span that overlaps them, NULL where none does: by running maxima over both in order of their starts."""
    spans = F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("is"), b["end"].alias("end"), b["kind"].alias("kind"), F.lit(None).cast("string").alias("token"), F.lit(None).cast("string").alias("left"), F.lit(None).cast("string").alias("right")))
    own = F.transform(tokens, lambda t: F.struct(t["start"].alias("start"), F.lit(1).alias("is"), t["end"].alias("end"), F.lit(None).cast("string").alias("kind"), t["token"].alias("token"), t["left"].alias("left"), t["right"].alias("right")))
    return F.sort_array(F.concat(spans, own))


def _with_kinds(df: DataFrame, tokens: str, base: str, out: str) -> DataFrame:
    df = df.withColumn("_e", seeded(tokens, base))
    before = running_max(F.transform("_e", lambda e: F.when(e["is"] == 0, F.struct(e["end"].alias("at"), e["kind"].alias("kind")))))
    after = F.reverse(running_min(F.reverse(F.transform("_e", lambda e: F.when(e["is"] == 0, F.struct(e["start"].alias("at"), e["kind"].alias("kind")))))))
    df = df.withColumns({"_b": before, "_a": after})
    near = F.zip_with("_b", "_a", lambda b, a: F.struct(b.alias("b"), a.alias("a")))

    def one(e: Column, x: Column) -> Column:
        kind = F.when(x["b"]["at"] > e["start"], x["b"]["kind"]).when(x["a"]["at"] < e["end"], x["a"]["kind"])
        return F.when(e["is"] == 1, F.struct(e["start"].alias("start"), e["end"].alias("end"), e["token"].alias("token"), e["left"].alias("left"), e["right"].alias("right"), kind.alias("kind")))

    return df.withColumn(out, F.filter(F.zip_with("_e", near, one), lambda x: x.isNotNull())).drop("_e", "_b", "_a")


def grown(edges: DataFrame, known: DataFrame) -> DataFrame:
    """One round: tokens (token, kind) that the confident contexts of the known ones add. ``edges``: side, context, token, n."""
    marked = edges.join(known, "token", "left")
    shares = [F.struct((F.count_if(F.col("kind") == k) / F.count("*")).alias("conf"), F.count_if(F.col("kind") == k).alias("support"), F.lit(k).alias("as")) for k in sorted(KINDS, reverse=True)]
    scored = marked.groupBy("side", "context").agg(F.greatest(*shares).alias("x")).where((F.col("x.support") >= SUPPORT) & (F.col("x.conf") >= CONFIDENT))
    scored = small(*counted(scored.select("side", "context", "x.conf", "x.as"), "contexts"))
    unseen = marked.where("kind IS NULL").join(scored, ["side", "context"], "left")
    inside = F.greatest(*[F.coalesce(F.sum(F.when((F.col("side") == s) & F.col("conf").isNotNull(), F.col("n"))) / F.sum(F.when(F.col("side") == s, F.col("n"))), F.lit(0.0)) for s in "lrb"])
    score = 1 - F.exp(F.coalesce(F.sum(F.log(1 - F.least(F.col("conf"), F.lit(0.95)))), F.lit(0.0)))
    per = unseen.groupBy("token").agg(score.alias("score"), inside.alias("inside"), F.max_by("as", F.struct("conf", "as")).alias("kind"))
    return per.where((F.col("score") >= ACCEPT) & (F.col("inside") >= SHARE)).select("token", "kind")


def annotate(docs: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """``columns`` of every row with ``spans``: array<struct<kind, start, end>>, base kinds first."""
    df, names, (body,) = sealed(docs, columns, text)
    scan = df.select(*names, F.coalesce(F.col(body), F.lit("")).alias("_t"), F.monotonically_increasing_id().alias("_row"))
    scan = _with_kinds(with_tokens(with_base_spans(scan, "_t", "_base"), "_t", "_tokens"), "_tokens", "_base", "_tokens")
    scan = cut(scan.drop("_t"), "scanned")
    with Scratch(docs.sparkSession) as scratch:
        seen = scan.where(F.size("_tokens") > 0).select("_row", F.inline("_tokens"))
        sides = [F.when(ok, F.struct(F.lit(s).alias("side"), x.alias("context"))) for s, x, ok in (("l", F.col("left"), F.col("left") != ""), ("r", F.col("right"), F.col("right") != ""), ("b", F.concat("left", F.lit(" "), "right"), (F.col("left") != "") & (F.col("right") != "")))]
        edges = seen.select("token", F.inline(F.filter(F.array(*sides), lambda x: x.isNotNull()))).groupBy("side", "context", "token").agg(F.count("*").alias("n"))
        edges = cut(edges, "graph")
        known = cut(seen.where("kind IS NOT NULL").groupBy("token").agg(F.min("kind").alias("kind")), "known")
        for _ in range(ROUNDS):
            known, n = counted(known.unionByName(grown(edges, known)), "known")
        more = seen.where("kind IS NULL").select("_row", "token", "start", "end").join(small(known, n), "token", "left_semi").groupBy("_row").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_more"))
        more, n = counted(more, "found")
        scratch.keep(more)
    out = scan.drop("_tokens").join(small(more, n), "_row", "left")
    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    base = F.transform("_base", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    extra = F.transform("_more", lambda x: F.struct(F.lit("context").alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    out = out.select(*names, F.concat(base.cast(span), F.coalesce(extra.cast(span), F.array().cast(span))).alias("_spans"))
    return out.toDF(*columns, "spans")


def with_redacted(df: DataFrame, text: str, spans: str, mask: str = "[{}]") -> DataFrame:
    """``text`` with every span replaced by its kind; what overlaps is replaced once. NULL texts stay."""
    before, after = mask.split("{}")
    ordered = F.sort_array(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    df = df.withColumn("_s", F.when((F.size(spans) > 0) & F.col(text).isNotNull(), ordered))
    df = df.withColumns({"_k": blocks(F.when(F.col("_s").isNotNull(), F.col(text))), "_e": running_max(F.transform("_s", lambda x: x["end"]))})
    # where the text between the spans begins: after all that begins earlier
    done = F.concat(F.array(F.lit(0).cast("bigint")), F.slice("_e", F.lit(1), F.size("_e") - 1))
    new = F.filter(F.zip_with("_s", done, lambda x, e: F.struct(e.alias("from"), x["start"].alias("to"), x["kind"].alias("kind"))), lambda x: x["to"] >= x["from"])
    text_of = F.transform(new, lambda x: F.concat(part(F.col("_k"), x["from"], x["to"]), F.lit(before), x["kind"], F.lit(after)))
    tail = part(F.col("_k"), F.element_at("_e", -1), F.length(text).cast("bigint"))
    return df.withColumn(text, F.when(F.col("_s").isNotNull(), F.concat(F.array_join(text_of, ""), tail)).otherwise(F.col(text))).drop("_s", "_k", "_e")


def joined(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
