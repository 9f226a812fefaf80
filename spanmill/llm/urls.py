"""URL filters by association rules (operator 8), DataFrame functions and Spark's FP-growth only.

Hand-made rules (host, path prefix) decide what they fit, the longest first. Their
verdicts label URLs for FP-growth, which mines combinations of URL tokens that go
with a verdict. Mined rules are pruned by support and confidence, and where a subset
says the same as surely. They are posted under their rarest token in an inverted index;
a URL looks up its tokens and takes the verdict of the surest rule that it contains
whole (ties: block). A URL that nothing fits is allowed.

What is mined is reduced first, without changing any verdict. Tokens that stand in the
same labelled URLs are one item, so a family of URLs with long common parts makes no
power set; a URL has an item when it has any of its tokens. A token that always goes with
one verdict is a rule by itself, surer than any that it would be part of, and is not
combined. What FP-growth gets are items that neither decide alone nor repeat each other.

A NULL url is empty. Repeated rows are judged each on its own. Urls may be of any length;
their tokens are distinct. Columns may have any names, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.llm.common import counted, cut, sealed, small

#: Fixed values: (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
DEFAULT = "allow"
MIN_SUPPORT, MIN_CONFIDENCE = 0.01, 0.9
#: Rules up to which they are pruned and broadcast; more are joined as they are, to the same verdicts.
MAX_RULES = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, query with its mark)."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)", 1)


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict)."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        one = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, one) if out is None else out.when(fits, one)
    return out


def tokens(host: Column, path: Column, query: Column) -> Column:
    """Distinct tokens: host labels and suffixes, path segments with digits folded, query keys."""
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    top = F.array(F.concat(F.lit("t:"), F.substring_index(host, ".", -1)), F.concat(F.lit("d:"), F.substring_index(host, ".", -2)))
    segments = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "0")))
    keys = F.transform(F.filter(F.split(F.regexp_replace(query, r"^\?", ""), "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    return F.array_distinct(F.concat(labels, top, segments, keys))


_INDEX = "item string, antecedent array<string>, said string, confidence double"
_TOKENS = "token string, item string, n bigint, alone struct<confidence:double,said:string>"


def _items(flat: DataFrame, least: float, min_confidence: float) -> DataFrame:
    """token, item, n, block and the rule ``alone`` that it is, of the tokens in at least ``least`` rows of ``flat`` (id, verdict, token).

    Tokens of one item stand in the same rows: equal counts and equal sums of two hashes
    of the rows' ids. ``n`` are its rows, ``block`` those of them that are blocked.
    """
    h, g = F.xxhash64("id").cast("decimal(38,0)"), F.xxhash64(F.lit("again"), "id").cast("decimal(38,0)")
    per = flat.groupBy("token").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "block").alias("block"), F.sum(h).alias("h"), F.sum(g).alias("g")).where(F.col("n") >= least)
    same = per.groupBy("n", "block", "h", "g").agg(F.min("token").alias("item"))
    rule = lambda k, said: F.when((k >= least) & (k >= min_confidence * F.col("n")), F.struct((k / F.col("n")).alias("confidence"), F.lit(said).alias("said")))
    alone = F.greatest(rule(F.col("block"), "block"), rule(F.col("n") - F.col("block"), "allow"))
    return per.join(same, ["n", "block", "h", "g"]).select("token", "item", "n", "block", alone.alias("alone"))


def _pruned(rules: list[tuple]) -> list[tuple[list[str], str, float]]:
    """The rules of which no subset says the same as surely."""
    kept: list[tuple[frozenset, str, float]] = []
    by: dict[str, list] = {}
    for a, y, c in sorted(((frozenset(a), y, float(c)) for a, y, c in rules), key=lambda r: (len(r[0]), sorted(r[0]), r[1])):
        if any(k[0] <= a and k[1] == y and k[2] >= c for t in a for k in by.get(t, [])):
            continue
        kept.append((a, y, c))
        for t in a:
            by.setdefault(t, []).append(kept[-1])
    return [(sorted(a), y, c) for a, y, c in kept]


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, max_rules: int = MAX_RULES) -> tuple[DataFrame, int, DataFrame, int]:
    """From ``labelled`` (id, items, verdict; a table): the frequent tokens (token, item, n, alone) and the inverted index (item, antecedent, said, confidence) of the combinations, each with its rows."""
    spark = labelled.sparkSession
    n = labelled.count()
    if not n:
        return spark.createDataFrame([], _TOKENS), 0, spark.createDataFrame([], _INDEX), 0
    flat = labelled.select("id", "verdict", F.explode("items").alias("token"))
    items, many = counted(_items(flat, min_support * n, min_confidence), "items")
    mixed = items.where("token = item AND block > 0 AND block < n").select("token")
    baskets = flat.join(small(mixed, many), "token").groupBy("id").agg(F.collect_list("token").alias("mixed"))
    # rows without a mixed token still count for the support
    rows = labelled.select("id", "verdict").join(baskets, "id", "left").select(F.concat(F.coalesce("mixed", F.array().cast("array<string>")), F.array(F.concat(F.lit("y:"), F.col("verdict")))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(cut(rows, "baskets"))
    said = F.get("consequent", F.lit(0))
    combined = model.associationRules.where(F.startswith(said, F.lit("y:")) & (F.size("antecedent") > 1) & ~F.exists("antecedent", lambda x: F.startswith(x, F.lit("y:"))))
    rules, found = counted(combined.select("antecedent", F.regexp_replace(said, "^y:", "").alias("said"), "confidence"), "rules")
    if found <= max_rules:
        kept = _pruned([tuple(r) for r in rules.collect()])
        rules = spark.createDataFrame(kept, "antecedent array<string>, said string, confidence double")
    # posted under the rarest item
    posted = rules.withColumn("id", F.struct("antecedent", "said")).select("*", F.explode("antecedent").alias("item")).join(small(items.where("token = item").select("item", "n"), many), "item")
    posted = posted.groupBy("id").agg(F.min_by("item", F.struct("n", "item")).alias("item"), F.first("confidence").alias("confidence"))
    index, n = counted(posted.select("item", "id.antecedent", "id.said", "confidence"), "index")
    return items.select("token", "item", "n", "alone"), many, index, n


def judge(pages: DataFrame, columns: list[str], url: str = "url", rules=RULES, min_support: float = MIN_SUPPORT, max_rules: int = MAX_RULES) -> DataFrame:
    """``columns``, host, path, rule and verdict of every row."""
    df, names, (address,) = sealed(pages, columns, url)
    host, path, query = parts(F.col(address))
    df = df.select(*names, host.alias("host"), path.alias("path"), query.alias("_query"))
    df = df.withColumn("_fit", fitting_rule(F.col("host"), F.col("path"), rules)).withColumn("_items", tokens(F.col("host"), F.col("path"), F.col("_query")))
    labelled = cut(df.where("_fit IS NOT NULL").select(F.monotonically_increasing_id().alias("id"), F.col("_items").alias("items"), F.col("_fit.verdict").alias("verdict")), "labelled")
    known, many, index, n = mine(labelled, min_support, max_rules=max_rules)
    # every row is numbered once and met in one pass
    rows = df.withColumn("_row", F.monotonically_increasing_id()).withColumn("token", F.explode_outer(F.when(F.col("_fit").isNull(), F.col("_items"))))
    kept = [F.first(c).alias(c) for c in (*names, "host", "path", "_fit")]
    per = rows.join(small(known, many), "token", "left").groupBy("_row").agg(*kept, F.collect_set("item").alias("_has"), F.max("alone").alias("_best"))
    if n:
        met = per.withColumn("item", F.explode_outer(F.when(F.size("_has") > 1, F.col("_has")))).join(small(index, n), "item", "left")
        whole = F.when(F.size(F.array_except("antecedent", "_has")) == 0, F.struct("confidence", "said"))
        per = met.groupBy("_row").agg(*kept, F.greatest(F.first("_best"), F.max(whole)).alias("_best"))
    out = per.select(*names, "host", "path", F.col("_fit.rule").alias("rule"), F.coalesce(F.col("_fit.verdict"), F.col("_best.said"), F.lit(DEFAULT)).alias("verdict"))
    return out.toDF(*columns, "host", "path", "rule", "verdict")
