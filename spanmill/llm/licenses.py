"""License scans by a positional rare-token index (operator 7), DataFrame functions only.

Templates are licence texts, notices and short statements. Document frequencies of all
their words are counted over all texts; a template is posted under its ``ANCHORS`` words
of highest IDF, with every offset at which it has them. A file's words are looked up in
that index first, which gives its hits (word, position); then the postings of each
template are intersected by relative position: where it would begin is where at least
``AGREE`` different anchors put it. Only there are the mandatory key phrases looked for,
each within the template's reach, and a template counts where all of them stand. Its
score is the share of its anchors' IDF that agreed.

All of it happens within a file's row: nothing is exploded, joined or shuffled, and a
file of n hits takes some n log n steps. The index has a few postings for each template.

Positions are word numbers from 0. A NULL text is empty. Repeated rows are scored each on
its own. Templates of one label count once; ties in IDF go to the word that stands
earlier in the template. Texts may be of any length, columns have any names, and an empty
table gives an empty result.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.llm.common import running_max, running_total, sealed
from spanmill.llm.decontaminate import SEPARATORS, ascii_lower, words
from spanmill.llm.license_texts import STATEMENTS, TEXTS

#: Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Words of a text's template that are posted; different ones that must agree on where it begins.
ANCHORS, AGREE = 8, 2
#: Words that a file may have dropped from or added to a text before one of its parts.
DRIFT = 20


def words_of(text: str) -> list[str]:
    return [w for w in re.split(SEPARATORS, text.lower()) if w]


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    #: Key phrases, as words, and where they stand.
    keys: tuple[tuple[tuple[str, ...], int], ...]
    #: 0 in a statement, whose words must stand together.
    drift: int


def _template(label: str, text: str, keys: list[str], drift: int) -> Template:
    words = words_of(text)
    placed = []
    for k in (key.split() for key in keys):
        placed.append((tuple(k), next(i for i in range(len(words)) if words[i : i + len(k)] == k)))
    return Template(label, tuple(words), tuple(placed), drift)


TEMPLATES = [*(_template(label, t, keys, DRIFT) for label, t, keys in TEXTS), *(_template(label, t, [key], 0) for label, t, key in STATEMENTS)]


def word_idf(docs: DataFrame, text: str = "text") -> dict[str, float]:
    """IDF over all rows of every word of the templates (as many numbers as they have words)."""
    vocabulary = sorted({w for t in TEMPLATES for w in t.words})
    present = F.array_intersect(F.split(ascii_lower(text), SEPARATORS), F.array(*map(F.lit, vocabulary)))
    per = docs.select(F.explode(F.concat(present, F.array(F.lit("")))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    n = {r[0]: r[1] for r in per.collect()}
    total = n.get("", 0)
    return {w: math.log((total + 1) / (n.get(w, 0) + 1)) for w in vocabulary}


def anchors(template: Template, idf: dict[str, float]) -> dict[str, int]:
    """The template's ``ANCHORS`` words of highest IDF, and their shares of these words' IDF in millionths."""
    best = sorted(dict.fromkeys(template.words), key=lambda w: (-idf[w], template.words.index(w)))[:ANCHORS]
    total = sum(idf[w] for w in best)
    return {w: round(1e6 * idf[w] / total) if total > 0 else 10**6 // len(best) for w in best}


def postings(idf: dict[str, float]) -> dict[str, list[tuple[int, int, int, int, int]]]:
    """word -> (template, offset, anchor, share, drift)."""
    out: dict[str, list] = {}
    for t, template in enumerate(TEMPLATES):
        for k, (w, share) in enumerate(anchors(template, idf).items()):
            out.setdefault(w, []).extend((t, i, k, share, template.drift) for i, x in enumerate(template.words) if x == w)
    return out


def _literal(value, kind: str) -> Column:
    """A constant of any type, in one expression."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _hits(words: str, wanted: list[str]) -> Column:
    """array<struct<w, p>>: where any of the words ``wanted`` stands."""
    return F.filter(F.transform(words, lambda x, i: F.when(x.isin(wanted), F.struct(x.alias("w"), i.alias("p")))), lambda h: h.isNotNull())


def _votes(hits: str, index: dict[str, list]) -> Column:
    """array<struct<t, b, k, share>>, sorted: anchor k puts template t at b.

    Texts are put into steps of their drift: a vote counts in the step that it falls in
    and in the next, so that those a drift apart meet in one of them.
    """
    by_word = _literal({w: [dict(zip("toksd", r, strict=True)) for r in rows] for w, rows in sorted(index.items())}, "map<string,array<struct<t:int,o:int,k:int,s:bigint,d:int>>>")

    def vote(h: Column, x: Column, step: int) -> Column:
        begin = h["p"] - x["o"]
        b = F.when(x["d"] == 0, begin).otherwise((F.floor(begin / F.greatest(x["d"], F.lit(1))).cast("int") + step) * x["d"])
        return F.when((x["d"] > 0) | F.lit(step == 0), F.struct(x["t"].alias("t"), b.alias("b"), x["k"].alias("k"), x["s"].alias("share")))

    every = F.flatten(F.transform(hits, lambda h: F.flatten(F.transform(F.coalesce(F.element_at(by_word, h["w"]), F.array().cast("array<struct<t:int,o:int,k:int,s:bigint,d:int>>")), lambda x: F.array(vote(h, x, 0), vote(h, x, 1))))))
    return F.sort_array(F.filter(every, lambda v: v.isNotNull()))


def _distinct(sorted_votes: str) -> Column:
    """Each vote once; neighbours are compared, as a set of structs would compare all."""
    return F.filter(sorted_votes, lambda v, i: (i == 0) | (F.get(F.col(sorted_votes), i - 1) != v))


def _first_of_run(votes: str) -> Column:
    """For every vote, the number of the first one with its template and beginning."""
    own = F.transform(votes, lambda v, i: F.when((i == 0) | (F.get(F.col(votes), i - 1)["t"] != v["t"]) | (F.get(F.col(votes), i - 1)["b"] != v["b"]), i))
    return running_max(own)


def _candidates(votes: str, first: str, total: str) -> Column:
    """array<struct<t, b, share>>: beginnings on which enough anchors agree."""
    least = _literal([min(AGREE, len(set(t.words))) for t in TEMPLATES], "array<int>")
    numbered = F.transform(votes, lambda v, i: F.struct(v.alias("v"), i.alias("i")))

    def one(x: Column, f: Column) -> Column:
        v, i = x["v"], x["i"]
        nxt = F.get(F.col(votes), i + 1)
        last = nxt.isNull() | (nxt["t"] != v["t"]) | (nxt["b"] != v["b"])
        share = F.get(F.col(total), i) - F.coalesce(F.get(F.col(total), f - 1), F.lit(0).cast("bigint"))
        return F.when(last & (i - f + 1 >= F.get(least, v["t"])), F.struct(v["t"].alias("t"), v["b"].alias("b"), share.alias("share")))

    return F.filter(F.zip_with(numbered, first, one), lambda c: c.isNotNull())


def _verified(candidates: str, words: str) -> Column:
    """The candidates all of whose key phrases stand near their places."""
    keys = _literal([[{"phrase": list(k), "at": at, "reach": 2 * t.drift} for k, at in t.keys] for t in TEMPLATES], "array<array<struct<phrase:array<string>,at:int,reach:int>>>")

    def stands(c: Column, k: Column) -> Column:
        place = c["b"] + k["at"]
        # word by word: a slice would copy the file's words each time
        here = lambda d: F.forall(F.transform(k["phrase"], lambda x, j: F.coalesce(F.get(F.col(words), place + d + j), F.lit("")) == x), lambda same: same)
        return F.exists(F.sequence(-k["reach"], k["reach"]), here)

    return F.filter(candidates, lambda c: F.forall(F.get(keys, c["t"]), lambda k: stands(c, k)))


def scan(docs: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """``columns``, n_words, n_base, first_word, last_word, base_labels, labels (sorted arrays) and score per row."""
    index = postings(word_idf(docs, text))
    df, names, (body,) = sealed(docs, columns, text)
    firsts = {p.split()[0] for p in BASE}
    df = df.select(*names, words(body).alias("_w"))
    df = df.withColumn("_h", _hits("_w", sorted(firsts | set(index))))
    df = df.withColumn("_v", F.when(F.size("_h") > 1, _votes("_h", index)))
    df = df.withColumn("_v", _distinct("_v"))
    df = df.withColumns({"_f": _first_of_run("_v"), "_t": running_total(F.transform("_v", lambda v: v["share"]))})
    df = df.withColumn("_c", _candidates("_v", "_f", "_t"))
    df = df.withColumn("_c", F.when(F.size("_c") > 0, _verified("_c", "_w")))

    def base(h: Column) -> Column:
        out = None
        for phrase, label in BASE.items():
            first, *rest = phrase.split()
            here = h["w"] == first
            for k, w in enumerate(rest, 1):
                here = here & (F.coalesce(F.get(F.col("_w"), h["p"] + k), F.lit("")) == w)
            out = F.when(here, label) if out is None else out.when(here, label)
        return F.struct(h["p"].cast("bigint").alias("at"), out.alias("label"))

    df = df.withColumn("_b", F.filter(F.transform("_h", base), lambda x: x["label"].isNotNull()))
    labels = F.array_sort(F.array_distinct(F.transform("_b", lambda x: x["label"])))
    names_of = _literal([t.label for t in TEMPLATES], "array<string>")
    own = F.coalesce(F.transform("_c", lambda c: F.get(names_of, c["t"])), F.array().cast("array<string>"))
    share = F.array_max(F.transform("_c", lambda c: F.least(c["share"] / 1e6, F.lit(1.0))))
    out = df.select(
        *names, F.size("_w").cast("bigint").alias("n_words"), F.size("_b").cast("bigint").alias("n_base"), F.get(F.col("_b"), F.lit(0))["at"].alias("first_word"), F.get(F.col("_b"), F.size("_b") - 1)["at"].alias("last_word"),
        labels.alias("base_labels"), F.array_sort(F.array_union(labels, own)).alias("labels"), F.coalesce(share, F.when(F.size("_b") > 0, F.lit(0.5)).otherwise(F.lit(0.0))).alias("score"),
    )
    return out.toDF(*columns, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
