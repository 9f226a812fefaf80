"""Language identification by rank-order n-gram profiles (operator 5).

A profile is a language's ``TOP`` most frequent n-grams of one to three letters
(word ends are marked), counted over all training documents. A document's own
ranking is compared by out-of-place distance: the sum of rank differences, with
``TOP`` for an n-gram that the profile lacks.

The score is the margin of the nearest profile over the next, from 0 to 1 (with one
language, how near it is). A text that is NULL or has no letter, and any text where
nothing was learned, is ``und`` with score 0. Ties go to the first language in
alphabetical order, ties between n-grams to the smaller code. Texts are read whole, whatever
their length; repeated rows get the same answer each, and an empty table an empty result.

Profiles of up to ``MAX_LANGUAGES`` languages go to every task as one matrix; more are
joined with the documents' n-grams, to the same answers.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanmill.llm.common import cut, sealed

TOP = 300
UNDETERMINED = "und"
#: Letters below U+0250 have codes of their own; others share the rest of the 1,023.
_DIRECT, _CODES = 0x250, 1024
MAX_LANGUAGES = 5_000
_table = None


def _letters() -> np.ndarray:
    global _table
    if _table is None:
        n = sys.maxunicode + 1
        t = np.zeros(n, np.uint32)
        alpha = np.fromiter((chr(c).isalpha() for c in range(n)), bool, n)
        cp = np.nonzero(alpha)[0]
        low = cp[cp < _DIRECT]
        t[low] = low + 1
        high = cp[cp >= _DIRECT]
        t[high] = _DIRECT + 1 + (high * 2654435761 >> 7) % (_CODES - _DIRECT - 1)
        _table = t
    return _table


def ngrams(text: str | None) -> np.ndarray:
    """Codes of all n-grams of the text."""
    if not text:
        return np.empty(0, np.uint32)
    x = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
    x = np.concatenate((np.zeros(1, np.uint32), x, np.zeros(1, np.uint32)))
    x = x[np.concatenate(([True], (x[1:] != 0) | (x[:-1] != 0)))]
    if len(x) < 3:
        return np.empty(0, np.uint32)
    a, b, c = x[:-2], x[1:-1], x[2:]
    inner = b != 0
    one = b[inner] | np.uint32(3 << 30)
    two = ((x[:-1] << np.uint32(10)) | x[1:]) | np.uint32(1 << 30)
    three = (a[inner] << np.uint32(20)) | (b[inner] << np.uint32(10)) | c[inner]
    return np.concatenate((one, two, three))


def _counted(batches):
    """(lang, gram, n) of one partition."""
    held: dict[str, list] = {}

    def merge(lang):
        codes = np.concatenate([c for c, _ in held[lang]])
        n = np.concatenate([n for _, n in held[lang]])
        u, at = np.unique(codes, return_inverse=True)
        held[lang] = [(u, np.bincount(at, n).astype(np.int64))]

    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            by: dict[str, list] = {}
            part = batch.slice(i, 500)
            for t, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), strict=True):
                by.setdefault(lang, []).append(ngrams(t))
            for lang, codes in by.items():
                held.setdefault(lang, []).append(np.unique(np.concatenate(codes), return_counts=True))
                if len(held[lang]) > 40:
                    merge(lang)
    for lang in held:
        merge(lang)
        u, n = held[lang][0]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u), pa.string()), pa.array(u.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])


def learn(docs: DataFrame, top: int = TOP, most: int = MAX_LANGUAGES) -> dict[str, list[int]] | DataFrame:
    """lang -> its n-grams, most frequent first, from ``docs`` (text, lang); of more than ``most`` languages a table (lang, gram, r)."""
    rows = docs.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    counts = rows.mapInArrow(_counted, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = cut(counts.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).select("lang", "gram", "r"), "profiles")
    if best.where("r = 1").count() > most:
        return best
    out: dict[str, list[int]] = {}
    for lang, gram, _ in sorted(best.collect(), key=lambda r: (r[0], r[2])):
        out.setdefault(lang, []).append(gram)
    return out


def ranked(text: str | None, top: int = TOP) -> np.ndarray:
    """The text's most frequent n-grams, in order."""
    u, n = np.unique(ngrams(text), return_counts=True)
    return u[np.argsort(-n, kind="stable")[:top]]


class Profiles:
    """Profiles as one matrix of ranks."""

    def __init__(self, profiles: dict[str, list[int]], top: int = TOP):
        self.top, self.langs = top, sorted(profiles)
        self.grams = np.unique(np.array([g for p in profiles.values() for g in p], np.uint32))
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int64)
        for k, lang in enumerate(self.langs):
            at = np.searchsorted(self.grams, np.array(profiles[lang], np.uint32))
            self.ranks[at, k] = np.arange(len(at))

    def predict(self, text: str | None) -> tuple[str, float]:
        own = ranked(text, self.top)
        if not len(own) or not self.langs:
            return UNDETERMINED, 0.0
        at = np.searchsorted(self.grams, own)
        at[at < len(self.grams)] = np.where(self.grams[at[at < len(self.grams)]] == own[at < len(self.grams)], at[at < len(self.grams)], len(self.grams))
        ranks = self.ranks[at]
        d = np.where(ranks < 0, self.top, np.abs(ranks - np.arange(len(own))[:, None])).sum(axis=0)
        k = int(d.argmin())
        if len(d) == 1:
            return self.langs[0], float(max(0.0, 1 - d[0] / (self.top * len(own))))
        second = int(np.partition(d, 1)[1])
        return self.langs[k], float((second - d[k]) / second) if second else 0.0


def identify(docs: DataFrame, profiles: dict[str, list[int]] | DataFrame, columns: list[str], text: str = "text", top: int = TOP) -> DataFrame:
    """``columns`` of every row of ``docs`` with lang_pred and score."""
    df, names, (body,) = sealed(docs, columns, text)
    if isinstance(profiles, DataFrame):
        return _joined(df, profiles, names, body, top).toDF(*columns, "lang_pred", "score")
    model = Profiles(profiles, top)

    def predict(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                got = [model.predict(t) for t in part.column(body).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], [*names, "lang_pred", "score"])

    schema = df.select(*names).schema.add("lang_pred", "string").add("score", "double")
    return df.mapInArrow(predict, schema).toDF(*columns, "lang_pred", "score")


def _joined(df: DataFrame, profiles: DataFrame, names: list[str], body: str, top: int) -> DataFrame:
    """The same with profiles (lang, gram, r) that no task should hold: distances are summed over the n-grams that both have."""

    def rank(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                grams = [ranked(t, top).astype(np.int64) for t in part.column(body).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(grams, pa.list_(pa.int64()))], [*names, "_grams"])

    own = df.mapInArrow(rank, df.select(*names).schema.add("_grams", T.ArrayType(T.LongType()))).withColumn("_row", F.monotonically_increasing_id())
    flat = own.select(*names, "_row", F.size("_grams").alias("_n"), F.posexplode_outer("_grams").alias("_at", "gram"))
    near = F.abs(F.col("r") - 1 - F.col("_at")) - top
    per = flat.join(profiles, "gram", "left").groupBy("_row", "lang").agg(*[F.first(c).alias(c) for c in (*names, "_n")], F.sum(near).alias("_less"))
    one = F.when(F.col("lang").isNotNull(), F.struct((F.col("_n") * top + F.col("_less")).alias("d"), "lang"))
    best = per.groupBy("_row").agg(*[F.first(c).alias(c) for c in (*names, "_n")], F.slice(F.sort_array(F.collect_list(one)), 1, 2).alias("_two"))
    first = F.get(F.col("_two"), F.lit(0))
    # languages that share no n-gram are as far as can be
    second = F.coalesce(F.get(F.col("_two"), F.lit(1))["d"], F.col("_n") * top)
    lang = F.when(F.col("_n") == 0, UNDETERMINED).otherwise(F.coalesce(first["lang"], F.lit(profiles.agg(F.min("lang")).first()[0])))
    return best.select(*names, lang.alias("lang_pred"), F.when((F.col("_n") > 0) & first.isNotNull() & (second > 0), (second - first["d"]) / second).otherwise(F.lit(0.0)).alias("score"))


def remainder(doc_id: str | Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; NULL ids count as not held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod
