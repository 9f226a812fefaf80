"""Best-fit packing of token sequences (operator 10).

Hierarchical residual packing: every block of pieces is packed best-fit decreasing and
gives out its nearly full bins; underfull bins go on as items, a few blocks together,
and are packed best-fit again, until one block is left. Two bins that are both more than
half full never fit together, and best-fit leaves a block one bin that is not. So a
block sends on that bin and, of the underfull ones, as many of each size as the blocks
it meets can fill (``FAN_IN``); further ones would find no item. What a task above the
lowest level holds is therefore bounded by the capacity, whatever the sizes of the
pieces, and each level moves bins (an id and a size), never pieces or tokens.

Token ids are those of a vocabulary file of the ``tokenizers`` library, by its plain
``encode`` without added special tokens. A byte-level BPE file whose merges stand in the
order of their ids is run by ``tiktoken``, which gives the same ids faster; texts that
contain an added token, or code points for which the two were not compared, and all
texts under other vocabularies, go to the library whole.

A NULL text is empty: its only token is the separator. Repeated doc_ids are separate
documents, told apart by their sequences and offsets. Texts of any length are cut into pieces. Ties go to the smaller
(doc_id, piece). An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.llm.common import Scratch, counted, cut, small, small_arrow_batches

CAPACITY = 2048
SEPARATOR = 0
#: Bins from this size on are given out at once.
NEARLY_FULL = 2040
FAN_IN = 8
#: Pieces that one task packs.
BLOCK_ROWS = 300_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"

#: Fixed value: the splitting pattern of byte-level vocabularies.
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Below this, both libraries were found to class all code points alike.
_COMPARED = 0x92000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 as is, the rest from U+0100 on."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """Token bytes and ids, where they are all that the encoding depends on."""
    pre, model = spec["pre_tokenizer"] or {}, spec["model"]
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["normalizer"] or model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges"):
        return None
    vocabulary, added = model["vocab"], {t["content"] for t in spec["added_tokens"]}
    merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != sorted(set(merged)):
        return None
    back = {v: k for k, v in _byte_letters().items()}
    return {bytes(back[c] for c in t): i for t, i in vocabulary.items() if t not in added}


class Encoder:
    """Ids of texts as little-endian 32-bit words."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        spec = json.loads(self.whole.to_str())
        ranks = _ranks(spec)
        self.fast = tiktoken.Encoding(path, pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranks else None
        odd = [re.escape(t["content"]) for t in spec["added_tokens"]] + [f"[{chr(_COMPARED)}-{chr(0x10FFFF)}]"]
        self.odd = re.compile("|".join(odd))

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        ids = self.whole.encode(text, add_special_tokens=False).ids if self.fast is None or self.odd.search(text) else self.fast.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut_lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of a document's pieces: only the first may be shorter than the capacity."""
    if n <= capacity:
        return [n]
    head = n % capacity
    return ([head] if head else []) + [capacity] * (n // capacity)


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row."""
    path = vocabulary or default_vocabulary()

    def tokenize(batches):
        enc = encoder(path)
        end = SEPARATOR.to_bytes(4, "little")
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                out = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = memoryview(enc.encode(text or "") + end)
                    at = 0
                    for k, n in enumerate(cut_lengths(len(ids) // 4, capacity)):
                        out.append((doc_id, k, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)])))
                        at += n
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(tokenize, PIECES)


def best_fit(sizes: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int], list[int]]:
    """(bin of each item, its offset, total of each bin), best-fit decreasing."""
    bins, offsets, totals = [0] * len(sizes), [0] * len(sizes), []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r: some bin has r left
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        n = sizes[k]
        fits = open_rooms >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_rooms &= ~(1 << r)
        else:
            b, r = len(totals), capacity
            totals.append(0)
        bins[k], offsets[k] = b, totals[b]
        totals[b] += n
        if r - n:
            room[r - n].append(b)
            open_rooms |= 1 << (r - n)
    return bins, offsets, totals


def rooms(totals: list[int], capacity: int, nearly_full: int, fan_in: int) -> list[bool]:
    """Which bins of a block go on: the one at most half full, and of each underfull size as many as other blocks can use."""
    left = {}
    out = []
    for n in totals:
        left[n] = left.get(n, fan_in) - 1
        out.append(n < nearly_full and (2 * n <= capacity or left[n] >= 0))
    return out


def _packed(batches, columns: list[str], capacity: int, nearly_full: int, fan_in: int):
    """Rows with bin and base and, at the first row of each bin, its total and whether it goes on."""
    from pyspark import TaskContext

    table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
    if table is None or not table.num_rows:
        return
    table = table.sort_by([(c, "ascending") for c in columns])
    bins, offsets, totals = best_fit(table.column("length").to_pylist(), capacity)
    up = rooms(totals, capacity, nearly_full, fan_in)
    node = TaskContext.get().partitionId()
    first = [not o for o in offsets]
    more = {
        "node": pa.array([node] * len(bins), pa.int64()), "bin": pa.array([(node << 34) + b for b in bins], pa.int64()), "base": pa.array(offsets, pa.int64()),
        "total": pa.array([totals[b] if f else None for b, f in zip(bins, first, strict=True)], pa.int64()), "up": pa.array([f and up[b] for b, f in zip(bins, first, strict=True)], pa.bool_()),
    }
    for n, c in more.items():
        table = table.append_column(n, c)
    yield from table.to_batches(max_chunksize=10_000)


def merged(capacity: int, nearly_full: int, fan_in: int):
    """Bins (node, bin, total) of a few blocks as items: the bin and offset that each is at now; with base 0 it stays, with its new total."""

    def f(table: pa.Table) -> pa.Table:
        table = table.sort_by("bin")
        ids = table.column("bin").to_pylist()
        bins, offsets, totals = best_fit(table.column("total").to_pylist(), capacity)
        holder = {b: i for i, b, o in zip(ids, bins, offsets, strict=True) if not o}
        up = rooms(totals, capacity, nearly_full, fan_in)
        return pa.table({
            "node": table.column("node"), "bin": table.column("bin"), "now": pa.array([holder[b] for b in bins], pa.int64()), "base": pa.array(offsets, pa.int64()),
            "total": pa.array([totals[b] for b in bins], pa.int64()), "up": pa.array([not o and up[b] for b, o in zip(bins, offsets, strict=True)], pa.bool_()),
        })

    return f


def pack(items: DataFrame, capacity: int = CAPACITY, nearly_full: int = NEARLY_FULL, fan_in: int = FAN_IN, block: int = BLOCK_ROWS) -> DataFrame:
    """``items`` (as ``pieces``, a table that was written) with sequence_id and offset."""
    columns = items.columns
    blocks = -(-items.count() // block)
    if blocks > 1:
        items = items.repartition(blocks)
    schema = ", ".join(f"{n} {t}" for n, t in items.dtypes) + ", node bigint, bin bigint, base bigint, total bigint, up boolean"
    rows = cut(items.mapInArrow(lambda b: _packed(b, columns, capacity, nearly_full, fan_in), schema), "bins")
    with Scratch(items.sparkSession) as scratch:
        moves = merge_tree(rows.where("up").select("node", "bin", "total"), capacity, nearly_full, fan_in)
        moves, n = counted(moves.select("bin", "now", F.col("base").alias("_base")), "moves")
        scratch.keep(moves)
    out = rows.join(small(moves, n), "bin", "left")
    return out.select(*columns, F.coalesce("now", "bin").alias("sequence_id"), (F.col("base") + F.coalesce("_base", F.lit(0))).alias("offset"))


def merge_tree(bins: DataFrame, capacity: int, nearly_full: int, fan_in: int) -> DataFrame:
    """(bin, now, base) of the bins (node, bin, total) that end inside others."""
    top = bins.agg(F.max("node")).first()[0] or 0
    moves = bins.select("bin", F.col("bin").alias("now"), F.lit(0).cast("bigint").alias("base")).limit(0)
    while top:
        top //= fan_in
        step = bins.withColumn("node", F.expr(f"node div {fan_in}L")).groupBy("node").applyInArrow(merged(capacity, nearly_full, fan_in), "node bigint, bin bigint, now bigint, base bigint, total bigint, up boolean")
        step = cut(step, "level")
        one = step.where("base > 0").select("bin", "now", "base")
        nxt = one.select(F.col("bin").alias("now"), F.col("now").alias("_now"), F.col("base").alias("_base"))
        moves = moves.join(nxt, "now", "left").select("bin", F.coalesce("_now", "now").alias("now"), (F.col("base") + F.coalesce("_base", F.lit(0))).alias("base")).unionByName(one)
        bins = step.where("up").select("node", "bin", "total")
    return moves


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of ``docs`` (doc_id, text)."""
    nearly = NEARLY_FULL * capacity // CAPACITY
    with small_arrow_batches(docs.sparkSession, 2_000, 8 << 20):
        items = cut(pieces(docs, vocabulary, capacity), "pieces")
    return pack(items, capacity, nearly)
