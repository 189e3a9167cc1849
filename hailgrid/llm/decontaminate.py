"""Benchmark passages in documents, by a prefix-filtered join of shingles.

An item's windows are its runs of ``window`` words (the whole item, if it is shorter). A
window occurs in a document only if all its shingles of up to ``SHINGLE`` words do, so
one of them is a sufficient prefix for the join: the rarest in the corpus.

1. Documents are read once. Shingles that pass a bitmap of the benchmark's shingles are
   kept with their position and the words around them. The bitmap has a fixed size, so it
   can be broadcast for any benchmark; it drops no match.
2. Their counts order each window's shingles by rarity. A window with a shingle that no
   document has is done.
3. Documents and windows are joined on the rarest shingle; bounds on position and length
   and then all words of the window decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hailgrid.checkpoints import keep
from hailgrid.llm import text as T

SHINGLE = 5


def _lowered(block: T.Block) -> bytes:
    return T.LOWER[block.data].tobytes()


def _windows(window: int, word: str):
    """Rows (item_id, size, words, tokens) of the windows of each item; tokens are its shingles' hashes by offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_word = T.is_word_byte(word)
        for batch in batches:
            for block in T.blocks(batch.column("text")):
                found, low = T.words(block, is_word), _lowered(block)
                ids = batch.column("item_id").slice(block.first, block.rows).to_pylist()
                tokens_of = {n: T.grams(found, n).view(np.int64) for n in range(1, SHINGLE + 1)}
                out = {"item_id": [], "size": [], "words": [], "tokens": []}
                for row, item in enumerate(ids):
                    first, end = int(found.of_row[row]), int(found.of_row[row + 1])
                    size = min(window, end - first)
                    n = min(SHINGLE, size)
                    for at in range(first, end - size + 1) if size else ():
                        out["item_id"].append(item)
                        out["size"].append(size)
                        out["words"].append(b" ".join(low[found.starts[i] : found.ends[i]] for i in range(at, at + size)).decode())
                        out["tokens"].append(tokens_of[n][at : at + size - n + 1].tolist())
                yield pa.RecordBatch.from_pydict(
                    out, schema=pa.schema([("item_id", pa.int64()), ("size", pa.int32()), ("words", pa.string()), ("tokens", pa.list_(pa.int64()))])
                )

    return run


_HIT = "array<struct<token:long,at:int,lead:int,words:string>>"
_HIT_ARROW = pa.list_(pa.struct([("token", pa.int64()), ("at", pa.int32()), ("lead", pa.int32()), ("words", pa.string())]))


def _hits(bitmap, sizes: list[int], window: int, word: str):
    """Rows (doc_id, key, n_words, hits): the shingles of each text that may be the benchmark's, with the words around."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_word = T.is_word_byte(word)
        bits = bitmap.value
        for batch in batches:
            for block in T.blocks(batch.column("text")):
                found = T.words(block, is_word)
                counts = np.diff(found.of_row)
                ends = np.repeat(found.of_row[1:], counts)
                hits: list[list] = [[] for _ in range(block.rows)]
                low = None
                for n in sizes:
                    tokens = T.grams(found, n)
                    slot = (tokens >> np.uint64(6)) & np.uint64(len(bits) - 1)
                    may = (bits[slot.astype(np.int64)] >> (tokens & np.uint64(63))) & np.uint64(1)
                    places = np.flatnonzero(may.astype(bool) & (np.arange(len(tokens)) + n <= ends[: len(tokens)]))
                    if len(places) and low is None:
                        low = _lowered(block)
                    rows = np.searchsorted(found.of_row, places, side="right") - 1
                    for at, row, token in zip(places.tolist(), rows.tolist(), tokens[places].view(np.int64).tolist(), strict=True):
                        first, end = int(found.of_row[row]), int(found.of_row[row + 1])
                        left, right = max(first, at - window + n), min(end, at + window)
                        around = b" ".join(low[s:e] for s, e in zip(found.starts[left:right].tolist(), found.ends[left:right].tolist(), strict=True))
                        hits[row].append({"token": token, "at": at - first, "lead": at - left, "words": around.decode(errors="replace")})
                part = batch.slice(block.first, block.rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("key"), pa.array(counts, pa.int64()), pa.array(hits, _HIT_ARROW)], ["doc_id", "key", "n_words", "hits"]
                )

    return run


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    word: str = "alnum",
    bitmap_bits: int = 24,
) -> DataFrame:
    """``doc_id, key, n_words, n_hit, items`` of each row: its words inside benchmark windows, and the items they are of.

    Words are compared with A-Z in lower case. Null, empty and wordless texts have no
    words and no hits; items without words have no windows. ``items`` is sorted and holds
    no null id, though the words of such an item are hit. Repeated rows and items count
    alike. Null document ids are kept. Empty tables give no rows, or no hits.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    windows = keep(items.mapInArrow(_windows(window, word), "item_id long, size int, words string, tokens array<long>"))
    # One row per 64 bits of the bitmap: at most 2 ** (bitmap_bits - 6) rows reach the driver.
    words64 = 1 << (bitmap_bits - 6)
    tokens = windows.select(F.least("size", F.lit(SHINGLE)).alias("n"), F.explode("tokens").alias("token"))
    sizes = [r.n for r in tokens.select("n").distinct().collect()]
    slots = tokens.groupBy(F.shiftrightunsigned("token", 6).bitwiseAND(words64 - 1).alias("slot")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(token & 63 as int))")).alias("bits")
    )
    bits = np.zeros(words64, np.uint64)
    for slot, value in slots.toLocalIterator():
        bits[slot] = np.int64(value).view(np.uint64)
    bitmap = spark.sparkContext.broadcast(bits)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("key", T.text_key("doc_id", "text"))
    read = rows.mapInArrow(_hits(bitmap, sizes, window, word), f"doc_id long, key long, n_words long, hits {_HIT}")
    base = keep(read.withColumn("uid", F.monotonically_increasing_id()))
    hits = base.where(F.size("hits") > 0).select("uid", "n_words", F.inline("hits"))

    counts = hits.groupBy("token").agg(F.count("*").alias("n"))
    distinct = windows.groupBy("words", "size").agg(F.first("tokens").alias("tokens"), F.collect_set("item_id").alias("items"))
    rarest = (
        distinct.select("words", "size", F.size("tokens").alias("of"), F.posexplode("tokens").alias("offset", "token"))
        .join(counts, "token")
        .groupBy("words", "size")
        .agg(F.min(F.struct("n", "offset", "token")).alias("rarest"), F.count("*").alias("met"), F.first("of").alias("of"))
        .where("met = of")
    )
    prefix = rarest.select("words", "size", F.col("rarest.offset").alias("offset"), F.col("rarest.token").alias("token")).withColumnRenamed("words", "window")
    start = F.col("at") - F.col("offset")
    around = F.split("words", " ")
    matched = (
        hits.join(prefix, "token")
        .where((start >= 0) & (start + F.col("size") <= F.col("n_words")) & (F.col("lead") >= F.col("offset")))
        .where(F.concat_ws(" ", F.slice(around, F.col("lead") - F.col("offset") + 1, F.col("size"))) == F.col("window"))
        .select("uid", start.alias("start"), (start + F.col("size")).alias("end"), "window")
    )
    spans = matched.groupBy("uid").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit")),
        lambda acc, x: F.struct(F.greatest(acc["end"], x["end"]).alias("end"), (acc["hit"] + F.greatest(F.lit(0), x["end"] - F.greatest(acc["end"], x["start"]))).alias("hit")),
        lambda acc: acc["hit"],
    )
    named = (
        matched.select("uid", "window").distinct()
        .join(distinct.select(F.col("words").alias("window"), F.explode("items").alias("item_id")), "window")
        .groupBy("uid")
        .agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    )
    found = spans.select("uid", covered.cast("long").alias("n_hit")).join(named, "uid", "left")
    return base.drop("hits").join(found, "uid", "left").select(
        "doc_id",
        "key",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<long>")).alias("items"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` without any hit word, with all their columns; see ``contamination``."""
    hit = contamination(docs, benchmark, doc_id, text, **settings).where("n_hit > 0").select("key").distinct()
    keyed = docs.select(F.struct("*").alias("row"), F.xxhash64(F.col(doc_id).cast("long"), F.col(text).cast("string"), F.col(text).isNull()).alias("key"))
    return keyed.join(hit, "key", "left_anti").select("row.*")
