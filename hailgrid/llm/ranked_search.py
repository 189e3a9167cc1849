"""Ranked lexical search over an inverted index in shards, by Block-Max MaxScore.

*Index.* Consecutive texts form a shard of bounded size. A shard has a row for each of its terms:
the documents and how often they hold it, in compressed blocks of ``BLOCK`` postings, each with
its last document and, for few and for more occurrences, the shortest document. It is written
once, without a shuffle, and serves any number of searches.

*Search.* Spark joins the asked terms with the index, counts documents per term, and brings a
shard's lists together. For each item a shard's lists are sorted by their greatest gain. Those
whose gains together can't reach the tenth score so far aren't essential: no document is looked
for in them. Documents of the essential lists get their score there; the greatest gains of the
blocks where they would stand in the other lists reject most of them before these blocks are
decompressed. Each shard's best are merged by a window that Spark cuts off before the shuffle.

Scores are whole numbers, so the result doesn't depend on the shards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hailgrid.llm import text as T
from hailgrid.llm.storage import stored

BLOCK = 128
# Words and documents of a shard; a longer text is one of its own.
SHARD_WORDS = 2_000_000
SHARD_DOCS = 16_384
# Documents of a shard that are scored at once.
RANGE_DOCS = 2048
# Terms of the items of one search, with repeats among items; more items are searched in turn.
SEARCH_TERMS = 500_000

_TOPS = ("one", "two", "three", "more", "most")
BLOCK_TYPE = "struct<last:int,count:int,one:int,two:int,three:int,more:int,most:int,data:binary>"
INDEX_SCHEMA = f"shard long, term binary, df long, blocks array<{BLOCK_TYPE}>, ids array<long>, lengths array<long>"


def _words(block: T.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of a block's words, the row of each, and where they start and end."""
    found = T.words(block, T.is_word_byte("alnum"))
    return found.hashes, np.repeat(np.arange(block.rows), np.diff(found.of_row)), found.starts, found.ends


class _Shard:
    """Postings of the texts that one row group of the index will hold."""

    def __init__(self) -> None:
        self.terms: dict[int, bytes] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.ids: list[pa.Array] = []
        self.lengths: list[np.ndarray] = []
        self.words = self.docs = 0

    def add(self, ids: pa.Array, block: T.Block) -> None:
        hashes, row, starts, ends = _words(block)
        counts = np.bincount(row, minlength=block.rows)
        full = np.flatnonzero(counts)
        if not len(full):
            return
        number = np.cumsum(counts > 0) - 1 + self.docs
        unique, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        for h, k in zip(unique.tolist(), first.tolist(), strict=True):
            if h not in self.terms:
                self.terms[h] = T.LOWER[block.data[starts[k] : ends[k]]].tobytes()
        pairs, times = np.unique(which.ravel() * np.int64(block.rows) + row, return_counts=True)
        self.parts.append((unique[pairs // block.rows], number[pairs % block.rows].astype(np.int64), times.astype(np.int64)))
        self.ids.append(ids.take(pa.array(full)))
        self.lengths.append(counts[full].astype(np.int64))
        self.words += len(hashes)
        self.docs += len(full)

    def batch(self, shard: int) -> pa.RecordBatch:
        """The shard's rows: one with its documents, then one for each term."""
        hashes, docs, times = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        lengths = np.concatenate(self.lengths)
        order = np.lexsort((docs, hashes))
        hashes, docs, times = hashes[order], docs[order], times[order]
        new = np.append(True, hashes[1:] != hashes[:-1])
        begin = np.flatnonzero(new)
        df = np.diff(np.append(begin, len(hashes)))
        place = np.arange(len(hashes)) - np.repeat(begin, df)
        starts = np.flatnonzero(place % BLOCK == 0)
        counts = np.diff(np.append(starts, len(hashes)))
        gaps = docs - np.where(new, -1, np.roll(docs, 1)) - 1
        blocks = pa.StructArray.from_arrays(
            [pa.array(docs[starts + counts - 1].astype(np.int32)), pa.array(counts.astype(np.int32)), *_tops(starts, times, lengths[docs]), _packed(starts, counts, gaps, times - 1)],
            ["last", "count", *_TOPS, "data"],
        )
        ends = np.append(0, np.cumsum(-(-df // BLOCK))).astype(np.int32)
        ids = pa.concat_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in self.ids])
        terms = len(df)
        own = pa.array([0, self.docs] + [self.docs] * terms, pa.int32())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(terms + 1, shard)),
                pa.array([None, *(self.terms[h] for h in hashes[begin].tolist())], pa.binary()),
                pa.array(np.append(0, df)),
                pa.ListArray.from_arrays(pa.array(np.append(0, ends)), blocks),
                pa.ListArray.from_arrays(own, ids),
                pa.ListArray.from_arrays(own, pa.array(lengths)),
            ],
            ["shard", "term", "df", "blocks", "ids", "lengths"],
        )


def _tops(starts: np.ndarray, times: np.ndarray, lengths: np.ndarray) -> list[pa.Array]:
    """Per block the shortest document with 1, 2, 3 and more occurrences (0: none), and the most occurrences."""
    none = np.iinfo(np.int32).max
    out = []
    for held in (times == 1, times == 2, times == 3, times > 3):
        least = np.minimum.reduceat(np.where(held, np.minimum(lengths, none - 1), none), starts)
        out.append(pa.array(np.where(least == none, 0, least).astype(np.int32)))
    return [*out, pa.array(np.maximum.reduceat(times, starts).astype(np.int32))]


def _packed(starts: np.ndarray, counts: np.ndarray, gaps: np.ndarray, more: np.ndarray) -> pa.Array:
    """Each block's gaps and further occurrences in as few bytes a number (0, 1, 2 or 4) as its largest needs."""

    def width(values: np.ndarray) -> np.ndarray:
        most = np.maximum.reduceat(values, starts)
        return np.select([most == 0, most < 1 << 8, most < 1 << 16], [0, 1, 2], 4)

    block = np.repeat(np.arange(len(starts)), counts)
    place = np.arange(len(gaps)) - starts[block]
    a, b = width(gaps), width(more)
    ends = np.append(0, np.cumsum(2 + counts * (a + b)))
    out = np.zeros(ends[-1], np.uint8)
    out[ends[:-1]], out[ends[:-1] + 1] = a, b
    for values, wide, base in ((gaps, a, ends[:-1] + 2), (more, b, ends[:-1] + 2 + counts * a)):
        for byte in range(4):
            held = wide[block] > byte
            of = block[held]
            out[base[of] + place[held] * wide[of] + byte] = (values[held] >> (8 * byte)) & 255
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(out)])


def _unpacked(data: bytes, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Gaps and further occurrences of a block."""
    wide = data[0], data[1]
    out, at = [], 2
    for w in wide:
        out.append(np.frombuffer(data, f"<u{w}", count, at).astype(np.int64) if w else np.zeros(count, np.int64))
        at += w * count
    return out[0], out[1]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard, made = _Shard(), 0
    part = TaskContext.get().partitionId() << 32
    for batch in batches:
        for block in T.blocks(batch.column("text")):
            shard.add(batch.column("doc_id").slice(block.first, block.rows), block)
            if shard.words >= SHARD_WORDS or shard.docs >= SHARD_DOCS:
                yield shard.batch(part + made)
                shard, made = _Shard(), made + 1
    if shard.docs:
        yield shard.batch(part + made)


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The inverted index of ``docs``, written to the shared folder.

    Terms are the runs of letters, digits and all characters beyond ASCII of the whole text, A-Z in
    lower case. Null, empty and other texts without a term aren't in it. A row for each shard
    (``term`` null) has the ids and lengths of its documents.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return stored(source.mapInArrow(_shards, INDEX_SCHEMA))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (item, term): the terms of each item, once each."""
    for batch in batches:
        for block in T.blocks(batch.column("text")):
            hashes, row, starts, ends = _words(block)
            first = np.unique(np.stack([row.astype(np.uint64), hashes]), axis=1, return_index=True)[1] if len(row) else np.zeros(0, np.int64)
            terms = [T.LOWER[block.data[starts[k] : ends[k]]].tobytes() for k in first.tolist()]
            items = batch.column("item").slice(block.first, block.rows).take(pa.array(row[first].astype(np.int64)))
            yield pa.RecordBatch.from_arrays([items, pa.array(terms, pa.binary())], ["item", "term"])


def _gain(weight: int, times: np.ndarray | int, norms: np.ndarray) -> np.ndarray:
    return weight * ((1_000_000_000 * times) // (1000 * times + 8 * norms))


class _Postings:
    """A term's postings in a shard; blocks are decompressed when they are asked for."""

    def __init__(self, weight: int, blocks: pa.StructArray, norms: np.ndarray, norm_of: Callable[[np.ndarray], np.ndarray]):
        self.weight, self.norms = weight, norms
        self.last, self.count, *least, most = (np.array(blocks.field(n)).astype(np.int64) for n in ("last", "count", *_TOPS))
        self.data = blocks.field("data")
        self.first = np.append(0, np.cumsum(self.count))
        self.there = np.zeros(len(self.last), bool)
        # Blocks that aren't decompressed hold their last document, so that the whole stays in order.
        self.docs = np.repeat(self.last, self.count)
        self.gains = np.zeros(len(self.docs), np.int64)
        times = (1, 2, 3, np.maximum(most, 1))
        self.bound = np.max([np.where(n > 0, _gain(weight, t, norm_of(n)), 0) for t, n in zip(times, least, strict=True)], axis=0)
        self.most = int(self.bound.max())

    def need(self, blocks: np.ndarray) -> None:
        for b in blocks[~self.there[blocks]].tolist():
            gaps, more = _unpacked(self.data[b].as_py(), int(self.count[b]))
            docs = np.cumsum(gaps + 1) + (self.last[b - 1] if b else -1)
            own = slice(self.first[b], self.first[b + 1])
            self.docs[own] = docs
            self.gains[own] = _gain(self.weight, more + 1, self.norms[docs])
            self.there[b] = True

    def between(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents in ``low .. high - 1`` and their gains."""
        a, b = np.searchsorted(self.last, [low, high])
        self.need(np.arange(a, min(b + 1, len(self.last))))
        a, b = np.searchsorted(self.docs, [low, high])
        return self.docs[a:b], self.gains[a:b]

    def block_of(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block where each document would stand, and its greatest gain; 0 beyond the last."""
        block = np.searchsorted(self.last, docs)
        return block, np.append(self.bound, 0)[block]

    def of(self, docs: np.ndarray, block: np.ndarray) -> np.ndarray:
        """The gain of each document, by blocks from ``block_of``."""
        held = block < len(self.last)
        self.need(np.unique(block[held]))
        at = np.minimum(np.searchsorted(self.docs, docs), len(self.docs) - 1)
        return np.where(self.docs[at] == docs, self.gains[at], 0)


class _Best:
    """The ``k`` best documents so far: highest score first, then the smallest id, those without id last."""

    def __init__(self, k: int, order: np.ndarray):
        self.k, self.order = k, order
        self.docs = self.scores = np.zeros(0, np.int64)

    @property
    def bar(self) -> int:
        """The score that a further document has to reach."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def take(self, docs: np.ndarray, scores: np.ndarray) -> None:
        docs, scores = np.concatenate([self.docs, docs]), np.concatenate([self.scores, scores])
        first = np.lexsort((self.order[docs], -scores))[: self.k]
        self.docs, self.scores = docs[first], scores[first]


def _search_shard(lists: list[_Postings], docs: int, best: _Best, step: int = RANGE_DOCS) -> None:
    """Fills ``best`` with the documents of a shard that gain most from ``lists``."""
    lists = sorted((x for x in lists if x.most > 0), key=lambda x: x.most)
    if not lists:
        return
    sums = np.cumsum([x.most for x in lists])
    for low in range(0, docs, step):
        high = min(docs, low + step)
        # Documents that are only in the first lists can't reach the bar.
        open_from = int(np.searchsorted(sums, best.bar, side="left"))
        if open_from == len(lists):
            return
        total = np.zeros(high - low, np.int64)
        for x in lists[open_from:]:
            own, gains = x.between(low, high)
            total[own - low] += gains
        rest = int(sums[open_from - 1]) if open_from else 0
        found = np.flatnonzero((total > 0) & (total + rest >= best.bar))
        score, found = total[found], found + low
        if open_from and len(found):
            places = [x.block_of(found) for x in lists[:open_from]]
            hope = score + sum(bound for _, bound in places)
            on = hope >= best.bar
            for x, (block, bound) in zip(lists[open_from - 1 :: -1], places[::-1], strict=True):
                some = np.flatnonzero(on & (bound > 0))
                gains = x.of(found[some], block[some])
                score[some] += gains
                hope[some] += gains - bound[some]
                on &= hope >= best.bar
            found, score = found[on], score[on]
        good = score >= best.bar
        if good.any():
            best.take(found[good], score[good])


def _ranked(items: list[tuple[int, list[tuple[int, int]]]], n_docs: int, n_words: int, k: int):
    """Rows (item, doc_id, score): the best of a shard for each item, given as (item, [(term number, weight)])."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        numbers = table.column("number").to_pylist()
        head = numbers.index(None)
        lengths = np.array(table.column("lengths")[head].values, np.int64)
        ids = table.column("ids")[head].values

        def norm_of(n: np.ndarray) -> np.ndarray:
            return 100 - 90 + (90 * n * n_docs) // n_words

        norms = norm_of(lengths)
        missing = np.array(ids.is_null())
        order = np.empty(len(lengths), np.int64)
        order[np.lexsort((np.array(ids.fill_null(0)), missing))] = np.arange(len(lengths))
        rows = {number: i for i, number in enumerate(numbers) if number is not None}
        lists: dict[int, _Postings] = {}
        out = [[], [], []]
        for item, terms in items:
            own = []
            for number, weight in terms:
                if number in rows and weight > 0:
                    if number not in lists:
                        lists[number] = _Postings(weight, table.column("blocks")[rows[number]].values, norms, norm_of)
                    own.append(lists[number])
            best = _Best(k, order)
            _search_shard(own, len(lengths), best)
            out[0].append(np.full(len(best.docs), item, np.int64))
            out[1].append(best.docs)
            out[2].append(best.scores)
        found = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
        return pa.table([pa.array(found[0]), ids.take(pa.array(found[1].astype(np.int64))), pa.array(found[2])], names=["item", "doc_id", "score"])

    return run


def search(index: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", k: int = 10, search_terms: int = SEARCH_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of ``index`` for each row of ``items``.

    With N documents that have a term, L terms with repeats in all of them, n terms in a document, df documents that
    hold a term and tf times that a document does: a term weighs w = floor(1000 ln((2 N + 2) / (2 df + 1))),
    a document's norm is m = 10 + (90 n N) div L, and its score the sum of
    w ((10^9 tf) div (1000 tf + 8 m)) over the item's terms, once each. Only scores above 0 are
    ranked; equal ones by ascending id, a null id last. An item without a term, or whose terms are in no document,
    has no rows; a repeated item (id and text) counts once, and items of one id with other texts are ranked each alone.
    """
    spark = index.sparkSession
    asked = stored(items.select(F.col(item_id).alias("item_id"), F.col(text).cast("string").alias("text")).distinct().withColumn("item", F.monotonically_increasing_id()))
    pairs = stored(asked.select("item", "text").mapInArrow(_terms, "item long, term binary"))
    size = index.where("term is null").agg(F.sum(F.size("ids")).alias("docs"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b)).alias("words")).first()
    n_docs, n_words = size["docs"] or 0, size["words"] or 1
    counts = index.where("term is not null").select("term", "df").join(pairs.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    weights = stored(counts.select("term", weight.cast("long").alias("weight")).where("weight > 0").withColumn("number", F.monotonically_increasing_id()))
    weighted = stored(pairs.join(weights, "term").select("item", "number", "weight", "term"))
    rounds = max(1, -(-weighted.count() // search_terms))
    found = None
    for i in range(rounds):
        # A bounded part of the items goes to all shards.
        part = weighted.where(F.pmod(F.xxhash64("item"), F.lit(rounds)) == i)
        rows = part.groupBy("item").agg(F.collect_list(F.struct("number", "weight")).alias("terms")).orderBy("item").collect()
        own = [(r["item"], [(t["number"], t["weight"]) for t in r["terms"]]) for r in rows]
        wanted = part.select("term", "number").distinct()
        lists = index.select("shard", "term", "blocks", "ids", "lengths").join(wanted, "term", "left").where("term is null or number is not null")
        best = lists.drop("term").groupBy("shard").applyInArrow(_ranked(own, n_docs, n_words, k), "item long, doc_id long, score long")
        found = best if found is None else found.unionByName(best)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
