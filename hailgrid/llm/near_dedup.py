"""Near-duplicate documents by bottom-k sketches of word shingles.

1. Each text becomes the set of its word shingles. One hash function orders them;
   the ``k`` least are the sketch. Texts with the same set form one class.
2. Inverted lists of the retained values give overlaps. A value that only one
   class retains links nothing; a class that shares fewer values than a similar
   pair must is done. Of the others only the rarest values are listed, as many as
   any similar pair must meet in.
3. Each list has one hub, the member with the fewest values of its own. A class is
   compared with the most central hub of its lists instead of with all members. The sketch of the union estimates the
   Jaccard similarity and filters; the full sets decide.
4. Only lists whose members are still in several components hold further pairs. In
   a few further turns each of their classes meets some hubs of other components, drawn
   anew, as long as this joins components.
5. What is left open after that meets on the rarest shingles of the full sets, with bounds on
   length and position, so no similar pair in different components is passed over.

A pair with Jaccard similarity ``threshold`` shares in mean ``threshold * k`` of the
least ``k`` values of its union. The slack below is 6.5 standard deviations (a chance
of about 1e-9 to miss such a pair); texts with at most ``k`` shingles have no such risk.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hailgrid.checkpoints import keep, materialise
from hailgrid.llm import text as T
from hailgrid.llm.graph import components
from hailgrid.llm.storage import release, stored

SIGMAS = 6.5
# Further turns of hubs go on while this share of their pairs is similar.
LEAST_YIELD = 0.05
TURNS = 3
# Hubs that a class meets in a turn.
HUBS = 8
# Shingles before a place of a prefix that are compared, so that a pair is met once.
BEFORE = 8
# Bits of a set's parity map, as 64-bit words.
PARITY_WORDS = 8


def _sets(block: T.Block, n: int, is_word: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted shingle hashes of each text of a block."""
    found = T.words(block, is_word)
    hashes, bounds = T.grams(found, n), found.of_row
    for first, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if end - first >= n:
            yield np.unique(hashes[first : end - n + 1])
        elif end > first:
            yield np.array([T.whole_gram(found.hashes[first:end])], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def _set_ids(own: np.ndarray) -> tuple[int, int]:
    """Two independent hashes of a set."""
    return tuple(int(T.mix(own + np.uint64(salt)).sum(dtype=np.uint64).view(np.int64)) for salt in (0, 0x51ED270B7A3F4C25))


def _parity(own: np.ndarray) -> np.ndarray:
    """For each of the map's bits, whether an odd number of a set's hashes fall on it.

    A shingle that only one of two sets has changes one bit of one map: maps that differ
    in more bits than similar sets can differ in shingles rule the pair out for certain.
    """
    odd = np.bincount((own & np.uint64(64 * PARITY_WORDS - 1)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sketches(n: int, k: int, word: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_word = T.is_word_byte(word)
        for batch in batches:
            for block in T.blocks(batch.column("text")):
                sizes, ids, least = [], [], []
                for own in _sets(block, n, is_word):
                    sizes.append(len(own))
                    ids.append(_set_ids(own))
                    # Sorting hashes as signed numbers is the order of the one hash function.
                    least.append(np.sort(own.view(np.int64))[:k])
                part = batch.slice(block.first, block.rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("row_key"),
                        pa.array(sizes, pa.int64()),
                        pa.array([i for i, _ in ids], pa.int64()),
                        pa.array([j for _, j in ids], pa.int64()),
                        pa.ListArray.from_arrays(np.cumsum([0, *map(len, least)]).astype(np.int32), pa.array(np.concatenate(least))),
                    ],
                    ["doc_id", "row_key", "n_shingles", "set_a", "set_b", "sketch"],
                )

    return run


def _full_sets(n: int, word: str):
    """The whole set of each text that is that of the wanted class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_word = T.is_word_byte(word)
        for batch in batches:
            for block in T.blocks(batch.column("text")):
                part = batch.slice(block.first, block.rows)
                sets = list(_sets(block, n, is_word))
                wanted = zip(part.column("set_a").to_pylist(), part.column("set_b").to_pylist(), strict=True)
                right = [i for i, (own, ids) in enumerate(zip(sets, wanted, strict=True)) if _set_ids(own) == ids]
                if right:
                    rows = [np.sort(sets[i].view(np.int64)) for i in right]
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("id").take(pa.array(right)),
                            pa.ListArray.from_arrays(np.cumsum([0, *map(len, rows)]).astype(np.int32), pa.array(np.concatenate(rows))),
                            pa.array([_parity(sets[i]).tolist() for i in right], pa.list_(pa.int64())),
                        ],
                        ["id", "shingles", "parity"],
                    )

    return run


def _needed(size: Column, k: int, threshold: float) -> Column:
    """The least overlap of a sketch with that of any similar text."""
    complete = F.ceil(F.lit(threshold) * size)
    # A partner has at most size / threshold shingles: both sketches are complete up to there.
    sampled = max(1, math.floor(threshold * k - SIGMAS * math.sqrt(k * threshold * (1 - threshold))))
    return F.when(size <= int(k * threshold), F.greatest(F.lit(1), complete)).otherwise(F.least(F.lit(sampled), F.greatest(F.lit(1), complete)))


def _similar(common: Column, a: Column, b: Column, percent: int) -> Column:
    return 100 * common >= percent * (a + b - common)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("of_b"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("of_a", "of_b"))
    return both.where(_similar(common, F.size("of_a"), F.size("of_b"), percent)).select("a", "b")


def _estimated(pairs: DataFrame, classes: DataFrame, k: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose similarity, estimated from the sketch of the union, may reach the threshold."""
    left = classes.select(F.col("id").alias("a"), F.col("sketch").alias("of_a"), F.col("n_shingles").alias("n_a"))
    right = classes.select(F.col("id").alias("b"), F.col("sketch").alias("of_b"), F.col("n_shingles").alias("n_b"))
    union = F.slice(F.array_sort(F.array_union("of_a", "of_b")), 1, k)
    common = F.size(F.array_intersect(union, F.array_intersect("of_a", "of_b")))
    least = F.floor(threshold * F.size(union) - SIGMAS * F.sqrt(F.size(union) * F.lit(threshold * (1 - threshold))))
    in_length = F.least("n_a", "n_b") >= F.floor(threshold * F.greatest("n_a", "n_b"))
    return pairs.join(left, "a").join(right, "b").where(in_length).where(common >= least).select("a", "b")


def _mixed(marked: DataFrame) -> DataFrame:
    """The rows (id, value, component) of the lists whose members are in several components."""
    ends = marked.groupBy("value").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    return marked.join(ends.select("value"), "value", "left_semi")


def _met(marked: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of each class of a mixed list with hubs of other components, drawn anew in each turn.

    A list's hub is its member with the least hash; the members of the hub's own component take the
    one with the least hash of the others. Of its lists' hubs a class takes the ``HUBS`` with the least hashes.
    """
    drawn = F.struct(F.xxhash64("id", F.lit(turn)).alias("draw"), "id", "component")
    first = marked.groupBy("value").agg(F.min(drawn).alias("first"))
    others = marked.join(first, "value").where(F.col("component") != F.col("first.component"))
    second = others.groupBy("value").agg(F.min("first").alias("first"), F.min(drawn).alias("second"))
    hub = F.when(F.col("component") == F.col("first.component"), F.col("second")).otherwise(F.col("first"))
    drawn_hubs = F.slice(F.array_sort(F.collect_set(hub)), 1, HUBS)
    pairs = marked.join(second, "value").groupBy("id").agg(drawn_hubs.alias("hubs")).select("id", F.explode("hubs").alias("hub"))
    return pairs.select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")).distinct()


def _exact_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of ``members`` (id, component) in different components that may be similar, by prefixes of the full sets.

    A similar pair has at least ceil(percent * larger / 100) shingles in common, so
    it meets in the rarest n - ceil(percent * n / 100) + 1 of each. A shingle of one
    class links nothing. The shingles from the meeting place on bound the overlap, and
    the parity maps the difference, so hardly a pair that isn't similar leaves the join.
    A pair is left out where one of the ``BEFORE`` shingles before is common too: it has
    met there, so no pair is lost, and few leave the join more than once.
    """
    held = members.join(sets, "id").select("id", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    common = held.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    ranked = held.join(common, "shingle").groupBy("id", "component", "n").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("ordered"))
    own = F.col("n") - F.size("ordered")
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - own
    def entry(e: Column, i: Column) -> Column:
        before = F.slice("ordered", F.greatest(i + 1 - BEFORE, F.lit(1)), F.least(i, F.lit(BEFORE)))
        return F.struct(i.alias("place"), e["shingle"].alias("shingle"), F.transform(before, lambda x: x["shingle"]).alias("earlier"))

    entries = F.transform(F.slice("ordered", F.lit(1), length.cast("int")), entry)
    prefix = ranked.where(length > 0).select("id", "component", "n", own.alias("own"), F.inline(entries))
    parity = [f"p{i}" for i in range(PARITY_WORDS)]
    maps = sets.select("id", *[F.get("parity", F.lit(i)).alias(p) for i, p in enumerate(parity)])
    prefix = prefix.select("id", "component", "n", "shingle", "earlier", (F.col("n") - F.col("own") - F.col("place")).alias("rest")).join(maps, "id")
    a, b = prefix.alias("a"), prefix.alias("b")
    most = F.least("a.rest", "b.rest")
    met = (
        (F.col("a.shingle") == F.col("b.shingle"))
        & (F.col("a.id") < F.col("b.id"))
        & (F.col("a.component") != F.col("b.component"))
        & (100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n"))
        # The first place where two prefixes meet is their rarest common shingle: no more than the rest can follow.
        & _similar(most, F.col("a.n"), F.col("b.n"), percent)
        & ((100 + percent) * sum(F.bit_count(F.col(f"a.{p}").bitwiseXOR(F.col(f"b.{p}"))) for p in parity) <= (100 - percent) * (F.col("a.n") + F.col("b.n")))
        & ~F.arrays_overlap("a.earlier", "b.earlier")
    )
    return a.join(b, met).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle_words: int = 5, percent: int = 80, k: int = 64, word: str = "space"
) -> DataFrame:
    """Class and component of each row of ``docs``: ``doc_id, n_shingles, component_id, kept, row_key, component, first_row``.

    Two texts are linked if 100 * intersection >= percent * union of their shingle
    sets. ``component_id`` is the least id that links reach. ``kept`` marks the
    documents with that id; ``first_row`` counts the rows of the component that carry
    it, more than 1 where a row is repeated. A text with fewer words than a shingle is
    one shingle; null, empty and blank texts have none and are linked with nothing.
    A null id takes part; it is a component's id, and kept, only where no row of the
    component has one. Extra columns are ignored; an empty table gives no rows.
    """
    threshold = percent / 100
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    source = source.withColumn("row_key", T.text_key("doc_id", "text"))
    spark = docs.sparkSession
    rows = stored(
        source.mapInArrow(
            _sketches(shingle_words, k, word),
            "doc_id long, row_key long, n_shingles long, set_a long, set_b long, sketch array<long>",
        )
    )
    classes = keep(
        rows.where("n_shingles > 0")
        .groupBy("set_a", "set_b")
        .agg(F.min("doc_id").alias("least_id"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.first("row_key").alias("row_key"))
        .withColumn("id", F.monotonically_increasing_id())
    )
    release(spark)

    # Inverted lists of the values that several classes retain.
    values = classes.select("id", F.explode("sketch").alias("value"))
    shared = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    need = _needed(F.col("n_shingles"), k, threshold)
    held = (
        values.join(shared, "value")
        .groupBy("id")
        .agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("ordered"))
        .join(classes.select("id", "n_shingles", F.size("sketch").alias("retained")), "id")
        .withColumn("place", F.size("ordered") - need + 1)
        .where("place > 0")
    )
    lists = keep(
        held.select(
            "id", "n_shingles", (1 - F.size("ordered") / F.col("retained")).alias("own"), F.explode(F.slice("ordered", F.lit(1), F.col("place").cast("int"))).alias("entry")
        ).select("id", "n_shingles", "own", F.col("entry.value").alias("value"))
    )
    release(spark)
    alive = lists.select("id").distinct().join(classes.select("id", "set_a", "set_b", "row_key"), "id")
    sets = stored(
        source.join(alive, "row_key")
        .select("id", "text", "set_a", "set_b")
        .mapInArrow(_full_sets(shingle_words, word), "id long, shingles array<long>, parity array<long>")
        .groupBy("id")
        .agg(F.first("shingles").alias("shingles"), F.first("parity").alias("parity"))
    )
    release(spark)

    hubs = lists.groupBy("value").agg(F.min(F.struct("own", "id")).alias("hub"), F.count("*").alias("members")).where("members > 1")
    # One hub for each class, the most central of its lists': as many pairs as classes.
    stars = lists.join(hubs.select("value", "hub"), "value").groupBy("id").agg(F.min("hub").alias("hub")).select(F.col("hub.id").alias("a"), F.col("id").alias("b")).where("a <> b")
    links = keep(_confirmed(_estimated(stars, classes, k, threshold), sets, percent))
    release(spark)

    # What the stars leave open: lists whose members are in several components.
    found = keep(components(links))
    release(spark)
    marked = lists.join(found, "id", "left").select("id", "value", F.coalesce("component", "id").alias("component"))
    marked = keep(_mixed(marked))
    near = stored(sets.join(marked.select("id").distinct(), "id", "left_semi"))
    release(spark)
    for turn in range(TURNS):
        pairs, tried = materialise(_met(marked, turn))
        release(spark)
        if not tried:
            break
        joined, n_joined = materialise(_confirmed(_estimated(pairs, classes, k, threshold), near, percent))
        release(spark)
        if n_joined:
            links = links.union(joined)
            of = marked.select("id", "component").distinct()
            ends = joined.join(of.toDF("a", "of_a"), "a").join(of.toDF("b", "of_b"), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
            merged = keep(components(ends)).toDF("component", "root")
            marked = marked.join(merged, "component", "left").select("id", "value", F.coalesce("root", "component").alias("component"))
            marked = keep(_mixed(marked))
            release(spark)
        if n_joined < LEAST_YIELD * tried:
            # Few of those left are similar.
            break
    members = keep(marked.select("id", "component").distinct())
    release(spark)
    more = keep(_confirmed(_exact_pairs(members, near, percent), near, percent))
    release(spark)

    linked = keep(components(links.union(more))).join(classes.select("id", "least_id"), "id")
    joined = linked.groupBy("component").agg(F.min("least_id").alias("least"))
    of_class = (
        classes.select("id", "set_a", "set_b", "least_id")
        .join(linked.select("id", "component"), "id", "left")
        .join(joined, "component", "left")
        .select("set_a", "set_b", F.col("id").alias("class"), F.coalesce("component", "id").alias("component"), F.coalesce("least", "least_id").alias("component_id"))
    )
    labelled = rows.drop("sketch").join(of_class, ["set_a", "set_b"], "left")
    # Rows that stand for their component: those with its id. Repeated rows are counted.
    heads = labelled.where(F.col("component").isNotNull() & F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.count("*").alias("first_row"))
    return labelled.join(heads, "component", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        ((F.col("n_shingles") == 0) | F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"),
        "row_key",
        "component",
        F.coalesce("first_row", F.lit(1)).alias("first_row"),
    )


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` of which one stays per component, with all their columns; see ``near_duplicates``."""
    found = near_duplicates(docs, doc_id, text, **settings).where("kept")
    wanted = found.groupBy(F.col("row_key").alias("key")).agg(F.max("first_row").alias("rows"), F.max("component").alias("group"))
    keyed = docs.select(F.struct("*").alias("row"), F.xxhash64(F.col(doc_id).cast("long"), F.col(text).cast("string"), F.col(text).isNull()).alias("key"))
    rows = keyed.join(wanted, "key")
    # Where several rows of a component carry its id, one of them stays.
    window = Window.partitionBy("group").orderBy(F.to_json("row"))
    repeated = rows.where("rows > 1").withColumn("place", F.row_number().over(window)).where("place = 1")
    return rows.where("rows = 1").select("row.*").union(repeated.select("row.*"))
