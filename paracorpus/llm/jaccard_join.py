"""Exact join of documents by the Jaccard distance of their shingle sets, with pivots.

Jaccard distance is a metric, and documents that are no copies of each other lie at distance 1 from
nearly all pivots, where the triangle inequality says nothing. So the space is first dealt into
*neighbourhoods* that are certain to hold both ends of every link, and pivots rule inside these:

* A set of n shingles is cut into parts by a hash of the shingle. Two sets that differ in h
  shingles agree in all but h parts, so of the h + 1 first parts, in any fixed order of (part, content),
  one is common to both. Each set is a member of the neighbourhoods of its h + 1 largest parts.
* The smallest member of a neighbourhood is its pivot. All sets that meet a pivot in some
  neighbourhood form the pivot's region; the exact distance of each to the pivot is computed once. A set
  lies in the regions of several pivots: these are the replicas along the borders.
* Sets within the radius of the pivot are linked to it and so to each other. A set outside needs
  comparison only with sets whose distance to the pivot differs by at most the radius: that is the
  window. Regions where nothing is left outside, or all of one component, are done.
* A rest that fits a task is joined there: sets with too few shingles that any other set has are left out, then
  all others are counted. A larger rest is cut into blocks of which any two fit a task, and each two are joined
  in one, as a passage that many sets share would bring them together again in any new neighbourhood. One of more
  than `MOST_BLOCKS` blocks is dealt into neighbourhoods again, inside its region and with another hash, and
  the next pivots are taken from the sets left outside. Each round settles at least the pivots, so the
  recursion ends, and no pair is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paracorpus.llm.common import broadcast_if_small, giving_back, pin
from paracorpus.llm.components import connected_components
from paracorpus.llm.shingles import WORDS, mix, shingle_hashes

#: Link if 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Parts per shingle of the smallest set of a size class (sizes from 2^c to 2^(c + 1) - 1).
PARTS = 0.6
#: Shingles of a region's rest that one task joins, 8 bytes each; a larger rest is cut into blocks.
REST_ITEMS = 2_000_000
#: Blocks of a rest, each of which is copied once for each other; a larger rest goes to the next round.
MOST_BLOCKS = 32
#: Sets that are asked about at once. Shingles that one of so many sets has, and this many at least, stand in bit vectors.
TILE, SHARE, OFTEN = 32, 32, 16
SLACK = 1e-9


def most_differences(n: int, percent: int = PERCENT) -> int:
    """How many shingles a set of n and any set linked with it can differ in."""
    return (n + 100 * n // percent) * (100 - percent) // (100 + percent)


def part_keys(items: np.ndarray, round_: int, percent: int = PERCENT) -> np.ndarray:
    """The neighbourhoods of a set: keys of its largest parts, in each size class it can link in."""
    n, out = len(items), []
    lowest = n.bit_length() - 1
    highest = (100 * n // percent).bit_length() - 1
    keep = most_differences(n, percent) + 1
    for size_class in range(lowest, highest + 1):
        largest = (2 << size_class) - 1
        parts = max(int(PARTS * (1 << size_class)) + 1, most_differences(largest, percent) + 1)
        seed = mix(np.array([(round_ << 8) + size_class + 1], np.uint64))[0]
        spread = mix(items ^ seed)
        part = ((spread >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        placed = part[order]
        starts = np.flatnonzero(np.concatenate(([True], placed[1:] != placed[:-1])))
        held, sizes = placed[starts], np.diff(np.append(starts, n))
        sums = np.add.reduceat(mix(spread + np.uint64(1))[order], starts)
        if len(held) < keep:  # empty parts are parts like others, and come last
            empty = np.setdiff1d(np.arange(parts), held)
            held = np.concatenate((held, empty))
            sizes = np.concatenate((sizes, np.zeros(len(empty), sizes.dtype)))
            sums = np.concatenate((sums, np.zeros(len(empty), np.uint64)))
        keys = mix(sums ^ mix((held.astype(np.uint64) << np.uint64(8)) ^ seed))
        out.append(keys[np.lexsort((keys, -sizes))[:keep]])
    return np.concatenate(out) if out else np.array([], np.uint64)


def set_key(items: np.ndarray) -> int:
    """A 64-bit fingerprint of a whole set, as a signed number."""
    both = np.array([np.bitwise_xor.reduce(items), mix(items).sum(dtype=np.uint64)], np.uint64)
    return int((mix(both[:1] ^ mix(both[1:]))).view(np.int64)[0])


def deal(docs: DataFrame, percent: int, words: int) -> DataFrame:
    """place, key, doc_id, n: a row for each document (doc_id and n set, placed by its key) and one
    for each neighbourhood of its set. Copies of a set inside a task are dealt once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealt: set[int] = set()
        names = ["place", "key", "doc_id", "n"]
        for batch in batches:
            places, keys, rows, held = [], [], [], 0
            for i, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                items = shingle_hashes(text.as_py() or "", words)
                key = set_key(items) if len(items) else 0
                rows.append((key, doc_id, len(items)))
                if len(items) and key not in dealt:
                    dealt.add(key)
                    found = part_keys(items, 0, percent).view(np.int64)
                    places.append(found)
                    keys.append(np.full(len(found), key, np.int64))
                    held += len(found)
                if held > 200_000 or i == batch.num_rows - 1:
                    own, ids, sizes = (list(c) for c in zip(*rows))
                    # Document rows are spread by key and id; only their neighbourhood rows must meet.
                    apart = mix(np.array(own, np.int64).view(np.uint64) + mix(np.array([x or 0 for x in ids], np.int64).view(np.uint64)))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.concatenate([apart.view(np.int64), *places])),
                        pa.array(np.concatenate([np.array(own, np.int64), *keys])),
                        pa.chunked_array([pa.array(ids, pa.int64()), pa.nulls(held, pa.int64())]).combine_chunks(),
                        pa.chunked_array([pa.array(sizes, pa.int64()), pa.nulls(held, pa.int64())]).combine_chunks(),
                    ], names)
                    places, keys, rows, held = [], [], [], 0

    return docs.mapInArrow(giving_back(run), "place long, key long, doc_id long, n long")


def sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """key, n, items (sorted hashes) of the sets named in `wanted` (doc_id, key), and of all rows
    without an id, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, items = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = shingle_hashes(text.as_py() or "", words)
                own = set_key(found) if len(found) else None
                if own is not None and key in (None, own):  # else another row with the same id
                    keys.append(own)
                    items.append(found.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(items, pa.list_(pa.int64()))],
                ["key", "n", "items"],
            )

    named = docs.join(broadcast_if_small(wanted), "doc_id").select("key", "text")
    # Rows without an id cannot be looked up by it; their keys come from their texts.
    nameless = docs.where("doc_id is null").select(F.lit(None).cast("long").alias("key"), "text")
    texts = named.unionByName(nameless)
    return texts.mapInArrow(giving_back(run), "key long, n long, items array<long>").dropDuplicates(["key"])


def redeal(rest: DataFrame, sets: DataFrame, round_: int, percent: int) -> DataFrame:
    """region, key, outside, component, place: new neighbourhoods of the sets left in a region."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [part_keys(np.array(x.as_py(), np.int64).view(np.uint64), round_, percent).view(np.int64) for x in batch]
            yield pa.array(found, pa.list_(pa.int64()))

    keys = sets.join(rest.select("key").distinct(), "key").select("key", F.arrow_udf(run, "array<long>")("items").alias("parts"))
    return rest.join(keys, "key").select(
        "key", "outside", "component", F.explode("parts").alias("part"), "region"
    ).select("key", "outside", "component", F.xxhash64("region", "part").alias("place"))


def compare(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, distance, linked for distinct pairs of keys, from the whole sets."""
    left = sets.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("items").alias("ia"))
    right = sets.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("items").alias("ib"))
    common = F.size(F.array_intersect("ia", "ib"))
    both = broadcast_if_small(pairs).join(right, "b").join(left, "a").select("a", "b", common.alias("common"), (F.col("na") + F.col("nb") - common).alias("union"))
    return both.select(
        "a", "b", (1 - F.col("common") / F.col("union")).alias("distance"),
        (100 * F.col("common") >= percent * F.col("union")).alias("linked"),
    )


def _regions(members: DataFrame) -> DataFrame:
    """pivot, key, outside, component, distinct, from place, key, outside, component: the smallest
    set left outside is the pivot of a neighbourhood; without one, or alone, there is nothing to do."""
    group = W.partitionBy("place")
    with_pivot = members.withColumn("pivot", F.min(F.when(F.col("outside"), F.col("key"))).over(group))
    return with_pivot.where("pivot <> key").select("pivot", "key", "outside", "component").distinct()


def jaccard_links(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(documents, components): doc_id, key, n of every document; key, root of every linked set.

    `docs` has doc_id and text. Components are exact: two sets have the same root if and only if a
    chain of links joins them. Links that the triangle inequality or an earlier link already puts
    into one component are not listed.
    """
    group = W.partitionBy("place")
    dealt = deal(docs, percent, words).repartition("place")
    # Neighbourhoods of one set are of no use; document rows pass through.
    members = dealt.withColumn("_least", F.min("key").over(group)).withColumn("_most", F.max("key").over(group))
    kept = pin(members.where("doc_id is not null or n is not null or _least <> _most").drop("_most"), "dealt")
    documents = kept.where("n is not null").select("doc_id", "key", "n")
    shared = kept.where("n is null").select("_least", "key").distinct()
    regions = pin(shared.where("_least <> key").withColumnRenamed("_least", "pivot"), "regions")
    named = regions.select("key").union(regions.select("pivot")).distinct()
    wanted = documents.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id")).join(named, "key")
    sets = pin(sets_of(docs, pin(wanted, "wanted"), words), "sets")
    regions = regions.withColumn("outside", F.lit(True)).withColumn("component", F.col("key"))
    radius, links, round_ = 1 - percent / 100, None, 0
    while True:
        pairs = regions.select(F.least("pivot", "key").alias("a"), F.greatest("pivot", "key").alias("b")).distinct()
        measured = pin(compare(pin(pairs, "pairs"), sets, percent), "measured")
        found = measured.where("linked").select("a", "b")
        links = found if links is None else pin(links.union(found), "links")
        roots = connected_components(links)
        rest = _rest(regions, measured, roots, sets, radius)
        found = pin(join_rests(rest.where(_blocks() <= MOST_BLOCKS), sets, percent), "linked")
        if not found.isEmpty():
            links = pin(links.union(found), "links")
            roots = connected_components(links)
        many = rest.where(_blocks() > MOST_BLOCKS).select(F.col("pivot").alias("region"), "key", "outside", "component")
        if many.isEmpty():
            return documents, roots.withColumnRenamed("node", "key")
        round_ += 1
        regions = pin(_regions(redeal(many, sets, round_, percent)), "regions")


def _rest(regions: DataFrame, measured: DataFrame, roots: DataFrame, sets: DataFrame, radius: float) -> DataFrame:
    """pivot, key, distance, outside, component, items: what is left of each region.

    Pairs still to compare have a set that was outside, and two components. All sets of the pivot's
    component may stop being outside if every set of another component still is: those pairs have
    one end outside then. Sets stay only within the window of some set outside, by distance to the
    pivot, and only regions with two components are left. items: shingles of the whole rest.
    """
    least, most = F.least("pivot", "key"), F.greatest("pivot", "key")
    component = roots.select(F.col("node").alias("key"), "root")
    of_pivot = roots.select(F.col("node").alias("pivot"), F.col("root").alias("pivot_root"))
    placed = (
        regions.select("pivot", "key", F.col("outside").alias("was_outside"), least.alias("a"), most.alias("b"))
        .join(measured.select("a", "b", "distance"), ["a", "b"])
        .join(component, "key", "left")
        .join(of_pivot, "pivot", "left")
        .withColumn("component", F.coalesce("root", "key"))
        .withColumn("other", F.col("component") != F.coalesce("pivot_root", "pivot"))
    )
    bound = placed.groupBy("pivot").agg(F.bool_or(F.col("other") & ~F.col("was_outside")).alias("bound"))
    placed = placed.join(bound, "pivot").withColumn("outside", F.col("was_outside") & (F.col("other") | F.col("bound")))
    whole = (
        placed.groupBy("pivot")
        .agg(
            F.min(F.when(F.col("outside"), F.col("distance"))).alias("nearest"),
            F.max(F.when(F.col("outside"), F.col("distance"))).alias("farthest"),
            F.count_if("outside").alias("n_outside"),
            F.min("component").alias("c0"),
            F.max("component").alias("c1"),
        )
        .where("n_outside > 0 and c0 <> c1")
        .drop("c0", "c1", "n_outside")
    )
    window = (F.col("distance") >= F.col("nearest") - radius - SLACK) & (F.col("distance") <= F.col("farthest") + radius + SLACK)
    rest = pin(placed.join(whole, "pivot").where(window).select("pivot", "key", "distance", "outside", "component"), "rest")
    sized = rest.join(sets.select("key", "n"), "key").groupBy("pivot").agg(F.sum("n").alias("items"))
    return rest.join(sized, "pivot")


def _blocks() -> Column:
    """Blocks of a rest, by its items: one if it fits a task, else as many that any two fit."""
    items = F.col("items")
    return F.when(items <= REST_ITEMS, 1).otherwise(F.ceil(2 * items / F.lit(max(REST_ITEMS, 0.5))))


def _paired(rest: DataFrame) -> DataFrame:
    """`rest` with the group that a task joins: the whole region, or each two of its blocks. Any two sets meet in a group."""
    cut = rest.withColumn("blocks", _blocks()).withColumn("own", F.pmod(F.xxhash64("key"), "blocks"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1), lambda x: x != F.col("own"))
    group = lambda x: F.least("own", x) * MOST_BLOCKS + F.greatest("own", x)
    groups = F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.transform(others, group))
    return cut.withColumn("group", F.explode(groups)).drop("items", "blocks", "own")


class _Common:
    """How many shingles some sets of a group have in common with each set. Shingles of many sets are counted by bit
    vectors over the sets, the others by lists of their sets."""

    def __init__(self, items: np.ndarray, n: np.ndarray) -> None:
        self.sets, owner = len(n), np.repeat(np.arange(len(n)), n)
        _, shingle, times = np.unique(items, return_inverse=True, return_counts=True)
        often = np.flatnonzero(times >= max(OFTEN, self.sets // SHARE))
        place = np.full(len(times), -1)
        place[often] = np.arange(len(often))
        held = place[shingle]
        self.bits = np.zeros((-(-len(often) // 64), self.sets), np.uint64)
        many = held >= 0
        np.bitwise_or.at(self.bits, (held[many] // 64, owner[many]), np.uint64(1) << (held[many] % 64).astype(np.uint64))
        few = ~many & (times[shingle] > 1)
        self.own, owner = shingle[few], owner[few]
        self.ends = np.append(0, np.cumsum(np.bincount(owner, minlength=self.sets)))
        self.times = np.bincount(self.own, minlength=len(times))
        self.starts = np.cumsum(self.times) - self.times
        self.owner = owner[np.argsort(self.own, kind="stable")]

    def counts(self, asked: np.ndarray) -> np.ndarray:
        """A row for each of the sets `asked`, a column for each other set; a set's own lacks what it alone has."""
        found = np.zeros((len(asked), self.sets), np.int64)
        for word in self.bits:
            found += np.bitwise_count(word[asked][:, None] & word)
        for row, i in zip(found, asked.tolist()):
            own = self.own[self.ends[i] : self.ends[i + 1]]
            many = self.times[own]
            stop = np.cumsum(many)
            hits = np.arange(stop[-1] if len(stop) else 0) + np.repeat(self.starts[own] - stop + many, many)
            row += np.bincount(self.owner[hits], minlength=self.sets)
        return found


def _able(items: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Which sets of a group have as many shingles that another set has too as a link with the smallest one takes."""
    _, shingle, times = np.unique(items, return_inverse=True, return_counts=True)
    met = np.add.reduceat(np.append(times[shingle] > 1, False), np.cumsum(n) - n, dtype=np.int64)
    return (100 + percent) * met >= percent * (n + n.min())


def join_rests(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links that join the components of each region's rest, one for each two that meet.

    A task's group is a region or two of its blocks, of about `REST_ITEMS` shingles. Sets within the window and of
    another component than a set outside are compared with it by their counts. A link merges two components
    at once, so a group of n sets gives fewer than n links.
    """
    radius = 1 - percent / 100

    def join(region: pa.Table) -> pa.Table:
        lists = region["items"].combine_chunks()
        items, n = np.asarray(lists.flatten(), np.int64), np.asarray(lists.value_lengths(), np.int64)
        keys, components = np.asarray(region["key"]), np.asarray(region["component"]).copy()
        distance, outside = np.asarray(region["distance"]), np.asarray(region["outside"])
        able = _able(items, n, percent)
        a, b = [np.array([], np.int64)], [np.array([], np.int64)]
        if (able & outside).any():
            items, n, keys, components, distance, outside = items[np.repeat(able, n)], n[able], keys[able], components[able], distance[able], outside[able]
            common, asking = _Common(items, n), np.flatnonzero(outside)
            for lo in range(0, len(asking), TILE):
                for i, shared in zip(asking[lo : lo + TILE], common.counts(asking[lo : lo + TILE])):
                    near = (components != components[i]) & (np.abs(distance - distance[i]) <= radius + SLACK)
                    linked = np.flatnonzero(near & (100 * shared >= percent * (n[i] + n - shared)))
                    joined, some = np.unique(components[linked], return_index=True)
                    a.append(np.full(len(joined), keys[i]))
                    b.append(keys[linked[some]])
                    components[np.isin(components, joined)] = components[i]
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    full = _paired(rest).join(sets.select("key", "items"), "key")
    return full.groupBy("pivot", "group").applyInArrow(join, "a long, b long").distinct()


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, words: int = WORDS
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id reachable by links).

    A null or empty text, or one without words, has no shingles and is linked with nothing; its
    component is its own id. Texts with the same shingles are linked, so repeated rows share a
    component. A null id is reached like others, but is a component's id only if all its ids are
    null. No rows in, no rows out. Other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    documents, roots = jaccard_links(texts, percent, words)
    rooted = documents.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = rooted.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("size"))
    grouped = least.where("size > 1").drop("size")
    return rooted.withColumn("root", F.when(F.col("n") > 0, F.col("root"))).join(grouped, "root", "left").select(
        F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def keep_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, words: int = WORDS
) -> DataFrame:
    """The rows of `docs` that stay if of each linked group the one with the smallest id does.

    Rows are known by a hash of id and text, as ids may repeat with other texts: of such rows each is in
    the group of its own text. Of equal smallest ids one row stays, and rows alike in id and text stay or
    go together. A null id loses against any other. Rows without words all stay.
    """
    row = F.xxhash64(F.col(id_col), F.coalesce(text_col, F.lit("")))
    rows = docs.select(row.alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    groups = pin(jaccard_components(rows, "_row", "_text", percent, words).select("_row", F.col("component_id").alias("_group")).distinct(), "groups")
    order = F.struct(F.col("_id").isNull().alias("no_id"), "_id", "_row")
    named = rows.select("_row", "_id").join(groups, "_row")
    stay = named.groupBy("_group").agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_size"))
    stay = stay.where("_size > 1").select("_group", F.col("_first._row").alias("_stays"))
    dropped = pin(groups.join(stay, "_group").where("_row <> _stays").select(F.col("_row").alias("_dropped")), "dropped")
    return docs.join(broadcast_if_small(dropped), F.xxhash64(docs[id_col], F.coalesce(docs[text_col], F.lit(""))) == dropped["_dropped"], "left_anti")
