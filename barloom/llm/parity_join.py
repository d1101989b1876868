"""Jaccard join over word n-grams by parity sketches.

A document is its set of n-grams. Two sets with similarity of t percent and sizes a and b differ in at most
D = (100 - t) * (a + b) // (100 + t) elements. Every element toggles one bit of a sketch of bands of 2**24 bits; the
Hamming distance of two sketches is at most the number of differing elements. With D + 1 + x bands, at least 1 + x bands
of a similar pair are equal bit for bit, so pairs are found by equal joins on bands (pigeonhole), and then verified on
the whole sets.

* Size classes: a class holds sizes up to 100 / t times its smallest. A set goes to its own class and, if a set there
  can be similar, to the class below, so both sets of a pair meet in the class of the smaller one, with one D.
* An empty band says nothing and is not joined on. A set with more than x empty bands, for which that could lose a pair,
  joins on its empty bands as well; of any other pair one of the 1 + x equal bands has bits.
* Equal sets are folded to one representative before the join.
* Bands are dealt to buckets as flat arrays; a bucket tells which representatives share a band, one row per
  representative and distinct group of them, however many bands the group shares.
* Groups are not paired out. All members are compared with one hub, links are joined to components, and another hub is
  tried against members of other components. Inside groups that still hold several components, members of different
  components meet only if the Hamming distance of their whole sketches (WORDS * 64 bits) allows a link: the join's own
  condition, so no other pair becomes a row. What comes out is verified on the sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.anchors import NO_ID, own_columns
from barloom.llm.common import Rolling, chunked, load, mix, query, stage, word_bounds, word_hashes

#: Bits of a band's number of bits; entries a task holds before it sends them; entries of a bucket, about.
BAND_BITS, HELD, BUCKET = 24, 1_000_000, 300_000
#: Rounds of comparing groups with one hub each; 64-bit words of a whole sketch.
HUBS, WORDS = 2, 32
_BYTES, _WORDS = Rolling(51), Rolling(52)


# --- sets -----------------------------------------------------------------------------------------------


def shingles(raw: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the n-grams of every row. Words have A-Z in lower case; fewer words make one n-gram."""
    start, end, bounds = word_bounds(raw, offsets)
    words = word_hashes(raw, start, end, _BYTES, lower=True)
    prefix = _WORDS.prefix(words)
    n = len(words)
    full = mix(_WORDS.of(prefix, slice(0, n - width + 1), slice(width, n + 1))) if n >= width else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(full[a : b - width + 1]))
        elif b > a:
            out.append(mix(_WORDS.of(prefix, np.array([a]), np.array([b])) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_rows(docs: DataFrame, width: int) -> DataFrame:
    """id, part, n (size of the set) and a 128-bit sum over the set, which equal sets share."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offsets in chunked(batches):
            sets = shingles(raw, offsets, width)
            sizes = np.array([len(s) for s in sets])
            held = np.concatenate([*sets, np.zeros(1, np.uint64)])
            sums = []
            for salt in (1, 2):
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(held + np.uint64(salt)))))
                ends = np.cumsum(sizes)
                sums.append((total[ends] - total[ends - sizes]).view(np.int64))
            columns = [batch.column("id"), batch.column("part"), pa.array(sizes), *map(pa.array, sums)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "part", "n", "sum1", "sum2"])

    return docs.mapInArrow(work, "id bigint, part bigint, n bigint, sum1 bigint, sum2 bigint")


# --- bands ----------------------------------------------------------------------------------------------


def size_classes(most: int, percent: int) -> np.ndarray:
    """Largest sizes of the classes, in order, up to size `most`."""
    out, low = [], 1
    while True:
        high = max(low, 100 * low // percent)
        out.append(high)
        if high >= most:
            return np.array(out)
        low = high + 1


def difference(high: np.ndarray | int, percent: int):
    """Most elements in which sets may differ whose smaller size is at most `high`."""
    return (100 - percent) * (high + 100 * high // percent) // (100 + percent)


def band_keys(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the bands that every set joins on, and the set of each key."""
    sizes = np.array([len(s) for s in sets])
    if sizes.max(initial=0) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    highs = size_classes(int(sizes.max()), percent)
    home = np.searchsorted(highs, sizes)
    flat = np.concatenate(sets)
    place, members = mix(flat ^ np.uint64(0x5851F42D4C957F2D)), np.repeat(np.arange(len(sets)), sizes)
    keys, owners = [], []
    for down in (0, 1):
        group = home - down
        here = (sizes > 0) & (group >= 0)
        here &= (down == 0) | (sizes <= 100 * highs[np.maximum(group, 0)] // percent)
        if not here.any():
            continue
        differ = difference(highs[np.maximum(group, 0)], percent)
        spare = np.where(differ > 0, 1 + differ * 6 // 100, 0)
        bands = differ + 1 + spare
        inside = here[members]
        who, at = members[inside], place[inside]
        band = ((at >> np.uint64(32)) * bands[who].astype(np.uint64)) >> np.uint64(32)
        # Set, band and bit in one number: a set of very many bands is a run of its own, so the three always fit.
        low = int(bands[here].max()).bit_length()
        if len(sets).bit_length() + low + BAND_BITS > 64:
            raise ValueError(f"{len(sets)} sets of up to {1 << low} bands in one run of texts")
        wide = np.uint64(low)
        bit = np.sort((who.astype(np.uint64) << (wide + np.uint64(BAND_BITS))) | (band << np.uint64(BAND_BITS)) | (at & np.uint64((1 << BAND_BITS) - 1)))
        # A bit toggled an even number of times is off.
        edge = np.flatnonzero(np.concatenate(([True], bit[1:] != bit[:-1])))
        odd = np.diff(np.concatenate((edge, [len(bit)]))) % 2 == 1
        bit = bit[edge][odd]
        slot = bit >> np.uint64(BAND_BITS)
        first = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1]))) if len(slot) else np.zeros(0, np.int64)
        content = np.add.reduceat(mix(bit & np.uint64((1 << BAND_BITS) - 1)), first) if len(first) else np.zeros(0, np.uint64)
        who = (slot[first] >> wide).astype(np.int64)
        band = slot[first] & ((np.uint64(1) << wide) - np.uint64(1))
        tag = group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        keys.append(mix(content + mix(tag[who] + band + np.uint64(1))))
        owners.append(who)
        filled = np.bincount(who, minlength=len(sets))
        for poor in np.flatnonzero(here & (bands - filled > spare)):
            empty = np.setdiff1d(np.arange(bands[poor], dtype=np.uint64), band[who == poor])
            keys.append(mix(mix(tag[poor] + empty + np.uint64(1))))
            owners.append(np.full(len(empty), poor))
    return np.concatenate(keys), np.concatenate(owners)


GROUPS = "grp bigint, id bigint"


def band_groups(docs: DataFrame, width: int, percent: int, buckets: int) -> DataFrame:
    """(grp, id): documents that share a band; a group that shares many bands is there once."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def send() -> pa.RecordBatch:
            keys, ids = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            bucket = (keys >> np.uint64(40)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            names, first = np.unique(bucket[order], return_index=True)
            parts = [[x.tobytes() for x in np.split(column[order], first[1:])] for column in (keys, ids)]
            return pa.RecordBatch.from_arrays(
                [pa.array(names.astype(np.int64)), pa.array(parts[0], pa.binary()), pa.array(parts[1], pa.binary())], names=["bucket", "keys", "ids"]
            )

        for batch, raw, offsets in chunked(batches):
            keys, owner = band_keys(shingles(raw, offsets, width), percent)
            held.append((keys, np.asarray(batch.column("id"))[owner]))
            size += len(keys)
            if size > HELD:
                yield send()
                held, size = [], 0
        if size:
            yield send()

    def shared(group: pd.DataFrame) -> pd.DataFrame:
        keys = np.frombuffer(b"".join(group["keys"]), np.uint64)
        ids = np.frombuffer(b"".join(group["ids"]), np.int64)
        order = np.lexsort((ids, keys))
        keys, ids = keys[order], ids[order]
        # Rows that repeat an id are one document.
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
        keys, ids = keys[new], ids[new]
        edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        count = np.diff(np.concatenate((edge, [len(keys)])))
        total = np.add.reduceat(mix(ids.view(np.uint64) + np.uint64(7)), edge)
        name = mix(total + count.astype(np.uint64))
        # One band of every distinct group.
        several = np.flatnonzero(count > 1)
        _, pick = np.unique(name[several], return_index=True)
        chosen = several[pick]
        take = np.zeros(len(edge), bool)
        take[chosen] = True
        rows = np.repeat(take, count)
        return pd.DataFrame({"grp": np.repeat(name, count)[rows].view(np.int64), "id": ids[rows]})

    dealt = docs.mapInArrow(entries, "bucket bigint, keys binary, ids binary")
    return dealt.groupBy("bucket").applyInPandas(shared, GROUPS).distinct()


# --- links and components -------------------------------------------------------------------------------


def set_table(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, elements) of the documents in `ids`: sorted hashes as bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offsets in chunked(batches):
            packed = [s.tobytes() for s in shingles(raw, offsets, width)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(packed, pa.binary())], names=["id", "elements"])

    return docs.join(ids, "id", "left_semi").mapInArrow(work, "id bigint, elements binary").dropDuplicates(["id"])


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, by exact counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("left"), batch.column("right")):
                left, right = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.sort(np.concatenate((left, right)))
                common = int((both[1:] == both[:-1]).sum())
                good.append(100 * common >= percent * (len(both) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    # One set joined at a time; the set of a hub travels with its pairs, split by the join where a hub has very many.
    with_left = pairs.join(sets.select(F.col("id").alias("a"), F.col("elements").alias("left")), "a")
    with_both = with_left.join(sets.select(F.col("id").alias("b"), F.col("elements").alias("right")), "b")
    return with_both.select("a", "b", "left", "right").mapInArrow(work, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in links (a, b): smallest labels spread along links and along labels until still."""
    links = stage(links, "links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = stage(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id").select("id", F.least("component", "near").alias("next"), F.col("component").alias("old"))
        jump = labels.select(F.col("id").alias("next"), F.col("component").alias("far"))
        moved = stage(step.join(jump, "next").select("id", F.least("next", "far").alias("component"), "old"), "labels")
        labels = moved.select("id", "component")
        if moved.filter("component != old").isEmpty():
            return labels


def _placed(groups: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Group members with their components, of groups that have several."""
    if labels is None:
        return groups.withColumn("component", F.col("id"))
    told = groups.join(labels, "id", "left").select("grp", "id", F.coalesce("component", "id").alias("component"))
    told = stage(told, "members")
    mixed = told.groupBy("grp").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    # Written first, as is the hub below: members of a hot group are then split by the planner.
    return told.join(stage(mixed.select("grp"), "mixed"), "grp", "left_semi")


def _ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def sketch(elements: np.ndarray) -> np.ndarray:
    """The parity sketch of a set: every element toggles one bit of WORDS * 64."""
    bits = np.bincount((mix(elements + np.uint64(3)) % np.uint64(WORDS * 64)).astype(np.int64), minlength=WORDS * 64) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def sketches(sets: DataFrame) -> DataFrame:
    """id, n (size) and the words s0, s1, ... of the sketch of every set."""
    words = [f"s{k}" for k in range(WORDS)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            held = [np.frombuffer(e.as_buffer(), np.uint64) for e in batch.column("elements")]
            table = np.stack([sketch(e) for e in held])
            columns = [batch.column("id"), pa.array([len(e) for e in held], pa.int64()), *map(pa.array, table.T.copy())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", *words])

    return sets.mapInArrow(work, "id bigint, n bigint, " + ", ".join(f"{w} bigint" for w in words))


def near_pairs(members: DataFrame, sketched: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) inside groups, of different components, whose sketches do not rule out a link."""
    # Two members have been compared already, one being the hub.
    counts = members.groupBy("grp").agg(F.count(F.lit(1)).alias("size")).filter("size > 2").select("grp")
    told = stage(members.join(counts, "grp").join(sketched, "id"), "sketched")
    x, y = told.alias("x"), told.alias("y")
    distance = sum((F.bit_count(F.col(f"x.s{k}").bitwiseXOR(F.col(f"y.s{k}"))) for k in range(WORDS)), F.lit(0))
    allowed = F.lit(100 - percent) * (F.col("x.n") + F.col("y.n"))
    meet = (
        (F.col("x.grp") == F.col("y.grp"))
        & (F.col("x.component") < F.col("y.component"))
        & (distance * F.lit(100 + percent) <= allowed)
        & (F.col("x.n") * 100 >= F.col("y.n") * percent)
        & (F.col("y.n") * 100 >= F.col("x.n") * percent)
    )
    return x.join(y, meet).select(*_ordered("x.id", "y.id")).distinct()


def link_components(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(id, component) over all links between documents that share a group; components of one are left out."""
    links, tested, labels = None, None, None
    for turn in range(HUBS):
        members = _placed(groups, labels)
        by = F.col("id") if turn == 0 else F.xxhash64(F.col("id"), F.lit(turn))
        hub = stage(members.groupBy("grp").agg(F.min_by(F.struct("id", "component"), by).alias("hub")), "hubs")
        pairs = members.join(hub, "grp").filter("component != hub.component").select(*_ordered("id", "hub.id")).distinct()
        pairs = stage(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        found = stage(verify(pairs, sets, percent), "found")
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        labels = components(links)
    pairs = near_pairs(_placed(groups, labels), sketches(sets), percent).join(tested, ["a", "b"], "left_anti")
    return components(links.unionByName(stage(verify(stage(pairs, "pairs"), sets, percent), "found")))


def _by_id(nodes: DataFrame, apart: DataFrame, known: DataFrame) -> DataFrame:
    """(id, component) of ids, from components of nodes: nodes of one id belong together, and the smallest id names all."""
    told = nodes.join(known.withColumnRenamed("id", "node"), "node", "left").select("id", "node", F.coalesce("component", "node").alias("label"))
    told = stage(told.distinct(), "labelled")
    odd = told.join(apart.select("id").distinct(), "id", "left_semi")
    ties = odd.join(odd.groupBy("id").agg(F.min("label").alias("a")), "id").select("a", F.col("label").alias("b"))
    merged = components(ties.distinct()).select(F.col("id").alias("label"), F.col("component").alias("merged"))
    told = stage(told.join(merged, "label", "left").select("id", F.coalesce("merged", "label").alias("label")).distinct(), "merged")
    least = told.groupBy("label").agg(F.min("id").alias("component"))
    return stage(told.join(least, "label").select("id", "component").distinct(), "known")


def similarity_components(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every document; links are pairs with 100 * shared >= percent * all.

    component_id is the smallest id reachable by links, the document's own included.

    * Null and empty texts and texts of white space have an empty set and link with nothing, not with each other.
    * Rows sharing an id are linked with whatever one of them is linked with. A null id is smaller than any other; it is
      returned as null, also as component_id.
    * Other columns are not read. An empty table gives an empty result.
    """
    own = own_columns(docs, id_col, text_col)
    sizes = stage(set_rows(own, width), "sets")
    # What is linked are nodes: an id with one set is its own node, every set of an id with several is one by itself.
    whole = F.struct("n", "sum1", "sum2")
    several = sizes.filter("n > 0").groupBy("id").agg(F.min(whole).alias("low"), F.max(whole).alias("high")).filter("low < high")
    several = stage(several.select("id"), "several")
    apart = sizes.filter("n > 0").join(several, "id").select("id", "part", F.xxhash64("id", "n", "sum1", "sum2").alias("node")).distinct()
    apart = stage(apart, "apart")
    nodes = sizes.filter("n > 0").join(apart, ["id", "part"], "left").withColumn("node", F.coalesce("node", "id"))
    groups = nodes.groupBy("n", "sum1", "sum2").agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("times"))
    groups = stage(groups, "reps")
    copied = nodes.join(groups.filter("times > 1"), ["n", "sum1", "sum2"]).filter("node > rep").select("id", "part", "node", "rep").distinct()
    copied = stage(copied, "copies")
    later = copied.select(F.col("node").alias("id"), "rep").distinct()
    dull = stage(sizes.filter("n = 0").select("id", "part").distinct(), "empty")
    firsts = own.join(copied.select("id", "part").unionByName(dull), ["id", "part"], "left_anti")
    firsts = firsts.join(apart, ["id", "part"], "left").select(F.coalesce("node", "id").alias("id"), "text")
    # Two classes of about (100 - percent) / 100 bands per element each.
    elements = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all")).first()["all"]
    buckets = int(elements) * 2 * (100 - percent) // 100 // BUCKET + 8
    shared = stage(band_groups(firsts, width, percent, buckets), "groups")
    table = stage(set_table(firsts, stage(shared.select("id").distinct(), "ids"), width), "elements")
    labels = stage(link_components(shared, table, percent), "components")
    # A copy belongs where its representative belongs.
    reps = later.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("component", "rep").alias("component"))
    known = stage(labels.unionByName(reps).groupBy("id").agg(F.min("component").alias("component")), "known")
    if not apart.isEmpty():
        known = _by_id(nodes, apart, known)
    placed = sizes.join(known, "id", "left")
    component = F.coalesce("component", "id")

    def shown(column) -> Column:
        return F.when(column != NO_ID, column)

    return placed.select(shown(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), shown(component).alias("component_id"))


def keep_representatives(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Of every component the document with the smallest doc_id, with all its columns (pipeline stage).

    * Null and empty texts, and texts of white space, are in no component with others and stay.
    * Rows sharing the doc_id that stays all stay, whatever their texts; a null doc_id is smaller than any other.
    * Other columns are not read and are kept, whatever their names. An empty table gives an empty result.
    """
    told = similarity_components(docs, width, percent)
    drop = stage(told.filter("not (doc_id <=> component_id)").select(F.col("doc_id").alias("__later")).distinct(), "later")
    return docs.join(drop, docs["doc_id"].eqNullSafe(drop["__later"]), "left_anti")


@query("op1_parity_join")
def _op1(spark, sf_dir):
    return similarity_components(load(spark, sf_dir, "documents"), width=3, percent=90)
