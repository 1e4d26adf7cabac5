"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

Words are runs of anything but ASCII white space, with A-Z lower-cased; a document's set holds its distinct
runs of `shingle` words (the whole sequence where there are fewer). A first permutation sends each shingle to
a place, a second one, shifted circularly k times, gives coordinate k of the signature, so all coordinates of
a shingle are neighbours in one array. Documents of equal sets form a class; bands of the signature put classes
into buckets; candidates are confirmed on the full sets of 64-bit shingle fingerprints.

A bucket isn't expanded into all pairs: its first member is compared with the others, and links join members into
components. What may still be missing are links between different components of one bucket, of three members or more.
The documents of such buckets are joined by prefix filtering: in an order of all shingles from rare to frequent, two sets
as similar as asked for share one of the first n - ceil(similarity * n) + 1 shingles of each, so none of their links is lost,
while a passage that thousands of unlike documents share comes late in the order and pairs none of them. Texts move
once, and from then on only those of documents that share a bucket.

Shingles, buckets, texts and classes that very many documents hold are dealt over several tasks in every join (see shared).

At a similarity of 0.8, 64 bands of 6 coordinates miss a pair with a chance of 4e-9, at 0.85 of 1e-13.

Documents without words (null, empty, white space only) and rows with a null id are linked with nothing.
Repeated rows are copies of one another; an empty table gives no rows. Other columns of the input have no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import Words, distinct, fold, map_slices, mix
from .shared import components, cut, join_counted, join_shared

BANDS, ROWS = 64, 6
PLACES = 1 << 20


def _permutation() -> np.ndarray:
    """The second permutation, with its beginning repeated at its end."""
    own = np.random.default_rng(20_24).permutation(PLACES).astype(np.uint32)
    return np.append(own, own[: BANDS * ROWS])


def band_keys(values: np.ndarray, bounds: np.ndarray, permutation: np.ndarray) -> np.ndarray:
    """A row of BANDS keys for each set; sets without members get arbitrary ones."""
    width = BANDS * ROWS
    shifted = np.lib.stride_tricks.sliding_window_view(permutation, width)
    places = (mix(values ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(44)).astype(np.int64)
    least = np.full((len(bounds) - 1, width), PLACES, np.uint32)
    for i, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
        for at in range(a, b, 1024):
            np.minimum(least[i], shifted[places[at : min(b, at + 1024)]].min(axis=0), out=least[i])
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(least), BANDS))
    for k in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + least.reshape(-1, BANDS, ROWS)[:, :, k])
    return keys.view(np.int64)


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, n, mark, more, bands): the set's size, its fingerprint in two parts, its band keys."""

    def make():
        permutation = _permutation()

        def step(part: pa.RecordBatch) -> dict:
            values, bounds = distinct(*Words(part.column(1)).shingles(shingle), len(part))
            keys = band_keys(values, bounds, permutation)
            cuts = np.arange(0, keys.size + 1, BANDS, dtype=np.int32)
            return {"id": part.column(0), "n": np.diff(bounds), "mark": fold(values, bounds, 1).view(np.int64), "more": fold(values, bounds, 2).view(np.int64), "bands": pa.ListArray.from_arrays(pa.array(cuts), pa.array(keys.ravel()))}

        return step

    return map_slices(docs, make, "id long, n long, mark long, more long, bands array<long>", limit=1 << 19)


def confirmed(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def make():
        def step(part: pa.RecordBatch) -> dict:
            sides = [distinct(*Words(part.column(k)).shingles(shingle), len(part)) for k in (2, 3)]
            sizes = [np.diff(bounds) for _, bounds in sides]
            values, row = np.concatenate([v for v, _ in sides]), np.concatenate([np.repeat(np.arange(len(part)), n) for n in sizes])
            order = np.lexsort((values, row))
            values, row = values[order], row[order]
            same = np.bincount(row[1:][(values[1:] == values[:-1]) & (row[1:] == row[:-1])], minlength=len(part))
            keep = pa.array((100 * same >= percent * (sizes[0] + sizes[1] - same)) & (same > 0))
            return {"a": part.column(0).filter(keep), "b": part.column(1).filter(keep)}

        return step

    left = docs.select(F.col("id").alias("a"), F.col("text").alias("text"))
    right = docs.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    # a text with many partners is copied, not gathered with all of them; partners are counted before texts are put to them
    pairs = cut(pairs)
    first = join_shared(pairs, left, "a", "b").select("a", "b", "text")
    counted = cut(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")))
    both = join_shared(first, right, "b", "a", counted).select("a", "b", "text", "text_b")
    return map_slices(both, make, "a long, b long", limit=1 << 19)


def prefix_pairs(rest: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs (a, b) of the documents (id, component) that may be similar enough and are of different components."""

    def make():
        def step(part: pa.RecordBatch) -> dict:
            values, bounds = distinct(*Words(part.column(1)).shingles(shingle), len(part))
            return {"id": part.column(0), "component": part.column(2), "n": np.diff(bounds), "all": pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))}

        return step

    sets = cut(map_slices(texts.join(rest, "id").select("id", "text", "component"), make, "id long, component long, n long, all array<long>", limit=1 << 19))
    each = sets.where("n > 0").select("id", "component", "n", F.explode("all").alias("g"))
    often = cut(each.groupBy("g").agg(F.count(F.lit(1)).alias("often")))
    # Shingles of one document alone pair nothing, but have their place in the order.
    place = F.row_number().over(Window.partitionBy("id").orderBy("often", "g"))
    first = join_counted(each, often, "g", "often").withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).where("often > 1")
    first = cut(first.select("g", "id", "component", (F.col("n") - F.col("place") + 1).alias("left"), "n"))
    # Per shingle the members of all components but one meet the others: copies of one component don't meet one another.
    most = first.groupBy("g", "component").agg(F.count(F.lit(1)).alias("size")).groupBy("g").agg(F.max_by("component", "size").alias("main"), F.count(F.lit(1)).alias("kinds"), F.sum("size").alias("members")).where("kinds > 1").select("g", "main", "members")
    met = cut(join_counted(first, cut(most), "g", "members"))
    left = met.where("component <> main").select("g", F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("left").alias("left_a"), F.col("component").alias("component_a"))
    right = met.select("g", F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("left").alias("left_b"), "component")
    # What comes before two sets' first common shingle is not common; from there on either has `left` shingles at most.
    near = (F.lit(percent) * F.greatest("n_a", "n_b") <= 100 * F.least("n_a", "n_b")) & (F.lit(100 + percent) * F.least("left_a", "left_b") >= F.lit(percent) * (F.col("n_a") + F.col("n_b")))
    pairs = join_shared(right, left, "g", "b").where("component <> component_a").where(near)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _twice(sets: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Links (a, b) between the classes of rows that share an id but not a text, or None if there are none."""
    mark = F.struct("mark", "more", "n")
    several = cut(sets.groupBy("id").agg(F.min(mark).alias("low"), F.max(mark).alias("high")).where("low <> high").select("id"))
    if several.isEmpty():
        return None
    own = sets.join(several, "id").select("id", "mark", "more", "n").distinct().join(classes, ["mark", "more", "n"]).select("id", F.col("rep").alias("b"))
    return own.join(own.groupBy("id").agg(F.min("b").alias("a")), "id").where("a <> b").select("a", "b").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept), a row for every input row: the size of the document's set, the smallest
    id reachable over links, and whether that is its own. Rows that share an id are one node: what is linked with one is linked with all."""
    docs = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    marks = cut(signatures(docs, shingle))
    sets = marks.where("n > 0 and id is not null")
    classes = cut(sets.groupBy("mark", "more", "n").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    spread = sets.join(classes.select(F.col("rep").alias("id"), "mark", "more"), ["id", "mark", "more"], "left_semi").select("id", F.explode("bands").alias("key"))
    shared = cut(spread.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("hub")).where("size > 1"))
    members = cut(join_counted(spread, shared, "key", "size").select("key", "id", "size", "hub"))
    candidates = members.select("id").distinct()
    sized = cut(classes.select(F.col("rep").alias("id"), "n").join(candidates, "id", "left_semi"))
    texts = cut(docs.join(sized.select("id").distinct(), "id", "left_semi"))
    near = F.lit(percent) * F.greatest("n_a", "n_b") <= 100 * F.least("n_a", "n_b")  # sets of other sizes can't be so similar
    # Round one: each bucket's first member with the others.
    hubs = cut(members.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct())
    first = (
        join_shared(hubs, sized.select(F.col("id").alias("a"), F.col("n").alias("n_a")), "a", "b")
        .join(sized.select(F.col("id").alias("b"), F.col("n").alias("n_b")), "b").where(near).select("a", "b").distinct()
    )
    links = confirmed(first, texts, shingle, percent)
    if (twice := _twice(sets, classes)) is not None:
        links = links.union(twice)
    links = cut(links)
    labels = components(links)
    # What is left: buckets of three and more with members of several components.
    known = cut(members.where("size > 2").select("key", "id").join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id")))
    mixed = cut(known.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high").select("key", "n"))
    rest = cut(join_counted(known, mixed, "key").select("id", "component").distinct())
    if not rest.isEmpty():
        found = confirmed(prefix_pairs(rest, texts, shingle, percent), texts, shingle, percent)
        links = cut(links.union(found))
        labels = components(links)
    named = cut(classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(F.struct("mark", "more", "n").alias("class"), "copies", F.coalesce("component", "rep").alias("component")))
    # A text that a third of all rows hold is no more than a row of `named`; rows without words or id are none of its.
    own = marks.select("id", "n", F.struct("mark", "more", "n").alias("class"))
    linked = join_counted(own.where("n > 0 and id is not null"), named, "class", "copies").select("id", "n", "component")
    every = linked.union(own.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component")))
    return every.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))
