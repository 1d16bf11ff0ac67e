"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two fixed permutations of a universe of 2**20 positions: sigma places a shingle, pi orders the
positions. Coordinate k of a signature is the smallest pi value after pi has been shifted
circularly by k, so two permutations give all coordinates. Bands of coordinates propose links,
an 8-bit sketch of the signature drops proposals far below the threshold, and every link is
confirmed on the full shingle sets.

Links are found in three rounds, so that a large group of near copies never makes all its pairs:
every document against the smallest members of its buckets; in buckets of up to SMALL members, the
pairs that are still in different components; in larger buckets, those pairs block against block
inside tasks, which return spanning links only. The last round leaves out the pairs within the
component that most members of a bucket are already in.

Cases: documents with equal sets are one class and are compared once. Null or empty texts, and
texts of separators only, have an empty set and link with nothing. Rows that share a doc_id are
one node. A null doc_id links with nothing. An empty table gives an empty result. Columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, attach, attach_hot, frugal, materialize
from .components import components
from .words import SPACED, hashed_words, mix

UNIVERSE = 1 << 20
BANDS, ROWS = 32, 4
COORDINATES = BANDS * ROWS
SHINGLE = 5
#: Percent of the union that two sets must share.
PERCENT = 75
#: Sketch matches of COORDINATES below which a proposal is dropped: five deviations under the threshold.
LEAST = int(COORDINATES * PERCENT / 100 - 5 * (COORDINATES * PERCENT / 100 * (1 - PERCENT / 100)) ** 0.5)

#: Members of a bucket up to which its pairs are written out.
SMALL = 8
#: Rows of a block when sketches, and when full texts, are compared.
SKETCH_BLOCK, TEXT_BLOCK = 2048, 256

SIGNED = "doc_id long, n_shingles long, set_key string, bands array<long>, sketch binary"


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    with np.errstate(over="ignore"):
        factor = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)
    for words in hashed_words(column, SPACED):
        n = words.hi - words.lo
        counts = np.bincount(words.row, minlength=n)
        ends = np.cumsum(counts)
        key, row = words.key, words.row
        if len(key) >= SHINGLE:
            stop = len(key) - SHINGLE + 1
            whole = row[:stop] == row[SHINGLE - 1 :]
            made = np.zeros(stop, np.uint64)
            for i in range(SHINGLE):
                made += key[i : stop + i] * factor[i]
            made, owner = mix(made[whole]), row[:stop][whole]
        else:
            made, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        order = np.lexsort((made, owner))
        made, owner = made[order], owner[order]
        if len(made):
            fresh = np.ones(len(made), bool)
            fresh[1:] = (made[1:] != made[:-1]) | (owner[1:] != owner[:-1])
            made, owner = made[fresh], owner[fresh]
        bounds = np.searchsorted(owner, np.arange(n + 1))
        for i in range(n):
            if counts[i] >= SHINGLE:
                yield made[bounds[i] : bounds[i + 1]]
            elif counts[i]:
                few = key[ends[i] - counts[i] : ends[i]]
                yield mix(np.array([(few * factor[: len(few)]).sum(dtype=np.uint64) + np.uint64(len(few))]))
            else:
                yield np.zeros(0, np.uint64)


@lru_cache(1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(1)
    sigma = rng.permutation(UNIVERSE).astype(np.int32)
    pi = rng.permutation(UNIVERSE).astype(np.int32)
    circle = np.concatenate([pi, pi[: COORDINATES - 1]])
    return sigma, np.lib.stride_tricks.sliding_window_view(circle, COORDINATES)


def signature(shingles: np.ndarray) -> np.ndarray:
    """COORDINATES minima; row i of the shifted view holds pi at i, i+1, ... around the circle."""
    sigma, shifted = _permutations()
    at = sigma[(shingles >> np.uint64(44)).astype(np.int64)]
    least = np.full(COORDINATES, UNIVERSE, np.int32)
    for i in range(0, len(at), 4096):
        np.minimum(least, shifted[at[i : i + 4096]].min(axis=0), out=least)
    return least


def sign_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    band_factor = mix(np.arange(11, 11 + ROWS, dtype=np.uint64)) | np.uint64(1)
    band_start = mix(np.arange(101, 101 + BANDS, dtype=np.uint64))
    for batch in batches:
        sizes, keys, bands, sketches = [], [], [], []
        for shingles in shingle_sets(batch.column("text")):
            sizes.append(len(shingles))
            if not len(shingles):
                keys.append(None), bands.append(None), sketches.append(None)
                continue
            coordinates = signature(shingles)
            mixed = mix((coordinates.reshape(BANDS, ROWS).astype(np.uint64) * band_factor).sum(axis=1, dtype=np.uint64) + band_start)
            keys.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).hexdigest())
            bands.append(mixed.view(np.int64))
            sketches.append(coordinates.astype(np.uint8).tobytes())
        yield pa.record_batch([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.string()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=["doc_id", "n_shingles", "set_key", "bands", "sketch"])


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep proposals whose sketches agree often enough; adds the number of agreements."""
    for batch in batches:
        if not batch.num_rows:
            continue
        one = np.frombuffer(b"".join(batch.column("sketch_a").to_pylist()), np.uint8).reshape(-1, COORDINATES)
        two = np.frombuffer(b"".join(batch.column("sketch_b").to_pylist()), np.uint8).reshape(-1, COORDINATES)
        same = (one == two).sum(axis=1)
        out = pa.record_batch([batch.column("a"), batch.column("b"), pa.array(same, pa.int64())], names=["a", "b", "same"])
        yield out.filter(pa.array(same >= LEAST))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep pairs whose full sets share PERCENT of their union."""
    for batch in batches:
        keep = []
        for one, two in zip(shingle_sets(batch.column("text_a")), shingle_sets(batch.column("text_b")), strict=True):
            shared = len(np.intersect1d(one, two, assume_unique=True))
            keep.append(shared > 0 and 100 * shared >= PERCENT * (len(one) + len(two) - shared))
        out = pa.record_batch([batch.column("a"), batch.column("b")], names=["u", "v"])
        yield out.filter(pa.array(keep, pa.bool_()))


def _proposals(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """Pairs (a, b) of written ``pairs`` that the sketches don't rule out, with their agreement."""
    sketches = signed.select("doc_id", "sketch")
    # b may be the pivot of a large group of copies
    joined = attach_hot(pairs, sketches.select(F.col("doc_id").alias("b"), F.col("sketch").alias("sketch_b")), "b", "a")
    joined = joined.join(sketches.select(F.col("doc_id").alias("a"), F.col("sketch").alias("sketch_a")), "a")
    return joined.select("a", "b", "sketch_a", "sketch_b").mapInArrow(frugal(_close), "a long, b long, same long")


def _confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Edges (u, v) among written ``pairs`` (a, b), by the texts. Only texts of the pairs move."""
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "pair-ids")
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    texts = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi")
    joined = attach_hot(pairs.select("a", "b"), texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b", "a")
    joined = joined.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(frugal(_verify), "u long, v long")


def _units(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Deals the rows (key, root, doc_id, ...) of each key to block pairs, for pairs of unlike roots.

    The commonest root of a key is its major one. The other rows are compared with each other and
    with the major rows; ``side`` is 0 for them and 1 for major rows. A unit holds two blocks of
    about ``size`` rows at most.
    """
    counts = rows.groupBy(key, "root").agg(F.count("*").alias("n"))
    sizes = counts.groupBy(key).agg(F.max_by("root", F.struct("n", -F.col("root"))).alias("major"), F.max("n").alias("n_major"), F.sum("n").alias("n")).where("n > n_major")
    blocks = lambda n: F.ceil(n / F.lit(size)).cast("int")
    sizes = materialize(sizes.select(key, "major", blocks(F.col("n_major")).alias("of_major"), blocks(F.col("n") - F.col("n_major")).alias("of_other")), "unit-sizes")
    dealt = attach(rows, sizes, key, "inner").withColumn("side", (F.col("root") == F.col("major")).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.when(F.col("side") == 1, F.col("of_major")).otherwise(F.col("of_other"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    with_major = F.transform(upto(F.col("of_major")), lambda j: F.struct(F.lit("m").alias("kind"), F.col("block").alias("i"), j.alias("j")))
    with_other = F.transform(F.filter(upto(F.col("of_other")), lambda j: j != F.col("block")), lambda j: F.struct(F.lit("s").alias("kind"), F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    of_major = F.transform(upto(F.col("of_other")), lambda i: F.struct(F.lit("m").alias("kind"), i.alias("i"), F.col("block").alias("j")))
    units = F.when(F.col("side") == 1, of_major).otherwise(F.concat(with_major, with_other))
    return dealt.withColumn("unit", F.explode(units)).drop("major", "of_major", "of_other", "block")


class _Forest:
    """Union of row numbers, started from known roots; keeps the links that joined anything."""

    def __init__(self, roots: list[int]):
        first: dict[int, int] = {}
        self.up = [first.setdefault(r, i) for i, r in enumerate(roots)]
        self.links: list[tuple[int, int]] = []

    def top(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def link(self, x: int, y: int) -> None:
        a, b = self.top(x), self.top(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.links.append((x, y))


def _partners(table: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of side 0, the other rows of its unit with which it is compared and whose sketches are close."""
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, COORDINATES)
    side, root = table.column("side").to_numpy(), table.column("root").to_numpy()
    for x in np.flatnonzero(side == 0):
        later = np.flatnonzero((root != root[x]) & ((side == 1) | (np.arange(len(side)) > x)))
        if len(later):
            yield int(x), later[(sketch[later] == sketch[x]).sum(axis=1) >= LEAST]


def _edges(table: pa.Table, forest: _Forest) -> pa.Table:
    ids = table.column("doc_id").to_numpy()
    pairs = np.array(forest.links, np.int64).reshape(-1, 2)
    return pa.table({"u": pa.array(ids[pairs[:, 0]], pa.int64()), "v": pa.array(ids[pairs[:, 1]], pa.int64())})


def _span_proposals(table: pa.Table) -> pa.Table:
    """Spanning edges of the pairs in a unit whose sketches are close."""
    forest = _Forest(list(range(table.num_rows)))
    for x, found in _partners(table):
        for y in found:
            forest.link(x, int(y))
    return _edges(table, forest)


def _span_links(table: pa.Table) -> pa.Table:
    """Spanning links of a unit: pairs of unlike roots that share PERCENT of their union.

    Intersections come from products of incidence matrices over the unit's shingles, by parts.
    """
    sets = list(shingle_sets(table.column("text").combine_chunks()))
    forest = _Forest(table.column("root").to_pylist())
    proposed = [(x, y) for x, y in _partners(table) if len(y)]
    if proposed:
        lengths = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), lengths)
        universe, place = np.unique(np.concatenate(sets), return_inverse=True)
        asked = np.array([x for x, _ in proposed])
        shared = np.zeros((len(asked), len(sets)), np.float32)
        order = np.argsort(place, kind="stable")
        owner, place = owner[order], place[order]
        for lo in range(0, len(universe), 8192):
            a, b = np.searchsorted(place, [lo, lo + 8192])
            part = np.zeros((len(sets), min(8192, len(universe) - lo)), np.float32)
            part[owner[a:b], place[a:b] - lo] = 1
            shared += part[asked] @ part.T
        for row, (x, found) in enumerate(proposed):
            same = shared[row, found]
            for y in found[100 * same >= PERCENT * (lengths[x] + lengths[found] - same)]:
                forest.link(x, int(y))
    return _edges(table, forest)


def _links_in_blocks(wide: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (u, v) that join components within large buckets; ``wide`` holds (band, doc_id, root)."""
    sketched = wide.join(reps.select("doc_id", "sketch"), "doc_id")
    spans = materialize(_units(sketched, "band", SKETCH_BLOCK).groupBy("band", "unit").applyInArrow(_span_proposals, "u long, v long").distinct(), "spans")
    # documents that close sketches connect form an arena, in which full sets are compared
    arenas = components(spans)
    placed = arenas.join(wide.select("doc_id", "root").distinct(), arenas["node"] == F.col("doc_id")).select("doc_id", wide["root"].alias("own"), arenas["root"].alias("arena"))
    placed = materialize(placed.select("arena", F.col("own").alias("root"), "doc_id"), "arenas")
    ids = placed.select("doc_id")
    texts = docs.select("doc_id", "text").join(F.broadcast(ids) if placed.count() <= BROADCAST_ROWS else ids, "doc_id", "left_semi")
    full = placed.join(reps.select("doc_id", "sketch"), "doc_id").join(texts, "doc_id")
    return _units(full, "arena", TEXT_BLOCK).groupBy("arena", "unit").applyInArrow(_span_links, "u long, v long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialize(docs.mapInArrow(frugal(sign_batches), SIGNED), "signed")
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    # equal sets are one class; its smallest doc_id stands for it
    classes = materialize(usable.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").select("set_key", "rep"), "classes")
    ranked = attach(usable, classes, "set_key").withColumn("rep", F.coalesce("rep", "doc_id"))
    members = materialize(ranked.select("doc_id", "rep"), "members")
    reps = materialize(ranked.where("doc_id = rep").dropDuplicates(["doc_id", "set_key"]).select("doc_id", "bands", "sketch"), "reps")
    banded = reps.select("doc_id", F.explode("bands").alias("band"))
    # each bucket of a band is named by its smallest member; counts combine before the shuffle
    buckets = materialize(banded.groupBy("band").agg(F.min("doc_id").alias("pivot"), F.count("*").alias("n")).where("n > 1"), "buckets")
    filed = materialize(attach(banded, buckets, "band", "inner"), "filed")
    # first, every document against the smallest members of its buckets
    stars = materialize(filed.where("doc_id <> pivot").select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")).distinct(), "star-pairs")
    near = materialize(_proposals(stars, reps), "stars")
    first = materialize(_confirmed(near, docs), "links-1")
    roots = components(first)
    labelled = attach(filed, roots.withColumnRenamed("node", "doc_id"), "doc_id").select("band", "n", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    labelled = materialize(labelled, "labelled")
    # then the pairs of small buckets that are still apart: at most SMALL / 2 for each row
    few = labelled.where(F.col("n") <= SMALL)
    apart = few.select("band", F.col("doc_id").alias("a"), F.col("root").alias("ra")).join(few.select("band", F.col("doc_id").alias("b"), F.col("root").alias("rb")), "band")
    apart = apart.where("a > b and ra <> rb").select("a", "b").distinct().join(near.select("a", "b"), ["a", "b"], "left_anti")
    second = materialize(_confirmed(materialize(_proposals(materialize(apart, "apart-pairs"), reps), "apart"), docs), "links-2")
    # last, large buckets
    third = materialize(_links_in_blocks(labelled.where(F.col("n") > SMALL).select("band", "doc_id", "root"), reps, docs), "links-3")
    roots = components(first.unionByName(second).unionByName(third)).select(F.col("node").alias("rep"), "root")
    labels = attach(members, roots, "rep").groupBy("doc_id").agg(F.min(F.coalesce("root", "rep")).alias("root"))
    found = signed.select("doc_id", "n_shingles").join(labels, "doc_id", "left")
    return found.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"), F.coalesce(F.col("doc_id") == F.coalesce("root", "doc_id"), F.lit(True)).alias("kept"))
