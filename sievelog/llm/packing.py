"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become pieces of at most CAPACITY tokens. Full pieces are sequences by themselves. The
others are dealt by hash into blocks of about BLOCK pieces; each block is evolved on ISLANDS
islands. A solution is a list of bins. Crossover injects whole well-filled bins of one parent into
the other, removes bins that now hold duplicates, and puts the displaced pieces where they fit
best, or makes new bins of those that fill one best. Between epochs each island receives the elite
of the next one on the ring, by a join. There is no set number of generations: an island goes on
until its bins are as few as a lower bound allows, so the fewest, or until ``patience`` generations
have saved no bin. Seeds come from block, island and epoch, so a lost task makes the same solution
again.

Cases: null or empty texts are a piece of the end id alone. Equal or repeated rows are packed each
by itself. A null doc_id passes through. An empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, materialize
from .tokens import encoded_rows

CAPACITY = 2048
END = b"\0\0\0\0"
BLOCK = 8192
ISLANDS, EPOCHS, POPULATION = 3, 2, 8


class Bins(list):
    """A solution: a list of bins, each a list of pieces, with the room that every bin has left."""

    def __init__(self, bins: list[list[int]] = (), room: list[int] = ()):
        super().__init__(bins)
        self.room = list(room)
        self.marks: tuple[int, float] | None = None


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32."""
    wide = capacity * 4

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows = []
            for doc, data in zip(ids, encoded_rows(batch.column("text"), path), strict=True):
                data += END
                rows += [(doc, k, at // 4, len(part) // 4, zlib.crc32(part)) for k, at in enumerate(range(0, len(data), wide)) for part in (data[at : at + wide],)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(frugal(cut), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(bins: Bins, items: list[int], size: list[int]) -> None:
    """Puts ``items``, largest first, where least room stays; opens bins as needed.

    Bins are filed by their room, and one bit for each room says whether it has any."""
    filed: list[list[int]] = [[] for _ in range(CAPACITY + 1)]
    room, mask = bins.room, 0
    for i, r in enumerate(room):
        filed[r].append(i)
        mask |= 1 << r
    for x in sorted(items, key=size.__getitem__, reverse=True):
        n = size[x]
        fits = mask >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            i = filed[r].pop()
            if not filed[r]:
                mask ^= 1 << r
            bins[i].append(x)
        else:
            i, r = len(bins), CAPACITY
            bins.append([x])
            room.append(r)
        r -= n
        room[i] = r
        filed[r].append(i)
        mask |= 1 << r


def fill(bins: Bins, items: list[int], size: list[int], rng: random.Random | None = None) -> None:
    """Makes bins of ``items`` alone: the largest, then the one or two that leave least room, until none fits.

    One bit for each size says whether it is left, in ``mask`` upwards and in ``back`` downwards, so that
    all pairs of one sum are found at once. With ``rng`` the pair is any of those, else that of the largest."""
    filed: list[list[int]] = [[] for _ in range(CAPACITY + 1)]
    for x in items:
        filed[size[x]].append(x)
    mask = sum(1 << n for n in range(CAPACITY + 1) if filed[n])
    back = sum(1 << CAPACITY - n for n in range(CAPACITY + 1) if filed[n])
    while mask:
        made, room, todo = [], CAPACITY, [mask.bit_length() - 1]
        while todo:
            for n in todo:
                made.append(filed[n].pop())
                room -= n
                if not filed[n]:
                    mask ^= 1 << n
                    back ^= 1 << CAPACITY - n
            one = (mask & ((1 << room + 1) - 1)).bit_length() - 1
            todo = [one] if one >= 0 else []
            least = (mask & -mask).bit_length() - 1
            for total in range(min(room, 2 * one), max(one, 2 * least - 1), -1):
                pairs = mask & (back >> CAPACITY - total)
                if not total % 2 and len(filed[total // 2]) < 2:
                    pairs &= ~(1 << total // 2)
                if pairs:
                    # any of them at or below a random place, else the one of the largest
                    some = pairs & ((1 << rng.randrange(1, total + 1)) - 1) if rng else pairs
                    n = (some or pairs).bit_length() - 1
                    todo = [n, total - n]
                    break
        bins.append(made)
        bins.room.append(room)


def lower_bound(size: list[int]) -> int:
    """No solution has fewer bins (Martello and Toth): for each k, pieces over half a bin need one each,
    and those of k to half a bin only find room in bins of pieces of at most CAPACITY - k."""
    count = [0] * (CAPACITY + 1)
    for n in size:
        count[n] += 1
    half, best = CAPACITY // 2, -(-sum(size) // CAPACITY)
    large = sum(count[half + 1 :])
    small, room = 0, 0
    # k goes down: smaller pieces come in, and so do bins that have room for them
    for k in range(half, 0, -1):
        small += k * count[k]
        room += k * count[CAPACITY - k] if k < half else 0
        best = max(best, large + max(0, -(-(small - room) // CAPACITY)))
    return best


def rooms(bins: Bins, size: list[int]) -> list[int]:
    """The room of each bin, counted anew."""
    return [CAPACITY - sum(size[x] for x in b) for b in bins]


def fitness(bins: Bins) -> tuple[int, float]:
    """Fewer bins first, then fuller ones."""
    if bins.marks is None:
        bins.marks = -len(bins), sum((1 - r / CAPACITY) ** 2 for r in bins.room) / max(1, len(bins))
    return bins.marks


def put_back(bins: Bins, items: list[int], size: list[int], rng: random.Random) -> None:
    """Puts displaced pieces where they fit best, or makes new bins of them and puts the pieces of the emptier of those so."""
    if rng.random() < 0.5:
        made = Bins()
        fill(made, items, size, rng)
        items = []
        for b, r in zip(made, made.room, strict=True):
            if r <= CAPACITY // 64:
                bins.append(b)
                bins.room.append(r)
            else:
                items += b
    best_fit(bins, items, size)


def crossover(one: Bins, two: Bins, size: list[int], rng: random.Random) -> Bins:
    """Injects well-filled bins of ``one`` into ``two``."""
    ranked = sorted(range(len(one)), key=one.room.__getitem__)
    chosen = [i for i in ranked[: max(1, len(one) // 2)] if rng.random() < 0.5] or ranked[:1]
    given = {x for i in chosen for x in one[i]}
    made, lost = Bins([one[i][:] for i in chosen], [one.room[i] for i in chosen]), []
    for b, r in zip(two, two.room, strict=True):
        if given.isdisjoint(b):
            made.append(b[:])
            made.room.append(r)
        else:
            lost += [x for x in b if x not in given]
    put_back(made, lost, size, rng)
    return made


def mutate(bins: Bins, size: list[int], rng: random.Random) -> Bins:
    """Empties the emptiest bins and others, a few or up to half of them, then puts their pieces back."""
    ranked = sorted(range(len(bins)), key=bins.room.__getitem__, reverse=True)
    out = {*ranked[: max(1, len(bins) // 50)], *rng.sample(range(len(bins)), min(len(bins), rng.choice((3, 8, max(3, len(bins) // 2)))))}
    left = [i for i in range(len(bins)) if i not in out]
    made = Bins([bins[i][:] for i in left], [bins.room[i] for i in left])
    put_back(made, [x for i in sorted(out) for x in bins[i]], size, rng)
    return made


def patience(n: int) -> int:
    """Generations without a bin saved after which an island of ``n`` pieces gives up: more where they are cheap."""
    return min(1000, max(40, 200_000 // max(1, n)))


def evolve(size: list[int], seed: int, elites: list[Bins]) -> Bins:
    """The best solution that an island finds; ``elites`` join the population."""
    rng, bound = random.Random(seed), lower_bound(size)
    people, every = list(elites), list(range(len(size)))
    for make in (best_fit, fill):
        if not people or min(map(len, people)) > bound:
            people.append(Bins())
            make(people[-1], every, size)
    if min(map(len, people)) > bound:
        while len(people) < POPULATION:
            people.append(mutate(rng.choice(people), size, rng))
        fewest, stale = min(map(len, people)), 0
        while fewest > bound and stale < patience(len(size)):
            one, two = (max(rng.sample(people, 2), key=fitness) for _ in range(2))
            for child in (crossover(one, two, size, rng), mutate(max(one, two, key=fitness), size, rng)):
                # the weakest goes, and of equals only one stays
                weakest = min(range(len(people)), key=lambda i: fitness(people[i]))
                if fitness(child) > fitness(people[weakest]) and all(fitness(child) != fitness(p) for p in people):
                    people[weakest] = child
            stale += 1
            if (now := min(map(len, people))) < fewest:
                fewest, stale = now, 0
    return max(people, key=fitness)


def _placed(bins: Bins, n: int) -> list[int]:
    out = [0] * n
    for i, b in enumerate(bins):
        for x in b:
            out[x] = i
    return out


def _bins(placed: list[int], size: list[int] | None = None) -> Bins:
    out: list[list[int]] = [[] for _ in range(max(placed, default=-1) + 1)]
    for x, i in enumerate(placed):
        out[i].append(x)
    made = Bins(b for b in out if b)
    made.room = rooms(made, size) if size else []
    return made


ISLAND = "block long, island int, sizes array<int>, placed array<int>, n_bins int, fit double"


def _epoch(epoch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                elites = [_bins(r[k], r["sizes"]) for k in ("placed", "guest") if r.get(k)]
                bins = evolve(r["sizes"], hash((r["block"], r["island"], epoch)), elites)
                count, full = fitness(bins)
                rows.append((r["block"], r["island"], r["sizes"], _placed(bins, len(r["sizes"])), -count, full))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.float64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["block", "island", "sizes", "placed", "n_bins", "fit"])

    return run


def _laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places the pieces of each block in their sequences without gaps."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            full: dict[int, int] = {}
            for item, i in zip(r["items"], r["placed"], strict=True):
                at = full.get(i, 0)
                rows.append((item["doc_id"], item["piece"], item["start"], item["length"], item["ids_crc32"], (r["block"] << 32) + i, at))
                full[i] = at + item["length"]
        columns = list(zip(*rows, strict=True)) or [[]] * 7
        yield pa.record_batch([pa.array(c, pa.int32() if n == "piece" else pa.int64()) for n, c in zip(names, columns, strict=True)], names=names)


def pack(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of ``docs``."""
    spark = docs.sparkSession
    cut = materialize(pieces(docs, path).withColumn("row", F.monotonically_increasing_id()), "pieces")
    whole = cut.where(F.col("length") == CAPACITY)
    blocks = max(1, -(-cut.where(F.col("length") < CAPACITY).count() // BLOCK))
    item = F.struct("row", "doc_id", "piece", "start", "length", "ids_crc32")
    # the number of pieces in a block is bounded: they are dealt evenly, by row number
    dealt = cut.where(F.col("length") < CAPACITY).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    held = materialize(dealt.groupBy("block").agg(F.array_sort(F.collect_list(item)).alias("items")), "blocks")
    sizes = F.transform("items", lambda x: x["length"].cast("int"))
    parts = min(2 * blocks * ISLANDS, 8 * spark.sparkContext.defaultParallelism + blocks)
    state = held.select("block", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), sizes.alias("sizes")).repartition(parts, "block", "island")
    for epoch in range(EPOCHS):
        state = materialize(state.mapInArrow(_epoch(epoch), ISLAND), "islands")
        if epoch + 1 < EPOCHS:
            guest = state.select("block", F.pmod(F.col("island") - 1, F.lit(ISLANDS)).cast("int").alias("island"), F.col("placed").alias("guest"))
            state = state.join(guest, ["block", "island"]).select("block", "island", "sizes", "placed", "guest")
    best = state.groupBy("block").agg(F.max_by("placed", F.struct(-F.col("n_bins"), "fit", "island")).alias("placed"))
    packed = held.join(best, "block").mapInArrow(_laid_out, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    alone = whole.select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)
