"""Benchmark decontamination by suffix arrays over the training documents.

Every task builds suffix arrays over shards of its own documents: word sequences, sorted by
prefix doubling. A suffix ends where no benchmark item goes on, that is with a word or before a pair of
words that none holds, so only suffixes that can match are sorted. Every benchmark suffix is binary-searched in each shard, all of them together,
a word deeper at a time: its range of the array narrows until no document goes on as it does, which
gives its longest verbatim match, or until it has matched a whole window. Windows that touch on one
diagonal are one longer match; their places are reported.

The benchmark is the stated query set. It is dealt to the tasks in blocks of at most
``BLOCK_WORDS`` words, a block at a time: a block is sent when the rows of the one before are written,
so that tasks hold one block, and the driver that and the next, whatever the benchmark's size.

Cases: null or wordless documents have no words and no hits; null or wordless items are searched
for nothing. Items with equal texts all count; those with a null item_id are searched too and count as
one item. Rows that repeat, or share a doc_id, are judged each by itself, with one block or several.
A text of any length is searched whole, in one shard. Every place is reported: where an item and a
document both repeat one passage many times over, these are as many as the pairs of its places.
Empty tables give empty results or clean documents. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, materialize
from .words import ALNUM, Words, hashed_words

WINDOW = 13
#: Words of benchmark text that go to the tasks at once.
BLOCK_WORDS = 2_000_000
#: Words of documents in a shard, more if there are many probes, PROBE_WORDS for each; a longer document is a shard of its own.
SHARD_WORDS, PROBE_WORDS = 300_000, 6
ROW = "__row"
FOUND = "doc_id long, n_words long, n_hit long, longest long, items array<string>, matches array<struct<item_id:string,item_at:long,doc_at:long,length:long>>"


class Items:
    """A block of benchmark items as one sequence of word ids, with ``window`` zeros after each item.

    A probe is a distinct beginning, of ``window`` words at most, of a benchmark suffix: ``probe`` is where
    one such suffix starts, ``length`` the words it has. Those that are windows have places in items,
    ``places[k]:places[k + 1]`` of ``item`` and ``item_at``.
    """

    def __init__(self, names: list[str], words: list[np.ndarray], window: int):
        used = [(n, w) for n, w in zip(names, words, strict=True) if len(w)]
        self.names, self.window = [n for n, _ in used], window
        self.vocabulary = np.unique(np.concatenate([w for _, w in used])) if used else np.zeros(0, np.uint64)
        sizes = np.array([len(w) for _, w in used], np.int64)
        start = np.cumsum(sizes + window) - sizes - window
        self.text = np.zeros(int((sizes + window).sum()) + window, np.int64)
        owner = np.repeat(np.arange(len(used)), sizes)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        place = start[owner] + at
        #: 0 is kept for words outside the vocabulary
        self.text[place] = np.searchsorted(self.vocabulary, np.concatenate([w for _, w in used])) + 1 if used else 0
        rank, width = self.text, 1
        while 2 * width <= window:
            follow = np.append(rank[width:], np.zeros(width, np.int64))
            rank, width = np.unique(rank * (int(rank.max(initial=0)) + 1) + follow, return_inverse=True)[1], 2 * width
        key = rank[place] * (int(rank.max(initial=0)) + 1) + rank[place + window - width]
        _, first, probe = np.unique(key, return_index=True, return_inverse=True)
        self.probe = place[first]
        self.length = np.minimum(window, sizes[owner[first]] - at[first])
        whole = np.flatnonzero(at + np.minimum(window, sizes[owner]) <= sizes[owner])
        order = whole[np.argsort(probe[whole], kind="stable")]
        self.item, self.item_at = owner[order], at[order]
        self.places = np.searchsorted(probe[order], np.arange(len(first) + 1))
        self.has_single = bool((sizes == 1).any()) or window == 1
        pair = self.text[place] * (len(self.vocabulary) + 1) + self.text[place + 1]
        self.pairs = np.unique(pair[self.text[place + 1] > 0])
        #: which leading bits of hashes the vocabulary has
        self.leads = np.zeros(1 << 20, bool)
        self.leads[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True

    def ids(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        some = np.flatnonzero(self.leads[(keys >> np.uint64(44)).astype(np.int64)])
        if len(some):
            at = np.minimum(np.searchsorted(self.vocabulary, keys[some]), len(self.vocabulary) - 1)
            out[some] = np.where(self.vocabulary[at] == keys[some], at + 1, 0)
        return out

    def goes_on(self, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Where a word and the next one of its row are a pair of some item."""
        out = np.zeros(len(ids), bool)
        both = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0) & (rows[:-1] == rows[1:]))
        if len(both) and len(self.pairs):
            pair = ids[both] * (len(self.vocabulary) + 1) + ids[both + 1]
            out[both] = self.pairs[np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)] == pair
        return out


def suffix_array(ids: np.ndarray, live: np.ndarray, room: np.ndarray, depth: int) -> np.ndarray:
    """The order of the suffixes that start at ``live`` and have ``room`` words, by ``depth`` words.

    Prefix doubling: ranks by 1, 2, 4, ... words, of places; a suffix ends with its room.
    """
    rank, width = np.zeros(len(ids) + 1, np.int64), 0
    order = np.argsort(ids[live])
    sort_by = ids[live]
    while True:
        ranked = sort_by[order]
        place = np.empty(len(live), np.int64)
        place[order] = np.cumsum(np.append(True, ranked[1:] != ranked[:-1])) if len(live) else 0
        rank[live] = place
        width = 2 * width or 1
        if width >= depth or not len(live):
            return order
        second = np.where(room > width, rank[np.minimum(live + width, len(ids))], 0)
        sort_by = place * (int(place.max()) + 1) + second
        order = np.argsort(sort_by)


def _narrowed(word_at, lo: np.ndarray, hi: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of the ranges lo..hi, in each of which ``word_at`` ascends, that hold ``word``: binary searches, all at once."""
    ends = []
    for after in (False, True):
        a, b = (ends[0] if after else lo).copy(), hi.copy()
        while len(open_ := np.flatnonzero(a < b)):
            mid = (a[open_] + b[open_]) >> 1
            seen = word_at(mid)
            up = (seen <= word[open_]) if after else (seen < word[open_])
            a[open_[up]], b[open_[~up]] = mid[up] + 1, mid[~up]
        ends.append(a)
    return ends[0], ends[1]


def _spread(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each ``begin``, ``count`` of them; and which each belongs to."""
    owner = np.repeat(np.arange(len(count)), count)
    return begin[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count), owner


def search(items: Items, ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places and probes of every window found in a shard, words matched at each place up to a window)."""
    reach, none = np.zeros(len(ids), np.int64), np.zeros(0, np.int64)
    if not len(ids) or not len(items.probe):
        return none, none, reach
    on = items.goes_on(ids, rows)
    breaks = np.flatnonzero(~on)
    # a single word is a match too, and is sorted only where it ends a longer one or may be a whole item
    reach[ids > 0] = 1
    live = np.flatnonzero(ids > 0 if items.has_single else on | np.append(False, on[:-1]))
    room = breaks[np.searchsorted(breaks, live)] - live + 1
    order = suffix_array(ids, live, room, items.window)
    array, room = live[order], room[order]
    probe = np.arange(len(items.probe))
    word, first = items.text[items.probe], ids[array]
    lo, hi = np.searchsorted(first, word, "left"), np.searchsorted(first, word, "right")
    found: list[tuple[np.ndarray, np.ndarray]] = []
    depth = 0
    while True:
        there = lo < hi
        probe, lo, hi, depth = probe[there], lo[there], hi[there], depth + 1
        if not len(probe):
            break
        if (hi - lo).sum() < len(array):
            reach[array[_spread(lo, hi - lo)[0]]] = depth
        else:
            edges = np.bincount(lo, minlength=len(array) + 1) - np.bincount(hi, minlength=len(array) + 1)
            reach[array[np.cumsum(edges[:-1]) > 0]] = depth
        done = (items.length[probe] == depth) & (items.places[probe + 1] > items.places[probe])
        at, owner = _spread(lo[done], (hi - lo)[done])
        found.append((array[at], probe[done][owner]))
        more = items.length[probe] > depth
        probe, lo, hi = probe[more], lo[more], hi[more]

        def deeper(at: np.ndarray, depth: int = depth) -> np.ndarray:
            return np.where(room[at] > depth, ids[np.minimum(array[at] + depth, len(ids) - 1)], 0)

        lo, hi = _narrowed(deeper, lo, hi, items.text[items.probe[probe] + depth])
    return (*(np.concatenate(x) for x in zip(*found, strict=True)), reach) if found else (none, none, reach)


def _by_name(name: str | None) -> tuple[bool, str]:
    return name is None, name or ""


MATCH = pa.struct([("item_id", pa.string()), ("item_at", pa.int64()), ("doc_at", pa.int64()), ("length", pa.int64())])


def _judged(items: Items, keys: np.ndarray, counts: np.ndarray) -> list[pa.Array]:
    """n_words, n_hit, longest, items, matches of the documents of a shard."""
    n, ids, row = len(counts), items.ids(keys), np.repeat(np.arange(len(counts)), counts)
    begin = np.cumsum(counts) - counts
    at, probe, reach = search(items, ids, row)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, row, reach)
    cover = np.bincount(at, minlength=len(ids) + 1) - np.bincount(at + items.length[probe], minlength=len(ids) + 1)
    hit = np.bincount(row[np.cumsum(cover[: len(ids)]) > 0], minlength=n)
    # items of each document, from its distinct windows
    pairs = np.unique(row[at] * len(items.probe) + probe) if len(at) else at
    mine, window = np.divmod(pairs, max(1, len(items.probe)))
    spot, owner = _spread(items.places[window], items.places[window + 1] - items.places[window])
    named = np.unique(mine[owner] * len(items.names) + items.item[spot]) if len(spot) else spot
    who, item = np.divmod(named, max(1, len(items.names)))
    lists: list[list] = [[] for _ in range(n)]
    for i, k in zip(who.tolist(), item.tolist(), strict=True):
        lists[i].append(items.names[k])
    # windows of one diagonal that touch are one run
    spot, owner = _spread(items.places[probe], items.places[probe + 1] - items.places[probe])
    place, kind, there = at[owner], items.item[spot], items.item_at[spot]
    size, mine = items.length[probe[owner]], row[at[owner]]
    order = np.lexsort((place, place - there, kind, mine))
    place, kind, there, size, mine = place[order], kind[order], there[order], size[order], mine[order]
    fresh = np.ones(len(place), bool)
    fresh[1:] = (mine[1:] != mine[:-1]) | (kind[1:] != kind[:-1]) | (np.diff(place - there) != 0) | (place[1:] > place[:-1] + size[:-1])
    head = np.flatnonzero(fresh)
    tail = np.append(head[1:], len(place))[: len(head)] - 1
    length = place[tail] + size[tail] - place[head]
    np.maximum.at(longest, mine[head], length)
    matches: list[list] = [[] for _ in range(n)]
    doc_at = place[head] - begin[mine[head]] if len(head) else head
    for i, k, a, d, x in zip(mine[head].tolist(), kind[head].tolist(), there[head].tolist(), doc_at.tolist(), length.tolist(), strict=True):
        matches[i].append({"item_id": items.names[k], "item_at": a, "doc_at": d, "length": x})
    return [pa.array(counts, pa.int64()), pa.array(hit, pa.int64()), pa.array(longest, pa.int64()), pa.array([sorted(set(x), key=_by_name) for x in lists], pa.list_(pa.string())), pa.array(matches, pa.list_(MATCH))]


def _shards(column: pa.Array, probes: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, number of words of each row) of about SHARD_WORDS words."""
    most = max(SHARD_WORDS, PROBE_WORDS * probes)
    held: list[Words] = []

    def flush() -> tuple[int, np.ndarray, np.ndarray]:
        counts = np.concatenate([np.bincount(w.row, minlength=w.hi - w.lo) for w in held])
        return held[0].lo, np.concatenate([w.key for w in held]), counts

    for words in hashed_words(column, ALNUM):
        if held and sum(len(w.key) for w in held) + len(words.key) > most:
            yield flush()
            held = []
        held.append(words)
    if held:
        yield flush()


def matcher(shared, keyed: bool = False):
    """A function over Arrow batches (doc_id, text) that reports each document's matches. ``keyed``
    batches have the column ROW, which is carried along as the last one."""
    names = ["doc_id", "n_words", "n_hit", "longest", "items", "matches", *([ROW] if keyed else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, keys, counts in _shards(batch.column("text"), len(shared.value.probe)):
                carried = [batch.column(ROW).slice(lo, len(counts))] if keyed else []
                yield pa.record_batch([batch.column("doc_id").slice(lo, len(counts)), *_judged(shared.value, keys, counts), *carried], names=names)

    return run


def _words_of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words in hashed_words(batch.column("text"), ALNUM):
            parts = np.split(words.key, np.cumsum(np.bincount(words.row, minlength=words.hi - words.lo))[:-1])
            yield pa.record_batch([batch.column("item_id").slice(words.lo, len(parts)), pa.array([p.tobytes() for p in parts], pa.binary())], names=["item_id", "words"])


def blocks(benchmark: DataFrame, window: int = WINDOW, most: int = BLOCK_WORDS) -> Iterator[Items]:
    """The benchmark in blocks of bounded size, hashed by tasks and read one partition at a time."""
    names, words, total = [], [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    for row in rows.mapInArrow(_words_of_items, "item_id string, words binary").toLocalIterator():
        found = np.frombuffer(row.words, np.uint64)
        if total and total + len(found) > most:
            yield Items(names, words, window)
            names, words, total = [], [], 0
        names.append(row.item_id)
        words.append(found)
        total += len(found)
    yield Items(names, words, window)


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: words, words hit, items found, the length of its longest match, and the places of
    its verbatim runs of a window or more.

    With several benchmark blocks the documents are written with a key for each row, by which the
    blocks' rows, written block after block, are combined.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    context, made = docs.sparkSession.sparkContext, blocks(benchmark, window)
    block, after = next(made), next(made, None)
    if after is None:
        return docs.mapInArrow(frugal(matcher(context.broadcast(block))), FOUND)
    docs = materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), "keyed")
    out = None
    while block is not None:
        shared = context.broadcast(block)
        part = materialize(docs.mapInArrow(frugal(matcher(shared, True)), f"{FOUND}, {ROW} long"), "block")
        shared.destroy()
        out = part if out is None else out.unionByName(part)
        block, after = after, next(made, None)
    return _combined(out)


def _combined(found: DataFrame) -> DataFrame:
    """One row for each ROW from its rows of several blocks; hits are counted over the union of runs."""
    runs = F.array_sort(F.flatten(F.collect_list("matches")), lambda x, y: F.when(x.doc_at < y.doc_at, -1).when(x.doc_at > y.doc_at, 1).otherwise(0))
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("sum"))
    cover = F.aggregate(
        F.col("matches"),
        start,
        lambda s, m: F.struct(F.greatest(s["end"], m["doc_at"] + m["length"]).alias("end"), (s["sum"] + F.greatest(F.lit(0).cast("long"), m["doc_at"] + m["length"] - F.greatest(s["end"], m["doc_at"]))).alias("sum")),
        lambda s: s["sum"],
    )
    merged = found.groupBy(ROW).agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.max("longest").alias("longest"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), runs.alias("matches"))
    return merged.select("doc_id", "n_words", cover.alias("n_hit"), "longest", "items", "matches")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest for every document."""
    found = longest_matches(docs, benchmark)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        "longest",
    )
