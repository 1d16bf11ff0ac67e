"""Token counts of whole texts, as the tokenizer library gives them.

Ordinary documents are encoded word by word through a bounded memo. That is exact for tokenizers
whose pre-tokenizer drops white space: no merge, composition or special string crosses it
(``splits_at_space`` reads this off the tokenizer's own file). Words are found, told apart and put
together again over whole batches, as arrays. Other tokenizers get whole texts.

Huge documents are encoded in overlapping chunks with offsets. Two neighbours are spliced at the
first place in their overlap that is proven stable, where both start a token, and from which they
agree on every token up to the last such place that both see. Stable places follow from the
tokenizer's file: after white space, or between characters of unlike classes. Where an overlap has
no such place, or the chunks don't agree, it is widened, at last to the whole chunk; then the chunk
is read again at twice its length, so that all reading together stays in proportion to the text.

Cases: null counts as empty and has 0 tokens. Rows that repeat are counted each by itself. A null
doc_id passes through. An empty table gives an empty result. Other columns are ignored. A text of any
length is encoded whole, by one task; words of more than LONG bytes are encoded each time they occur.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, slices, utf8
from .words import LOWER, PIECE, SPACED, _hashes, _spans

CHUNK, OVERLAP = 1 << 15, 1 << 10
#: Bytes from which a document is encoded in chunks.
HUGE = 1 << 16
#: Words that a worker's memo holds at most, told apart by 64-bit hashes; the longest of them in bytes.
MEMO, LONG = 1_200_000, 64
_SLOTS = 1 << 21
LIMIT = 2048

_encoders: dict[str, Encoder] = {}
#: Pre-tokens of letters, of single digits, and of marks.
_CLASSES = "[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

Traced = tuple[np.ndarray, np.ndarray]
Places = Callable[[str, int, int], np.ndarray]


def splits_at_space(spec: dict) -> bool:
    """Whether the first pre-tokenizer step keeps only matches that hold no white space."""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [spec.get("pre_tokenizer") or {}]
    first = steps[0]
    if first.get("type") in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer"):
        return True
    pattern = str((first.get("pattern") or {}).get("Regex", ""))
    parts = spec.get("normalizer") or {}
    normal = all(x.get("type") in ("NFC", "NFD", "Lowercase", "Replace") for x in parts.get("normalizers", [parts] if parts else []))
    return first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert")) and "|\\s" not in pattern and " " not in pattern and normal


@lru_cache(2)
def _boundary(spaces: bool):
    """Between letters, digits and other characters that neither combine with what is before them nor
    are apostrophes; with ``spaces`` also after white space."""
    import regex

    kinds = (r"\p{L}", r"\p{N}", r"[^\s\p{L}\p{N}\p{M}\p{C}']")
    pairs = [f"(?<={a})(?={b})" for a in kinds for b in kinds if a != b]
    return regex.compile("|".join([*pairs, *([r"(?<=[ \t\n\r\x0b\x0c])(?=[^\s\p{M}])"] if spaces else [])]))


def between_classes(text: str, lo: int, hi: int) -> np.ndarray:
    return np.array([m.start() for m in _boundary(False).finditer(text, lo, hi)], np.int64)


def after_space(text: str, lo: int, hi: int) -> np.ndarray:
    """Places of [lo, hi) just after ASCII white space."""
    codes = np.frombuffer(text[lo:hi].encode("utf-32-le", "surrogatepass"), "<u4")
    space = (codes == 0x20) | ((codes >= 0x09) & (codes <= 0x0D))
    return np.flatnonzero(space[:-1] & ~space[1:]) + lo + 1


def between_both(text: str, lo: int, hi: int) -> np.ndarray:
    return np.array([m.start() for m in _boundary(True).finditer(text, lo, hi)], np.int64)


class Encoder:
    """A tokenizer file and a memo of the ids of words.

    ``classes``: letters, digits and marks are separate pre-tokens and lower case is all that counts,
    so words may also be cut between a letter and the ASCII marks at their end, and words of letters
    only are one pre-token each, whose last token bears the end-of-word suffix.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"].encode() for x in spec.get("added_tokens") or []]
        self.by_word = splits_at_space(spec) and not any(len(x.split()) != 1 for x in self.special)
        suffix = spec.get("model", {}).get("end_of_word_suffix")
        lower = any(x.get("type") == "Lowercase" for x in (spec.get("normalizer") or {}).get("normalizers", []))
        classes = _CLASSES in json.dumps(spec["pre_tokenizer"]).replace("\\\\", "\\")
        self.classes = self.by_word and suffix == "</w>" and lower and classes
        if self.classes:
            self.special = [x.lower() for x in self.special]
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for w, i in vocabulary.items() if w.endswith(suffix)]] = True
        byte_level = (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and (spec["pre_tokenizer"]).get("use_regex", True) and not spec.get("normalizer")
        #: stable places of a text, or None where the file proves none
        self.places: Places | None = between_both if self.classes else after_space if self.by_word else between_classes if byte_level else None
        # the memo: word hashes in a table of open addressing, and the ids of words one after the other
        self.keys, self.slots = np.zeros(_SLOTS, np.uint64), np.full(_SLOTS, -1, np.int32)
        self.begin, self.size, self.known = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0
        self.ids, self.used = np.zeros(1 << 16, "<u4"), 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def traced(self, text: str) -> Traced:
        """Ids and the character at which each token starts."""
        done = self.tokenizer.encode(text, add_special_tokens=False)
        return np.array(done.ids, "<u4"), np.array([a for a, _ in done.offsets], np.int64)

    def huge(self, text: str) -> np.ndarray:
        return self.whole(text) if self.places is None else spliced(text, self.traced, places=self.places)

    def _each(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        done = [x.ids for x in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        return np.array([i for x in done for i in x], "<u4"), np.array([len(x) for x in done], np.int64)

    def _together(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters only, encoded as one text and cut after each end-of-word token."""
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words) or stops[-1] != len(ids):
            return self._each(words)
        return ids, np.diff(stops, prepend=0)

    def _encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the words in some order; where each word's begin, and how many they are."""
        alike = np.array([self.classes and (t := w.decode()).isalpha() and t.lower().isalpha() for w in words], bool)
        order = np.concatenate([np.flatnonzero(alike), np.flatnonzero(~alike)])
        parts = [f([words[i] for i in part.tolist()]) for f, part in ((self._together, np.flatnonzero(alike)), (self._each, np.flatnonzero(~alike))) if len(part)]
        sizes = np.concatenate([p[1] for p in parts])
        begin, size = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        begin[order], size[order] = np.cumsum(sizes) - sizes, sizes
        return np.concatenate([p[0] for p in parts]), begin, size

    def _find(self, key: np.ndarray) -> np.ndarray:
        """The memo's number of each word, or -1."""
        slot = (key & np.uint64(_SLOTS - 1)).astype(np.int64)
        at = self.slots[slot]
        open_ = np.flatnonzero((at >= 0) & (self.keys[slot] != key))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (_SLOTS - 1)
            at[open_] = self.slots[slot[open_]]
            open_ = open_[(at[open_] >= 0) & (self.keys[slot[open_]] != key[open_])]
        return at

    def _insert(self, key: np.ndarray, number: np.ndarray) -> None:
        slot = (key & np.uint64(_SLOTS - 1)).astype(np.int64)
        while len(key):
            free = self.slots[slot] < 0
            self.slots[slot[free]], self.keys[slot[free]] = number[free], key[free]
            # of several new words at one slot the last one has it
            out = self.slots[slot] != number
            key, number, slot = key[out], number[out], (slot[out] + 1) & (_SLOTS - 1)

    def _learn(self, key: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Begin and number of the ids of new words. Long words, and those that a full memo has no
        room for, hold good until the next call."""
        ids, start, size = self._encoded(words)
        keep = np.array([len(w) <= LONG for w in words])
        keep &= np.cumsum(keep) <= MEMO - self.known
        order = np.argsort(~keep, kind="stable")
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), "<u4")])
        n = self.known + int(keep.sum())
        while n > len(self.begin):
            self.begin, self.size = np.concatenate([self.begin, self.begin * 0]), np.concatenate([self.size, self.size * 0])
        total = np.cumsum(size[order])
        self.ids[self.used : self.used + len(ids)] = ids[np.repeat(start[order] - total + size[order], size[order]) + np.arange(len(ids))]
        begin = np.empty(len(words), np.int64)
        begin[order] = self.used + total - size[order]
        self.begin[self.known : n], self.size[self.known : n] = begin[keep], size[keep]
        self._insert(key[keep], np.arange(self.known, n, dtype=np.int32))
        self.known, self.used = n, self.used + int(size[keep].sum())
        return begin, size

    def _cut(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of the words of non-empty rows; marks at a word's end are words of their own."""
        full = offsets[1:] > offsets[:-1]
        begin, end = _spans(raw, offsets[:-1][full], offsets[1:][full], SPACED)
        if not self.classes or not len(begin):
            return begin, end
        mark = _MARK[raw]
        last = np.flatnonzero(mark[end - 1])
        firsts = np.flatnonzero(mark & ~np.append(False, mark[:-1]))
        # the run of marks that the word ends with; it may begin in an earlier word only without a space between
        run = firsts[np.searchsorted(firsts, end[last] - 1, "right") - 1]
        inside = run > begin[last]
        last, run = last[inside], run[inside]
        before, lead = raw[run - 1], raw[np.maximum(run - 2, 0)]
        # two-byte Latin letters: not the signs for times and division, nor the dotted I, whose lower case has two parts
        latin = (run - 2 >= begin[last]) & (before >= 0x80) & (before < 0xC0) & (lead >= 0xC3) & (lead <= 0xC9)
        latin &= ~((lead == 0xC3) & ((before == 0x97) | (before == 0xB7))) & ~((lead == 0xC4) & (before == 0xB0))
        run = run[_LETTER[before] | latin]
        at = np.searchsorted(begin, run, "right")
        return np.insert(begin, at, run), np.insert(end, at - 1, run)

    def words(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For the words of a batch of texts: begin and number of ids, row; and the array of the ids."""
        if self.classes:
            raw = LOWER[raw]
        begin, end = self._cut(raw, offsets) if len(raw) else (raw, raw)
        if not len(begin):
            return (np.zeros(0, np.int64),) * 3 + (self.ids,)
        key = _hashes(raw, begin, end)
        at = self._find(key)
        missing = np.flatnonzero(at < 0)
        if not len(missing):
            start, size = self.begin[at], self.size[at]
        else:
            fresh, first, which = np.unique(key[missing], return_index=True, return_inverse=True)
            new = self._learn(fresh, [raw[a:b].tobytes() for a, b in zip(begin[missing[first]].tolist(), end[missing[first]].tolist(), strict=True)])
            start, size = self.begin[at], self.size[at]
            start[missing], size[missing] = new[0][which], new[1][which]
        return start, size, np.searchsorted(offsets[1:], begin, "right"), self.ids

    def _apart(self, raw: np.ndarray, offsets: np.ndarray) -> list[int]:
        """Rows that are not cut into words: huge ones, and those with special strings, in whatever case
        if words are lower-cased."""
        out = set(np.flatnonzero(np.diff(offsets) >= HUGE).tolist())
        data = (LOWER[raw] if self.classes else raw).tobytes() if self.special else b""
        for text in self.special:
            at = data.find(text)
            while at >= 0:
                row = int(np.searchsorted(offsets[1:], at, "right"))
                out.add(row)
                at = data.find(text, max(at + 1, int(offsets[row + 1]) - len(text) + 1))
        return sorted(out)


# Marks that end a letter run in a pre-tokenizer of classes; none takes part in a composition.
_MARK, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_MARK[[ord(c) for c in ".,%$#&*!;:?"]] = True
_LETTER[97:123] = True


def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _agreed(places: np.ndarray, left: Traced, right: Traced, begin: int) -> tuple[int, int] | None:
    """Positions in the two token lists, the first no less than ``begin``, from which they agree: the
    first stable place where both start a token, with equal tokens from there to the last place."""
    (ids_a, at_a), (ids_b, at_b) = left, right
    i, j = int(np.searchsorted(at_a, places[-1])), int(np.searchsorted(at_b, places[-1]))
    n = min(i - begin, j)
    if n <= 0:
        return None
    same = (ids_a[i - n : i] == ids_b[j - n : j]) & (at_a[i - n : i] == at_b[j - n : j])
    unlike = np.flatnonzero(~same)
    m = n - (int(unlike[-1]) + 1 if len(unlike) else 0)
    if not m:
        return None
    # a token that begins at a place is the first that does
    starts = at_a[i - m : i]
    fresh = starts != np.append(at_a[i - m - 1] if i > m else -1, starts[:-1])
    if j > m:
        fresh[0] &= at_b[j - m - 1] != starts[0]
    found = np.flatnonzero(fresh & np.isin(starts, places[:-1]))
    return (i - m + int(found[0]), j - m + int(found[0])) if len(found) else None


def spliced(text: str, traced: Callable[[str], Traced], chunk: int = CHUNK, overlap: int = OVERLAP, places: Places = after_space) -> np.ndarray:
    """Ids of a huge text from overlapping chunks; equal to those of encoding it whole."""

    def encoded(lo: int, hi: int) -> Traced:
        ids, at = traced(text[lo:hi])
        return ids, at + lo

    out: list[np.ndarray] = []
    lo, hi, begin = 0, min(len(text), chunk), 0
    left = encoded(lo, hi)
    while hi < len(text):
        width, cut = min(overlap, hi - lo), None
        while cut is None:
            start = hi - width
            stable = places(text, start, hi)
            if len(stable) > 1:
                end = min(len(text), start + max(chunk, 2 * width))
                right = encoded(start, end)
                cut = _agreed(stable, left, right, begin)
            if start == lo:
                break
            width = min(2 * width, hi - lo)
        if cut is None:
            # nothing in the whole chunk aligns: it is read again, twice as long
            hi = min(len(text), lo + 2 * (hi - lo))
            left = encoded(lo, hi)
        else:
            out.append(left[0][begin : cut[0]])
            lo, hi, left, begin = start, end, right, cut[1]
    out.append(left[0][begin:])
    return np.concatenate(out)


def _batches(column: pa.Array, path: str, batch: int) -> Iterator[tuple]:
    """(number of rows, sizes and rows of words, begins, ids, ids of rows that are encoded apart)."""
    tool = encoder(path)
    raw, offsets = utf8(column)
    for lo, hi in slices(offsets, batch):
        data, edges = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        text = lambda i: data[edges[i] : edges[i + 1]].tobytes().decode("utf-8")  # noqa: B023, E731
        if not tool.by_word:
            apart = {i: tool.huge(text(i)) if edges[i + 1] - edges[i] >= HUGE else tool.whole(text(i)) for i in range(hi - lo)}
            yield hi - lo, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), tool.ids, apart
            continue
        alone = tool._apart(data, edges)
        apart = {i: tool.huge(text(i)) if edges[i + 1] - edges[i] >= HUGE else tool.whole(text(i)) for i in alone}
        if alone:
            # the other rows, pushed together
            keep = np.ones(hi - lo, bool)
            keep[alone] = False
            size = np.where(keep, np.diff(edges), 0)
            data, edges = data[np.repeat(keep, np.diff(edges))], np.concatenate([[0], np.cumsum(size)])
        begin, size, row, ids = tool.words(data, edges)
        yield hi - lo, size, row, begin, ids, apart


def encoded_rows(column: pa.Array, path: str, batch: int = PIECE) -> Iterator[bytes]:
    """The ids of every row's whole text, as little-endian unsigned 32-bit bytes."""
    for n, size, row, begin, ids, apart in _batches(column, path, batch):
        total = np.concatenate([[0], np.cumsum(size)])
        data = ids[np.repeat(begin - total[:-1], size) + np.arange(total[-1])]
        edges = total[np.searchsorted(row, np.arange(n + 1))]
        for i in range(n):
            yield apart[i].tobytes() if i in apart else data[edges[i] : edges[i + 1]].tobytes()


def counted_rows(column: pa.Array, path: str, batch: int = PIECE) -> np.ndarray:
    """The number of tokens of every row's whole text."""
    out = [np.zeros(0, np.int64)]
    for n, size, row, _, _, apart in _batches(column, path, batch):
        counts = np.bincount(row, size, n).astype(np.int64)
        for i, found in apart.items():
            counts[i] = len(found)
        out.append(counts)
    return np.concatenate(out)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs`` (doc_id, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = utf8(batch.column("text"))
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(counted_rows(batch.column("text"), path), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(frugal(count), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
