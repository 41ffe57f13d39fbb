"""Evaluation texts leaking into training text.

1. *Scan.*  Every document is read once, whole, however many items there are.
   Words are compared without case, punctuation, apostrophes, hyphens and line ends
   (a word cut at a line end is joined).  The n-grams of the items are marked in a
   Bloom filter of fixed size; where a document's words pass it, the passage around
   the hits is kept: the numbers of its words and the n-grams in it.
2. *Rare seeds.*  Passages and items are joined on n-grams, which drops what the
   filter let through by chance and gives every n-gram's document frequency.  The
   seeds of an item are all its n-grams except the most frequent ones, left out only
   as long as those together cover fewer words than a leak needs.  So each leak holds
   at least one seed, whatever it copies, while stock sentences start no candidates.  A join on seeds gives the candidates.
3. *Alignment.*  Each passage of a candidate is aligned with the item by
   Smith-Waterman over words (match 2, mismatch -1, gap -1), many pairs at a time.
   An edited copy keeps a high score, as edits only cost their own words:
   ``edited_copies`` are the candidates whose score reaches a share of the item's.
4. *Exact check.*  ``find_leaks`` are the candidates in which the words of the item
   inside copied stretches of ``STRETCH`` or more words reach the share; as the check
   costs less, it comes before the alignment there, and only what passes is aligned.

Words and n-grams are numbers of 62 bits.

Defined results: null and empty texts carry nothing and are carried by nothing;
rows without an id are left out; an item of fewer than five words is never carried;
repeated rows of a document give one row per item, the best; repeated items are
items of their own; texts may be of any length; empty tables give an empty result;
further columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.session import Staged

#: Words of a copied stretch, and of a seed.
STRETCH, SEED = 5, 4
#: Words kept on both sides of a hit, for the alignment.
MARGIN = 32
#: The size of what is sent to the workers: 2 to this power of bits.
FILTER_BITS = 27
MATCH, MISMATCH, GAP = 2, -1, -1
MAX_CACHE = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POSITIVE = np.uint64((1 << 62) - 1)

_APOSTROPHES = str.maketrans("", "", "'’`´")
_HYPHENS = re.compile("(?<=\\w)[-\u2010\u2011\u00ad](?:[ \\t]*\\r?\\n[ \\t]*)?(?=\\w)")
_WORDS = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """The words of a text as they are compared."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.replace("\u00ad", "-"))
    text = text.lower().translate(_APOSTROPHES)
    if "-" in text or "\u2010" in text or "\u2011" in text:
        text = _HYPHENS.sub("", text)
    return _WORDS.findall(text)


class Numbers(dict):
    """The number of a word, kept once made."""

    def __missing__(self, word: str) -> int:
        if len(self) > MAX_CACHE:
            self.clear()
        number = self[word] = (xxhash.xxh64_intdigest(word) & ((1 << 62) - 1)) or 1
        return number


def numbers_of(text: str | None, numbers: Numbers) -> list[int]:
    return list(map(numbers.__getitem__, words_of(text)))


def grams_of(ids: np.ndarray, n: int) -> np.ndarray:
    """The numbers of all n-grams of a sequence of word numbers; those across a 0 mean nothing."""
    places = max(0, len(ids) - n + 1)
    key = np.zeros(places, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            key = (key ^ (key >> np.uint64(29))) * _BASE + ids[k : k + places].astype(np.uint64)
        key ^= key >> np.uint64(31)
    return (key & _POSITIVE).astype(np.int64)


class Filter:
    """A Bloom filter with two marks per n-gram."""

    def __init__(self, bits: int = FILTER_BITS) -> None:
        self.mask = np.int64((1 << bits) - 1)
        self.marks = np.zeros(1 << (bits - 3), np.uint8)

    def _places(self, grams: np.ndarray) -> Iterator[np.ndarray]:
        yield grams & self.mask
        yield (grams >> 30) & self.mask

    def add(self, grams: np.ndarray) -> None:
        for at in self._places(grams):
            np.bitwise_or.at(self.marks, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def may_hold(self, grams: np.ndarray) -> np.ndarray:
        out = np.ones(len(grams), bool)
        for at in self._places(grams):
            out &= (self.marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


def needed_words(n_words: int, min_share: float) -> int:
    """The least number of copied words that makes the share."""
    return max(1, int(np.ceil(n_words * min_share - 1e-9)))


def covered(places: np.ndarray, n_words: int, n: int = STRETCH) -> np.ndarray:
    """Marks of the words inside n-grams that start at the places."""
    edge = np.zeros(n_words + 1, np.int32)
    np.add.at(edge, places, 1)
    np.add.at(edge, np.minimum(places + n, n_words), -1)
    return np.cumsum(edge[:-1]) > 0


def choose_seeds(grams: np.ndarray, frequency: np.ndarray, min_share: float) -> np.ndarray:
    """The seeds of one item: its n-grams by place, each with its document frequency."""
    n_words = len(grams) + SEED - 1
    need = needed_words(n_words, min_share)
    distinct, first, which = np.unique(grams, return_index=True, return_inverse=True)
    order = np.lexsort((distinct, -frequency[first]))

    def reach(left_out: int) -> int:
        """Words inside the most frequent n-grams."""
        out = np.zeros(len(distinct), bool)
        out[order[:left_out]] = True
        return int(covered(np.flatnonzero(out[which]), n_words, SEED).sum())

    # n-grams of one document need not be left out; the more are, the farther they reach, so the most that may go is found by halving
    low, high = 0, int((frequency[first] > 1).sum())
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if reach(middle) < need else (low, middle - 1)
    kept = order[low:]
    return distinct[kept[frequency[first][kept] > 0]]


def smith_waterman(pairs: list[tuple[np.ndarray, np.ndarray]], cells: int = 4_000_000) -> list[int]:
    """Best local alignment score of each (item words, document words), many pairs at a time."""
    out = [0] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda i: len(pairs[i][1]))
    while order:
        # as many pairs of like length as fit
        width = len(pairs[order[0]][1])
        batch: list[int] = []
        while order and (not batch or len(pairs[order[0]][1]) * (len(batch) + 1) <= cells // 40 and len(batch) < 256):
            batch.append(order.pop(0))
        width = max(len(pairs[i][1]) for i in batch)
        height = max(len(pairs[i][0]) for i in batch)
        doc = np.full((len(batch), width), -1, np.int64)
        item = np.zeros((len(batch), height), np.int64)
        for k, i in enumerate(batch):
            item[k, : len(pairs[i][0])], doc[k, : len(pairs[i][1])] = pairs[i]
        row = np.zeros((len(batch), width + 1), np.int32)
        best = np.zeros(len(batch), np.int32)
        ramp = -GAP * np.arange(width + 1, dtype=np.int32)
        for j in range(height):
            hit = (doc == item[:, j, None]) & (item[:, j, None] != 0)
            new = np.zeros_like(row)
            new[:, 1:] = np.maximum(row[:, :-1] + np.where(hit, MATCH, MISMATCH), row[:, 1:] + GAP)
            np.maximum(new, 0, out=new)
            # gaps along the document: the running maximum of score + place
            row = np.maximum.accumulate(new + ramp, axis=1) - ramp
            best = np.maximum(best, row.max(axis=1))
        for k, i in enumerate(batch):
            out[i] = int(best[k])
    return out


_PASSAGES = "doc_id long, words array<long>, grams array<long>"
_ITEMS = "item_id long, words array<long>, grams array<long>"
_PAIRS = "doc_id long, item_id long, item_words int, copied_words int, share double, alignment double"


def _arrays(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def _numbered_items(items: DataFrame) -> DataFrame:
    """(item_id, words, grams): the numbers of every item's words, and its n-grams by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers()
        for batch in batches:
            out = []
            for item_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.array(numbers_of(text, numbers), np.int64)
                if len(ids) >= STRETCH:
                    out.append((item_id, ids, grams_of(ids, SEED)))
            yield _arrays(out, ["item_id", "words", "grams"])

    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL").mapInArrow(run, _ITEMS)


def _passages(documents: DataFrame, marks: Filter) -> DataFrame:
    """(doc_id, words, grams): the passages around hits, a 0 after each, and the n-grams hit."""
    shared = documents.sparkSession.sparkContext.broadcast(marks)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked, numbers = shared.value, Numbers()
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for start in range(0, len(doc_ids), 256):
                flat, ends = [], []
                for text in texts[start : start + 256]:
                    flat += numbers_of(text.as_py(), numbers)
                    flat.append(0)  # no n-gram runs from one text into the next
                    ends.append(len(flat))
                ids = np.array(flat, np.int64)
                grams = grams_of(ids, SEED)
                hit = marked.may_hold(grams)
                breaks = np.flatnonzero(ids == 0)
                for k in range(SEED):
                    at = breaks - k
                    hit[at[(at >= 0) & (at < len(hit))]] = False
                places = np.flatnonzero(hit)
                cut, out = np.searchsorted(places, [0, *ends]), []
                for k in np.flatnonzero(np.diff(cut)):
                    mine = places[cut[k] : cut[k + 1]]
                    first, last = (ends[k - 1] if k else 0), ends[k] - 1
                    # hits so near that their margins touch are one passage
                    apart = np.flatnonzero(np.diff(mine) > 2 * MARGIN + SEED) + 1
                    words = []
                    for group in np.split(mine, apart):
                        words += [ids[max(first, group[0] - MARGIN) : min(last, group[-1] + SEED + MARGIN)], [0]]
                    out.append((doc_ids[start + k], np.concatenate(words).astype(np.int64), np.unique(grams[mine])))
                if out:
                    yield _arrays(out, ["doc_id", "words", "grams"])

    return documents.mapInArrow(scan, _PASSAGES)


def align_items(documents: DataFrame, items: DataFrame, min_share: float = 1 / 3, doc_id: str = "doc_id", text: str = "text", shared_only: bool = False) -> DataFrame:
    """(doc_id, item_id, item_words, copied_words, share, alignment) of every candidate, aligned and checked.

    ``share``: the part of the item's words in copied stretches; ``alignment``: the best score of a passage over the item's own.
    ``shared_only`` leaves candidates below the share out, before they are aligned.
    """
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    numbered = Staged(_numbered_items(items), "leak-items")
    marks = Filter()
    for r in numbered.df.select("grams").toLocalIterator():  # one item at a time; only the filter stays
        marks.add(np.array(r.grams, np.int64))
    passages = Staged(_passages(docs, marks), "leak-passages")
    hits = passages.df.select("doc_id", F.explode("grams").alias("gram"))
    by_place = numbered.df.select("item_id", F.posexplode("grams").alias("place", "gram"))
    # repeated rows of a document may count more than once, which leaves the seeds right
    frequency = Staged(hits.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).join(by_place.select("gram").distinct(), "gram", "left_semi"), "leak-frequency")
    # an item is one text, so its n-grams fit a row
    counted = by_place.join(frequency.df, "gram", "left").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("place", "gram", F.coalesce("n", F.lit(0)).alias("n")))).alias("g"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, grams = [], []
            for item_id, g, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seeds = choose_seeds(np.array(g, np.int64), np.array(n, np.int64), min_share)
                ids += [item_id] * len(seeds)
                grams += seeds.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(grams, pa.int64())], names=["item_id", "gram"])

    seeds = counted.select("item_id", F.col("g.gram").alias("gram"), F.col("g.n").alias("n")).mapInArrow(choose, "item_id long, gram long")
    candidates = Staged(hits.join(seeds, "gram").select("doc_id", "item_id").distinct(), "leak-candidates")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, pairs, owner = [], [], []
            for d, i, words, item in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                doc, item = words.values.to_numpy(), item.values.to_numpy()
                copied = int(covered(np.flatnonzero(np.isin(grams_of(item, STRETCH), grams_of(doc, STRETCH))), len(item)).sum())
                if shared_only and copied < needed_words(len(item), min_share):
                    continue
                for passage in np.split(doc, np.flatnonzero(doc == 0)):
                    own = np.flatnonzero(np.isin(passage, item))
                    if len(own):
                        pairs.append((item, passage[max(0, own[0]) : own[-1] + 1]))
                        owner.append(len(found))
                found.append([d, i, len(item), copied, copied / len(item), 0.0])
            for k, score in zip(owner, smith_waterman(pairs), strict=True):
                found[k][5] = max(found[k][5], score / (MATCH * found[k][2]))
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in found], t) for c, t in enumerate(types)], names=["doc_id", "item_id", "item_words", "copied_words", "share", "alignment"]
            )

    pairs = candidates.df.join(passages.df.select("doc_id", "words"), "doc_id").join(numbered.df.select("item_id", F.col("words").alias("item")), "item_id")
    # few bytes are much work here, so they are spread, not coalesced
    tasks = max(2 * documents.sparkSession.sparkContext.defaultParallelism, candidates.df.count() // 20_000)
    rows = pairs.select("doc_id", "item_id", "words", "item").repartition(tasks).mapInArrow(align, _PAIRS)
    aligned = rows.groupBy("doc_id", "item_id").agg(F.max(F.struct("item_words", "copied_words", "share", "alignment")).alias("r")).select("doc_id", "item_id", "r.*")
    out = Staged(aligned, "leak-aligned")
    for staged in (numbered, passages, frequency, candidates):
        staged.drop()
    return out.df


def find_leaks(documents: DataFrame, items: DataFrame, min_share: float = 1 / 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The candidates of ``align_items`` that carry the share of an item in copied stretches."""
    aligned = align_items(documents, items, min_share, doc_id, text, shared_only=True)
    # any copied stretch scores as much; the share decides, counted in whole words
    copied = F.col("alignment") * F.col("item_words") >= STRETCH - 1e-9
    return aligned.where(copied & (F.col("copied_words") >= F.greatest(F.lit(1), F.ceil(F.col("item_words") * min_share - 1e-9))))


def edited_copies(documents: DataFrame, items: DataFrame, min_alignment: float = 0.5, min_share: float = 1 / 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The candidates with a passage that aligns with an item by ``min_alignment`` of its greatest score: copies, edited or not."""
    return align_items(documents, items, min_share, doc_id, text).where(F.col("alignment") >= min_alignment)
