"""Filling fixed-capacity containers: bounded-space best-fit packing.

Every task keeps a fixed number of open windows per container.  An item goes
into the open window where it leaves the least space; if none has room, a new
window is opened, and if too many are open the fullest is emitted.  What is
still open when a task ends is merged: the pieces in open windows of many tasks
meet in a sixteenth as many tasks and are packed again, longest first, until one
task is left.  Each round hands on at most ``open_windows`` windows per container and task, so
no task ever sees more than ``MERGE * open_windows`` of them, however large the
corpus.

Sizes are tokens of a public tokenizer, counted over whole texts; texts and
tokens never leave the task that counted them.  An item is cut only if it alone
exceeds the capacity: into full windows and one rest, which is packed as an item.

Defined results: a null or empty text has no tokens and belongs to no window, it
comes out once with a null window; repeated rows are items of their own; an
empty table gives an empty result; further columns are ignored; capacities of
zero or less or null are no containers.
"""

from __future__ import annotations

import base64
import bisect
import importlib.util
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.session import Staged

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
OPEN_WINDOWS = 512
MERGE = 16

SCHEMA = "container string, window_id long, doc_id long, piece int, start_token int, n_tokens int, is_open boolean"
_ARROW = pa.schema(
    [
        ("container", pa.string()),
        ("window_id", pa.int64()),
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start_token", pa.int32()),
        ("n_tokens", pa.int32()),
        ("is_open", pa.bool_()),
    ]
)


@lru_cache(maxsize=2)
def tokenizer(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
    """The tokenizer of a folder of public vocabularies; loaded once per worker."""
    import tiktoken

    spec = importlib.util.spec_from_file_location("_vocabularies", f"{folder}/__init__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    with open(f"{folder}/{vocabulary}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Packer:
    """Bounded-space best fit for one container."""

    def __init__(self, capacity: int, first_id: int, open_windows: int = OPEN_WINDOWS) -> None:
        self.capacity, self.next_id, self.limit = capacity, first_id, open_windows
        self.free: list[tuple[int, int]] = []  # (free tokens, window), ascending: the fullest first
        self.held: dict[int, list[tuple]] = {}

    def new_id(self) -> int:
        self.next_id += 1
        return self.next_id

    def add(self, size: int, rows: list[tuple]) -> tuple[int, list[tuple]] | None:
        """Place rows of one size together; returns a window that had to be emitted."""
        emitted = None
        at = bisect.bisect_left(self.free, (size, -1))
        if at < len(self.free):
            left, window = self.free.pop(at)
            left -= size
        else:
            if len(self.free) >= self.limit:
                _, full = self.free.pop(0)
                emitted = full, self.held.pop(full)
            window, left = self.new_id(), self.capacity - size
        if left == 0:
            # only one window can be returned: a full one goes first, the other stays open
            self.held.setdefault(window, []).extend(rows)
            done = window, self.held.pop(window)
            if emitted is None:
                return done
            emitted_window, emitted_rows = emitted
            self.held[emitted_window] = emitted_rows
            bisect.insort(self.free, (self.capacity - sum(r[-1] for r in emitted_rows), emitted_window))
            return done
        self.held.setdefault(window, []).extend(rows)
        bisect.insort(self.free, (left, window))
        return emitted

    def rest(self) -> Iterator[tuple[int, list[tuple]]]:
        yield from self.held.items()


class _Out:
    """Rows gathered into Arrow batches."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def window(self, container: str, window: int, rows: list[tuple], is_open: bool = False) -> None:
        self.rows += [(container, window, *r, is_open) for r in rows]

    def flush(self, least: int) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            columns = zip(*self.rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)
            self.rows = []


def _first_id(level: int) -> int:
    return (level << 56) | (TaskContext.get().partitionId() << 32)


def pack(
    documents: DataFrame,
    capacities: dict[str, int],
    open_windows: int = OPEN_WINDOWS,
    folder: str = TOKENIZERS,
    vocabulary: str = VOCABULARY,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(container, window_id, doc_id, piece, start_token, n_tokens) of every piece of every text."""
    capacities = {k: int(v) for k, v in capacities.items() if v and v > 0}

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(folder, vocabulary).encode_ordinary
        packers = {}
        for i, (name, capacity) in enumerate(capacities.items()):
            packers[name] = Packer(capacity, _first_id(0) | (i << 28), open_windows)
        out = _Out()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                size = len(encode(text)) if text else 0
                for name, p in packers.items():
                    if not size:
                        out.rows.append((name, None, doc_id, 0, 0, 0, False))
                        continue
                    whole, last = divmod(size, p.capacity)
                    for piece in range(whole):
                        out.window(name, p.new_id(), [(doc_id, piece, piece * p.capacity, p.capacity)])
                    if last and (closed := p.add(last, [(doc_id, whole, whole * p.capacity, last)])):
                        out.window(name, *closed)
            yield from out.flush(20_000)
        for name, p in packers.items():
            for window, rows in p.rest():
                out.window(name, window, rows, True)
        yield from out.flush(1)

    def merge_at(level: int):
        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces: list[tuple] = []
            for batch in batches:
                pieces += zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5)), strict=True)
            packers = {n: Packer(c, _first_id(level) | (i << 28), open_windows) for i, (n, c) in enumerate(capacities.items())}
            out = _Out()
            # long pieces first, which leaves the short ones to fill the gaps
            for name, *row in sorted(pieces, key=lambda x: (-x[-1], x)):
                if closed := packers[name].add(row[-1], [tuple(row)]):
                    out.window(name, *closed)
            for name, p in packers.items():
                for window, rows in p.rest():
                    out.window(name, window, rows, True)
            yield from out.flush(1)

        return merge

    texts = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    parts = texts.rdd.getNumPartitions()
    level, stages = 0, [Staged(texts.mapInArrow(fill, SCHEMA), "packed")]
    while parts > 1:
        parts = -(-parts // MERGE)
        level += 1
        # all rows of a window go to one task
        still_open = stages[-1].df.where("is_open").repartition(parts, "window_id")
        stages.append(Staged(still_open.mapInArrow(merge_at(level), SCHEMA), "packed"))
    out = stages[-1].df
    for s in stages[:-1]:
        out = out.unionByName(s.df.where(~F.col("is_open")))
    return out.drop("is_open")


def fill_report(packed: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """Per container: windows, tokens, unused share and the least number of windows possible."""
    sizes = F.create_map(*[x for k, v in capacities.items() for x in (F.lit(k), F.lit(int(v)))])
    windows = packed.where(F.col("window_id").isNotNull()).groupBy("container", "window_id").agg(F.sum("n_tokens").alias("n_tokens"))
    capacity = F.element_at(sizes, F.col("container"))
    return windows.groupBy("container").agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.sum("n_tokens").alias("n_tokens"),
        F.max("n_tokens").alias("fullest"),
        F.round(1 - F.sum("n_tokens") / F.sum(capacity), 6).alias("unused_share"),
        F.ceil(F.sum("n_tokens") / F.first(capacity)).alias("least_windows"),
    )
