"""Packing: whole documents to training sequences in order, cut where padding plus truncation costs least.

Texts are range-partitioned and sorted by doc_id and encoded where they lie. In a partition, runs of about
``RUN`` tokens are cut by dynamic programming over allowed cuts: document ends are free, sentence ends cost
``SENTENCE`` tokens, and inside a sentence a cut is allowed every ``GAP`` tokens at the price of ``INSIDE``.
A sequence costs its padding and ``OPEN``. Ending a sequence at position p after one that ended at q costs
best(q) + q + (window - p) + price(p), so the best q is the minimum of best(q) + q over the last ``window``
tokens: a queue with increasing values gives it in constant time. Lengths that are a power of two need no
padding and are looked up one by one.

Defined cases: a null text is empty and has just the end id; null ids come first; rows with the same id are
packed one after the other, ordered by text; documents longer than a window span several sequences; no rows
give an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import lean_batches
from .subwords import coder, tokenizer_path
from .token_files import in_order

WINDOW, RUN = 4096, 1 << 18
SENTENCE, INSIDE, GAP, OPEN, LEAST_POWER = 16, 256, 512, 16, 64


def padded(length: int, window: int = WINDOW) -> int:
    """The stored length of a sequence: a power of two as it is, else the window."""
    return length if length & (length - 1) == 0 else window


def best_cuts(places: list[int], prices: list[int], window: int = WINDOW) -> list[int]:
    """Ends of sequences. places: allowed ends in rising order, the last of which is taken; no gap is above the window."""
    total = places[-1]
    where = [-1] * (total + 1)
    where[0] = 0
    at, best, back = [0, *places], [0], [0]
    queue: deque[int] = deque([0])
    level = [0]  # best(q) + q
    powers = [1 << k for k in range(LEAST_POWER.bit_length() - 1, (window - 1).bit_length())]
    for j in range(1, len(at)):
        p, price = at[j], prices[j - 1] + OPEN
        while at[queue[0]] < p - window:
            queue.popleft()
        i = queue[0]
        cost = level[i] + window - p
        for size in powers:
            if size > p:
                break
            k = where[p - size]
            if k >= 0 and best[k] < cost:
                i, cost = k, best[k]
        cost += price
        best.append(cost)
        back.append(i)
        where[p] = j
        level.append(cost + p)
        while queue and level[queue[-1]] >= cost + p:
            queue.pop()
        queue.append(j)
    ends, j = [], len(at) - 1
    while j:
        ends.append(at[j])
        j = back[j]
    return ends[::-1]


def allowed_cuts(ids: np.ndarray, doc_ends: np.ndarray, stops: np.ndarray) -> tuple[list[int], list[int]]:
    """Places and prices of cuts in a run of ids: documents' ends, sentences' ends, and some between that lie far apart."""
    price = np.full(len(ids) + 1, -1, np.int32)
    price[np.flatnonzero(stops[ids]) + 1] = SENTENCE
    price[doc_ends] = 0
    price[len(ids)] = 0
    found = np.flatnonzero(price[1:] >= 0) + 1
    gaps = np.diff(found, prepend=0)
    for k in np.flatnonzero(gaps > GAP).tolist():
        more = np.arange(found[k] - gaps[k] + GAP, found[k], GAP)
        price[more] = INSIDE
    found = np.flatnonzero(price[1:] >= 0) + 1
    return found.tolist(), price[found].tolist()


class Packer:
    """Cuts a stream of documents; ``add`` gives back the pieces of each run that is full."""

    def __init__(self, stops: np.ndarray, base: int, window: int = WINDOW, run: int = RUN):
        self.stops, self.next, self.window, self.run = stops, base, window, run
        self.segments, self.held = [], 0

    def add(self, doc_id, ids: np.ndarray) -> Iterator[tuple]:
        start = 0
        while start < len(ids):
            part = ids[start : start + self.run]
            self.segments.append((doc_id, start, part, len(ids)))
            self.held += len(part)
            start += len(part)
            if self.held >= self.run:
                yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        if not self.segments:
            return
        ids = np.concatenate([s[2] for s in self.segments])
        ends = np.cumsum([len(s[2]) for s in self.segments])
        closed = ends[[s[1] + len(s[2]) == s[3] for s in self.segments]]
        cuts = np.array(best_cuts(*allowed_cuts(ids, closed, self.stops), self.window))
        edges = np.union1d(cuts, ends)
        begins = np.concatenate([[0], edges[:-1]])
        segment, sequence = np.searchsorted(ends, begins, "right"), np.searchsorted(cuts, begins, "right")
        first = np.concatenate([[0], ends[:-1]])
        opened = np.concatenate([[0], cuts[:-1]])
        for a, b, s, q in zip(begins.tolist(), edges.tolist(), segment.tolist(), sequence.tolist()):
            doc_id, start, _, n = self.segments[s]
            piece = ids[a:b].astype("<u4")
            yield doc_id, start + a - int(first[s]), b - a, zlib.crc32(piece.tobytes()), n, self.next + q, a - int(opened[q]), piece
        self.next += len(cuts)
        self.segments, self.held = [], 0


def sentence_stops(words) -> np.ndarray:
    """True for ids whose token ends a word with a full stop, question mark or exclamation mark; also the end id's place is free anyway."""
    out = np.zeros(words.size, bool)
    for token, i in words.tokenizer.get_vocab(with_added_tokens=True).items():
        out[i] = token.removesuffix("</w>")[-1:] in ("!", "?", ".") and token.endswith("</w>")
    return out


NAMES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")


def pack(docs: DataFrame, tokenizer: str | None = None, with_ids: bool = True, files: int | None = None, keep: int = 300_000) -> DataFrame:
    """One row per piece of a document: its place in the document and in its sequence, and its token ids if asked for.

    keep: words whose ids a Python process remembers; fewer cost time, more cost memory.
    """
    lean_batches(docs.sparkSession)
    path = tokenizer or tokenizer_path()
    names = NAMES if with_ids else NAMES[:-1]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
        if with_ids:
            ends = np.concatenate([[0], np.cumsum(columns[2])]).astype(np.int32)
            arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(columns[7]).astype(np.int32))))
        return pa.record_batch(arrays, list(names))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = coder(path, keep)
        packer = Packer(sentence_stops(words), TaskContext.get().partitionId() << 40)
        for batch in source:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                rows.extend(packer.add(doc, words.encode(text.as_py())))
                if len(rows) > 4000:
                    yield table(rows)
                    rows = []
            if rows:
                yield table(rows)
        if rows := list(packer.flush()):
            yield table(rows)

    schema = ", ".join(f"{x} long" for x in NAMES[:-1]) + ", ids array<int>" * with_ids
    return in_order(docs, files).mapInArrow(run, schema)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)


QUERIES = {"op10_packing": op10_packing}
SQL: dict[str, str] = {}
