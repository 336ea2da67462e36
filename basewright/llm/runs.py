"""Periodic runs of words, by Lyndon arrays of both orders of the words with reuse of matched extensions.

A run's words are a power of a Lyndon word under one of the two orders (ascending, descending), and that word is the
longest Lyndon word at the places where it begins: it ends before the next smaller suffix. So ``lyndon_edges`` finds,
from left to right, every place's next smaller suffix and how far the two suffixes agree. Words are only ever compared;
they are never numbered or hashed, and no suffix array or tree is built.

The stack holds places whose next smaller suffix is not known yet, each the nearest smaller suffix of the next. A place
meets them from the top. What agreed with the element on top decides, by the smaller of two agreements, most of the
further comparisons; words are looked at only behind what has been matched already. Where a place lies within the
match that reaches furthest right, between places L and R, its comparisons repeat those of the place R - L before it,
as far as the match goes, and are looked up. So a word is matched once beyond the furthest reach, and an order costs
steps in proportion to the number of words (tested on powers, Fibonacci, Thue-Morse and random words).

A run is taken at its first root: there the match to the left is shorter than the period. That match is found by
comparing slices of doubling size, only for roots whose match to the right is already longer than the period.

Defined cases: null or blank texts have no words and no runs; a null id counts as the empty text in the checksum;
repeated rows each keep a row; no rows give an empty result; other columns are ignored. A document is one row and so
one step of one task, at about 200 bytes a word.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean_batches

#: A run has at least so many words, and at least so many periods.
LEAST, PERIODS = 24, 3
RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def lyndon_edges(w: list, descending: bool = False) -> tuple[list[int], list[int], int]:
    """Next smaller suffix of each place (len(w) if there is none), how many words it and the place have in common, and how often words were compared.

    A suffix that is the beginning of another one is the smaller one in either order.
    """
    n, looked = len(w), 0
    following, common = [n] * n, [0] * n  # next smaller suffix and the agreement with it
    before, shared = [-1] * n, [0] * n  # previous smaller suffix and the agreement with it
    reach, left, right = 0, 0, 0  # words from left and from right agree up to reach
    for i in range(1, n):
        j, m, met = i - 1, 0, False
        copied = i < reach
        back = right - left
        while j >= 0:
            if copied:
                # the same comparison was made `back` places before
                a, b = j - back, i - back
                if following[a] == b:
                    m, smaller = common[a], True
                else:
                    m, smaller = shared[b], False
                if i + m >= reach:  # only as far as the match goes
                    m, copied = reach - i, False
            elif met and (q := shared[top]) != m:
                # top and j agree in q words, top and i in m
                if q < m:
                    m, smaller = q, False
                else:
                    smaller = True
                met = False
                if smaller:
                    following[j], common[j] = i, m
                    top, j, met = j, before[j], True
                    continue
                break
            if not copied:
                k = i + m
                a = j + m
                while k < n and w[a] == w[k]:
                    a += 1
                    k += 1
                looked += k - i - m + 1
                m = k - i
                if k >= reach:
                    reach, left, right = k, j, i
                smaller = k == n or (w[a] < w[k] if descending else w[k] < w[a])
            if not smaller:
                break
            following[j], common[j] = i, m
            top, j, met = j, before[j], True
        else:
            m = 0
        before[i], shared[i] = j, m
    return following, common, looked


def runs_of(words: list, least: int = LEAST, periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period. Words: anything that can be ordered."""
    if len(words) < least:
        return []
    found = set()
    for descending in (False, True):
        following, common, _ = lyndon_edges(words, descending)
        for i, m in enumerate(common):
            if not m:
                continue
            j = following[i]
            p = j - i
            # a first root's match to the left is shorter than p
            if m <= (periods - 2) * p or (i >= p and following[i - p] == i and common[i - p] >= p):
                continue
            start = i - agreed_before(words, i, j)
            length = j + m - start
            if length >= max(least, periods * p):
                found.add((start, length, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def agreed_before(words: list, i: int, j: int) -> int:
    """How many words before i and before j agree, from the nearest on."""
    done, size = 0, 1
    while done < i and words[max(0, i - done - size) : i - done] == words[j - done - min(size, i - done) : j - done]:
        done += min(size, i - done)
        size *= 2
    while size > 1:
        size //= 2
        if done + size <= i and words[i - done - size : i - done] == words[j - done - size : j - done]:
            done += size
    return done


def periodic(words: list, doc_id: int | None) -> list:
    """The words, of which a part repeats for every id whose checksum is divisible by ten."""
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[: n - a]


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run holds after its first period."""
    out, at, ends = [], 0, sorted((s + p, s + n) for s, n, p in runs)
    for a, b in ends:
        if b > at:
            out += words[at : max(a, at)]
            at = b
    return out + words[at:]


def described(doc_id: int | None, text: bytes) -> tuple:
    """A row of the result. bytes.split() parts exactly at the blanks that the contract names."""
    words = periodic(text.split(), doc_id)
    runs = runs_of(words)
    # exact comparison of length / period
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    row = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(runs), *row, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept_words(words, runs))).hexdigest()


def word_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: number of runs, its run of most periods, checksums of all runs and of the words that collapsing them leaves."""
    lean_batches(docs.sparkSession)
    names = [x.split()[0] for x in RESULT.split(", ")]
    kinds = [pa.string() if x.endswith("string") else pa.int64() for x in RESULT.split(", ")]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rows = [described(i, text.as_py() or b"") for i, text in zip(batch.column(0).to_pylist(), batch.column(1))]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return docs.select(docs[id_column].cast("long"), docs[text_column].cast("binary")).mapInArrow(run, RESULT)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op11_runs": op11_runs}
#: Lyndon arrays have no SQL form, and trying all periods in SQL is quadratic in a text; tests try all of them on small texts.
SQL: dict[str, str] = {}
