"""Scores of whole texts by a causal self-attention model trained on the corpus itself.

1. Words of all training texts are counted in the tasks, then summed by word. The most frequent, at most
   ``SHARE`` many, travel to every task.
2. One pass cuts all texts into subwords, once, and writes their windows: a learned text's row lies in the folder of its round,
   all others in one that no round reads. It also takes the common words' counts; only the other words are
   joined with their counts. Subword counts are those of the training windows, and which ids share an output class
   follows from their counts of neighbours.
3. The model trains in rounds on all training texts, whatever the size of the corpus. A hash of id and text
   gives a text's round and its lot, which deals the round's windows over tasks of about ``STEPS`` batches. Each
   task trains from the shared weights, and the weights' changes are averaged, by levels of ``FAN`` tasks.
   Lots are sorted within a task and sums have a fixed order, so how rows lie in partitions, or a task that is
   run again, changes nothing.
4. The model scores all texts from the windows that were written; no text is read or cut again.

Defined cases: a null text is empty, and an empty text is its end alone; words and end are tokens; null ids
count as the empty id in the choice of training rows; repeated rows count, train together in one task, and each keep a row; without training
rows all counts are 0 and the model is an untrained one; no rows give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention
from .common import Workspace, document_text, partitions, remainder
from .subwords import END_ID, as_coded, coder, split, tokenizer_path

SHARE, LONGEST_COMMON = 250_000, 64
#: Different words that a counting task holds before it hands them on.
HELD = 400_000
ROUNDS, STEPS, BATCH, FAN, SEED = 8, 120, 192, 32, 5
RATES = (0.02, 0.002)
#: Passes over the windows of a round at most, so that few windows are not learned by heart.
PASSES = 3
#: Windows in a row of the training table at most, so that a long text is dealt over tasks like many short ones.
ROW = 256
#: Tokens and rows of a scoring batch.
RUN = 1 << 16


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary, A-Z in lower case; empty for the end of a text), n."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def table() -> Iterator[pa.RecordBatch]:
            words, n = list(held), list(held.values())
            for k in range(0, len(words), 20_000):
                yield pa.record_batch([pa.array(words[k : k + 20_000], pa.binary()), pa.array(n[k : k + 20_000], pa.int64())], ["word", "n"])
            held.clear()

        for batch in source:
            words, places, _ = split(pc.ascii_lower(batch.column(0)))
            held.update(dict(zip(words, np.bincount(places, minlength=len(words)).tolist())))
            if len(held) >= HELD:
                yield from table()
        yield from table()

    return docs.select(document_text(docs).alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def subword_counts(windows: DataFrame, path: str, shape: attention.Shape) -> np.ndarray:
    """windows: with ids, the number of a row's ids without what fills its last window. How often each id occurs; one number per id."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(coder(path).size, np.int64)
        for batch in source:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                total += np.bincount(np.concatenate(read_ids(part.column(0), part.column(1), path, shape)), minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    rows = windows.select("windows", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(coder(path).size, np.int64)
    out[rows["id"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def least_common(counts: DataFrame, n: int) -> int:
    """The least number that at most ``SHARE`` words have or pass. n: the sum of all."""
    top = n // SHARE + 1  # that many times, or more, occur fewer than SHARE words
    tiers = counts.groupBy(F.least("n", F.lit(top)).alias("n")).count().collect()  # at most one row for each number up to it
    left, least = SHARE, top
    for r in sorted(tiers, reverse=True):
        left -= r["count"]
        if left < 0:
            break
        least = r["n"]
    return least


class Common:
    """Common words with their log10 shares; the lookup is built once per process."""

    def __init__(self, words: list[bytes], logs: np.ndarray):
        self.joined, self.logs, self.found = b"\n".join(words), logs, None

    def __getstate__(self) -> tuple:
        return self.joined, self.logs

    def __setstate__(self, state: tuple) -> None:
        (self.joined, self.logs), self.found = state, None

    def lookup(self) -> dict[bytes, float]:
        if self.found is None:  # words hold no line feed
            named = self.joined.split(b"\n") if len(self.logs) else []
            self.found = dict(zip(named, self.logs.tolist()))
        return self.found


WINDOWS = "round int, lot long, n long, windows binary, ids long"
TEXT = "row long, doc_id long, n_tokens long, known long, base double, rare array<binary>"
SCORED = TEXT.replace("rare", "score double, rare")


def names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def coded_texts(docs: DataFrame, learn: Column, common: Common, path: str, shape: attention.Shape, rounds: int = ROUNDS) -> DataFrame:
    """Windows of all texts (ids as the coder holds them) with their round and lot, and what the base score needs.

    A text has one row with a row number of its own: tokens, those among the common words, their base score, and the other
    words. Rows of texts that train in no round have round ``rounds``. That of a longer learned text is one, too; its
    parts train, in rows without a row number.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, share_of, row = coder(path), shared.value.lookup().get, TaskContext.get().partitionId() << 36
        for batch in source:
            if not batch.num_rows:
                continue
            words, places, sizes = split(as_coded(batch.column(1)))
            texts = found.encode_words(words, places, sizes)
            words = [w.lower() for w in words]
            logs = np.array([share_of(w, np.nan) for w in words])
            rare, firsts = np.isnan(logs), np.cumsum(sizes) - sizes
            rare_at = rare[places]
            base = np.add.reduceat(np.where(rare, 0, logs)[places], firsts)  # every text has an end
            met = np.add.reduceat(rare_at, firsts, dtype=np.int64)
            others = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *met]), pa.int32()), pa.array(words, pa.binary()).take(pa.array(places[rare_at])))
            number = np.arange(row, row + batch.num_rows)
            row += batch.num_rows
            text = pa.record_batch([pa.array(number), batch.column(0), pa.array(sizes), pa.array(sizes - met), pa.array(base), others], names(TEXT))
            keys, learned = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for k in range(0, batch.num_rows, 64):
                at, lots, parts, n = [], [], [], []
                for j in range(k, min(k + 64, batch.num_rows)):
                    rows, key = attention.cut(texts[j], END_ID, shape.window).astype(found.dtype), keys[j]
                    if not learned[j] or len(rows) > ROW:
                        at, lots, parts, n = [*at, j], [*lots, None], [*parts, rows], [*n, len(texts[j])]
                    for i in range(0, len(rows) if learned[j] else 0, ROW):
                        # the parts of a long text have rounds and lots of their own
                        lots.append(key if i == 0 else xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), i) - (1 << 63))
                        parts.append(rows[i : i + ROW])
                        n.append(min(len(texts[j]) - i * shape.window, ROW * shape.window))
                        at.append(j if len(rows) <= ROW else None)
                yield pa.record_batch(
                    [pa.array([rounds if x is None else x % rounds for x in lots], pa.int32()), pa.array([0 if x is None else x // rounds for x in lots], pa.int64()),
                     pa.array(list(map(len, parts)), pa.int64()), pa.array([w.tobytes() for w in parts], pa.binary()), pa.array(n, pa.int64()), *text.take(pa.array(at, pa.int64())).columns],
                    names(f"{WINDOWS}, {TEXT}"),
                )

    text = document_text(docs)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(docs["doc_id"].cast("string"), text).alias("key"), F.coalesce(learn, F.lit(False)).alias("learn"))
    return rows.mapInArrow(run, f"{WINDOWS}, {TEXT}")


def training_windows(docs: DataFrame, path: str, shape: attention.Shape, rounds: int = ROUNDS) -> DataFrame:
    """round, lot, n, windows (ids as the coder holds them) of all texts."""
    rows = coded_texts(docs, F.lit(True), Common([], np.zeros(0)), path, shape, rounds)
    return rows.where(F.col("round") < rounds).select("round", "lot", "n", "windows")


def read_windows(held: Iterable, path: str, shape: attention.Shape) -> list[np.ndarray]:
    return [np.frombuffer(w.as_py(), coder(path).dtype).reshape(-1, shape.window + 1) for w in held]


def read_ids(held: Iterable, sizes: Iterable, path: str, shape: attention.Shape) -> list[np.ndarray]:
    """The ids that windows were cut from."""
    return [w[:, 1:].ravel()[: n.as_py()] for w, n in zip(read_windows(held, path, shape), sizes)]


def followers(windows: DataFrame, counts: np.ndarray, path: str, shape: attention.Shape) -> np.ndarray:
    """How often each of the most frequent ids follows each of the ``contexts`` most frequent, in all training windows."""
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(counts), np.int32)
    rank[order] = np.arange(len(counts))
    shared = windows.sparkSession.sparkContext.broadcast(rank)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, context = np.zeros(shape.own * shape.contexts), shared.value < shape.contexts
        for batch in source:
            for k in range(0, batch.num_rows, 1024):
                found = np.concatenate(read_windows(batch.column(0)[k : k + 1024], path, shape))
                near = np.flatnonzero(context.take(found[:, :-1]))  # the others need no further look
                first, then = shared.value.take(found[:, :-1].ravel().take(near)), shared.value.take(found[:, 1:].ravel().take(near))
                own = then < shape.own
                total += np.bincount(then[own] * shape.contexts + first[own], minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen), pa.array(total[seen].astype(np.int64))], ["pair", "n"])

    rows = windows.select("windows").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(shape.own * shape.contexts)
    total[rows["pair"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)  # at most one row per entry
    return total.reshape(shape.own, shape.contexts)


def added(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each group: the sum of its rows' numbers. Rows of a group follow each other."""
    group, total = None, None
    for batch in source:
        for at, row in zip(batch.column(0).to_pylist(), batch.column(1)):
            one = np.frombuffer(row.as_py(), np.float32)
            if at != group and total is not None:
                yield pa.record_batch([pa.array([group], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["at", "change"])
            group, total = at, one if at != group else total + one
    if total is not None:
        yield pa.record_batch([pa.array([group], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["at", "change"])


def summed(changes: DataFrame, tasks: int, fan: int = FAN) -> np.ndarray | None:
    """changes: at (a number below tasks), change. The sum of all rows' numbers in the order of their places, by levels of ``fan``."""
    while tasks > fan:
        tasks = -(-tasks // fan)
        near = changes.select(F.floor(F.col("at") / fan).cast("int").alias("group"), "at", "change").repartition(tasks, "group").sortWithinPartitions("at")
        changes = near.select(F.col("group").alias("at"), "change").mapInArrow(added, "at int, change binary")
    parts = sorted((r["at"], r["change"]) for r in changes.collect())  # at most fan rows
    parts = [np.frombuffer(x, np.float32) for _, x in parts]
    return sum(parts[1:], parts[0]) if parts else None


def train(windows: DataFrame, vocabulary: attention.Vocabulary, path: str, shape: attention.Shape, rounds: int = ROUNDS) -> attention.Model:
    """windows: as of training_windows, written already."""
    spark = windows.sparkSession
    model = attention.Model.first(shape, vocabulary, SEED)
    sizes = {r["round"]: r["n"] for r in windows.groupBy("round").agg(F.sum("n").alias("n")).collect()}  # one row a round
    for r in range(rounds):
        if not sizes.get(r):
            continue
        tasks = max(1, round(sizes[r] / (STEPS * BATCH)))
        shared = spark.sparkContext.broadcast((model.flat, vocabulary))
        rate = tuple(RATES[0] + (RATES[1] - RATES[0]) * (r + k) / rounds for k in (0, 1))

        def run(source: Iterator[pa.RecordBatch], shared=shared, rate=rate, r=r) -> Iterator[pa.RecordBatch]:
            flat, words = shared.value
            held = [w for batch in source for w in read_windows(batch.column(0), path, shape)]
            if held:
                own = attention.Model(shape, words.rows, flat.copy())
                rows, at = np.concatenate(held), TaskContext.get().partitionId()
                batch = min(BATCH, -(-len(rows) // 16))
                once = -(-len(rows) // batch)
                steps = max(once, min(STEPS, PASSES * once))
                met = attention.train(own, rows, words, steps, batch, rate, SEED + 1000 * r + at)
                change, weight = own.flat - flat, np.float32(len(rows))
                own = attention.Model(shape, words.rows, change)
                own.E[:] *= met[:, None]  # an embedding counts as often as the task has met it
                change[own.E.size :] *= weight
                yield pa.record_batch([pa.array([at], pa.int32()), pa.array([np.concatenate([change, met, [weight]]).astype(np.float32).tobytes()], pa.binary())], ["at", "change"])

        dealt = windows.where(F.col("round") == r).select("windows", "lot").repartition(tasks, "lot").sortWithinPartitions("lot").select("windows")
        total = summed(dealt.mapInArrow(run, "at int, change binary"), max(tasks, partitions(spark)))
        if total is not None:
            n = model.flat.size
            mean = attention.Model(shape, vocabulary.rows, total[:n].copy())
            mean.E[:] /= np.maximum(total[n:-1], 1)[:, None]
            mean.flat[mean.E.size :] /= total[-1]
            model.flat += mean.flat
        shared.unpersist()
    return model


def score_texts(coded: DataFrame, model: attention.Model, vocabulary: attention.Vocabulary, path: str) -> DataFrame:
    """coded: rows of coded_texts. Per text what is known of it and the model's score."""
    shared = coded.sparkSession.sparkContext.broadcast((model.shape, model.flat, vocabulary))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, flat, words = shared.value
        scorer = attention.Scorer(attention.Model(shape, words.rows, flat), words, END_ID)
        for batch in source:
            if not batch.num_rows:
                continue
            texts = read_ids(batch.column(0), batch.column(1), path, shape)
            scores = [scorer([ids for _, ids in part]) for part in attention.batches_of(enumerate(texts), RUN)]
            told = batch.columns[2:]
            yield pa.record_batch([*told[:-1], pa.array(np.concatenate(scores)), told[-1]], names(SCORED))

    return coded.where(F.col("row").isNotNull()).select("windows", "ids", *names(TEXT)).mapInArrow(run, SCORED)


def score(docs: DataFrame, learn: Column, tokenizer: str | None = None, shape: attention.Shape | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each row. learn: the rows to learn from."""
    path, shape = tokenizer or tokenizer_path(), shape or attention.Shape()
    spark = docs.sparkSession
    work = Workspace(spark, "lm")
    counts = work.save(word_counts(docs.where(learn)), "words")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = least_common(counts, n)
    often = (F.col("n") >= least) & (F.octet_length("word") <= LONGEST_COMMON)
    per = n + 0.5 * (v + 1)
    # at most SHARE rows
    frame = counts.where(often).toPandas()
    common = Common([bytes(w) for w in frame["word"]], np.log10((frame["n"].to_numpy(np.float64) + 0.5) / per))
    coded = work.save(coded_texts(docs, learn, common, path, shape), "windows", by="round")
    windows = coded.where(F.col("round") < ROUNDS).select("round", "lot", "n", "windows", "ids")
    ids = subword_counts(windows, path, shape)
    vocabulary = attention.Vocabulary(ids, shape, followers(windows, ids, path, shape))
    model = train(windows, vocabulary, path, shape)
    scored = work.save(score_texts(coded, model, vocabulary, path), "scored")
    work.drop("windows")
    rare = scored.select("row", F.explode("rare").alias("word"))
    rare = rare.join(counts.where(~often), "word", "left")
    logs = F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(float(per)))
    rest = rare.groupBy("row").agg(F.sum(logs).alias("more"), F.count("n").alias("met"))
    out = scored.drop("rare").join(rest, "row", "left")
    return out.select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("met", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
    )


def learned_from(doc_id: Column) -> Column:
    return remainder(doc_id, 5) != 1


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = score(docs, learned_from(docs["doc_id"]))
    return rows.select("doc_id", (~learned_from(F.col("doc_id"))).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op9_lm_scoring": op9_lm_scoring}
SQL: dict[str, str] = {}
