"""Language identification with string kernels.

The blended-spectrum presence kernel of two texts is the number of different character n-grams, n from 1 to
``LONGEST``, that both hold, divided by the root of the product of their own numbers. Texts are lower-cased, runs
of anything but letters become one blank, and a blank stands at both ends. ``LANDMARKS`` training texts
span the Nyström space: features are kernel values with the landmarks times the inverse root of the landmarks'
own kernel matrix. One-versus-rest kernel ridge regression is solved in that space. Scoring is two matrix
products a batch: n-gram presence by landmarks, and kernel values by languages.

The fit uses a bounded sample of labelled rows: at most ``SAMPLE`` texts, dealt evenly over the languages in the
order of a hash, and of these ``LANDMARKS`` of moderate length. Every document is scored by its whole text.

Defined cases: a null text and one without a letter are ``und`` with score 0, and so is everything if no row can
be learned from; null languages are not learned; equal scores go to the language that sorts first; repeated rows
each keep a row; no rows give an empty result; other columns are ignored.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, remainder

LONGEST, LANDMARKS, SAMPLE, RIDGE = 3, 160, 8000, 1e-3
#: Characters of texts that serve as landmarks, as far as there are enough.
LANDMARK_SIZES = (200, 2000)
UNKNOWN = "und"
#: A stage that filters rejects scores below so many times those of chance, one over the languages (of four at least). Of 10,000 texts
#: at sf0.1, all with a letter, the least score was 0.354, of 3,409 labelled good 0.362: none is rejected.
OVER_CHANCE = 1.2
#: Cells of the presence matrix of one batch.
CELLS = 1 << 22
BLANK = 32
_table: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """Code point to lower-case letter, anything else to a blank."""
    global _table
    if _table is None:
        table = np.full(sys.maxunicode + 1, BLANK, np.int64)
        for c in range(sys.maxunicode + 1):
            if unicodedata.category(chr(c))[0] == "L":
                low = chr(c).lower()
                table[c] = ord(low) if len(low) == 1 else c
        _table = table
    return _table


def grams(text: str | None, longest: int = LONGEST) -> np.ndarray:
    """The different n-grams of a text as rising numbers (21 bits a character); none for texts without a letter."""
    found = letter_table()[np.frombuffer(f" {text or ''} ".encode("utf-32-le", "replace"), "<u4")]
    keep = found != BLANK
    if not keep.any():
        return np.empty(0, np.int64)
    keep[1:] |= found[:-1] != BLANK  # the first blank of each run
    keep[0] = True
    found = found[keep]
    parts, now = [found], found
    for _ in range(1, longest):
        now = now[:-1] << 21 | found[len(found) - len(now) + 1 :]
        parts.append(now)
    return np.unique(np.concatenate(parts))


@dataclass
class Classifier:
    """languages; the landmarks' n-grams in rising order; which landmark holds which, over its root; weights by language."""

    languages: list[str]
    known: np.ndarray
    held: np.ndarray
    weights: np.ndarray

    def kernel(self, texts: list[np.ndarray]) -> np.ndarray:
        """Kernel values of texts, given by their n-grams, with the landmarks."""
        out = np.empty((len(texts), self.held.shape[1]), np.float32)
        rows = max(1, CELLS // max(1, len(self.known)))
        for k in range(0, len(texts), rows):
            some = texts[k : k + rows]
            sizes = np.array([len(g) for g in some])
            found = np.concatenate(some) if len(some) else np.empty(0, np.int64)
            place = np.minimum(np.searchsorted(self.known, found), len(self.known) - 1)
            hit = self.known[place] == found
            present = np.zeros((len(some), len(self.known)), np.float32)
            present[np.repeat(np.arange(len(some)), sizes)[hit], place[hit]] = 1
            out[k : k + rows] = present @ self.held / np.sqrt(np.maximum(sizes, 1))[:, None]
        return out

    def predict(self, texts: list[np.ndarray]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text. The score is the language's share of the positive outputs."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        value = self.kernel(texts) @ self.weights
        best = value.argmax(1)
        up = np.maximum(value, 0)
        total = up.sum(1)
        score = np.where(total > 0, up[np.arange(len(texts)), best] / np.where(total > 0, total, 1), 0.0)
        none = np.array([not len(g) for g in texts], bool)
        return [UNKNOWN if x else self.languages[b] for x, b in zip(none, best)], np.where(none, 0.0, np.clip(score, 0, 1))


def landmarks_of(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    known = np.unique(np.concatenate(texts))
    held = np.zeros((len(known), len(texts)), np.float32)
    for j, g in enumerate(texts):
        held[np.searchsorted(known, g), j] = 1 / np.sqrt(len(g))
    return known, held


def root_inverse(matrix: np.ndarray) -> np.ndarray:
    value, vector = np.linalg.eigh(matrix.astype(np.float64))
    good = value > 1e-6 * value[-1]
    return vector[:, good] / np.sqrt(value[good])


def ridge(kernel: np.ndarray, own: np.ndarray, labels: np.ndarray, languages: int, strength: float) -> np.ndarray:
    """Weights on kernel values: one-versus-rest ridge regression on the Nyström features, each language with equal weight in all."""
    root = root_inverse(own)
    features = kernel.astype(np.float64) @ root
    share = 1 / np.maximum(np.bincount(labels, minlength=languages), 1)[labels]
    wanted = (labels[:, None] == np.arange(languages)).astype(np.float64)
    weighted = features * share[:, None]
    solved = np.linalg.solve(weighted.T @ features + strength * np.eye(root.shape[1]), weighted.T @ wanted)
    return (root @ solved).astype(np.float32)


def sample(rows: DataFrame, most: int, seed: int = 11) -> DataFrame:
    """rows: doc_id, text, lang. At most so many, dealt evenly over the languages, by a hash of id and text.

    A share of each language is taken before its rows are ranked, so that no task ranks a whole language.
    """
    lot = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 30))
    sizes = [(r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()]
    if not sizes:
        return rows.limit(0)
    each = max(1, most // len(sizes))
    limits = [(lang, each, min(1 << 30, int((each + 4 * each**0.5 + 10) / n * (1 << 30)) + 1)) for lang, n in sizes]
    few = len(limits) <= 10_000
    limits = rows.sparkSession.createDataFrame(limits, "lang string, each long, below long")
    some = rows.withColumn("lot", lot).join(F.broadcast(limits) if few else limits, "lang").where(F.col("lot") < F.col("below"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("lot", "doc_id", "text"))
    return some.withColumn("place", place).where(F.col("place") <= F.col("each")).drop("lot", "below", "each")


def fit(docs: DataFrame, learn: Column, landmarks: int = LANDMARKS, most: int = SAMPLE, strength: float = RIDGE) -> Classifier:
    """docs: doc_id, text, lang. learn: rows to learn from."""
    work = Workspace(docs.sparkSession, "language")
    rows = docs.select("doc_id", "text", docs["lang"].cast("string").alias("lang"), learn.alias("learn"))
    rows = rows.where(F.col("learn") & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).drop("learn")
    rows = work.save(sample(rows, most), "sample")
    languages = sorted(r[0] for r in rows.select("lang").distinct().collect())
    if not languages:
        return Classifier([], np.empty(0, np.int64), np.empty((0, 0), np.float32), np.empty((0, 0), np.float32))
    each = max(1, landmarks // len(languages))
    size = F.char_length("text")
    odd = F.when(size.between(*LANDMARK_SIZES), 0).otherwise(size)  # the shortest of these, where there are too few others
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(odd, "place"))
    first = rows.withColumn("rank", rank).where(F.col("rank") <= each).orderBy("lang", "rank").select("text")
    known, held = landmarks_of([grams(r["text"]) for r in first.collect()])
    model = Classifier(languages, known, held, np.zeros((held.shape[1], len(languages)), np.float32))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in source:
            values = shared.value.kernel([grams(t) for t in part["text"]])
            yield pd.DataFrame({"lang": part["lang"], "kernel": list(values)})

    seen = rows.select("lang", "text").mapInPandas(run, "lang string, kernel array<float>").toPandas()
    labels = np.searchsorted(languages, seen["lang"].to_numpy(str))
    own = (held.T @ held).astype(np.float64)
    model.weights = ridge(np.stack(seen["kernel"].to_list()), own, labels, len(languages), strength)
    return model


def predict(docs: DataFrame, model: Classifier, *keep: str, text: str = "text") -> DataFrame:
    """The columns to keep, in order, then lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            found: tuple[list, list] = ([], [])
            texts = batch.column(batch.num_columns - 1)
            for k in range(0, batch.num_rows, 256):
                languages, scores = shared.value.predict([grams(t.as_py()) for t in texts[k : k + 256]])
                found[0].extend(languages)
                found[1].extend(scores.tolist())
            columns = [*batch.columns[:-1], pa.array(found[0], pa.string()), pa.array(found[1], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "lang_pred", "score"])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "lang_pred string, score double"])
    last = "_".join(["text", *keep])  # no column to keep has this name
    return docs.select(*[docs[f"`{c}`"] for c in keep], docs[text].alias(last)).mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Classifier, over: float = OVER_CHANCE) -> DataFrame:
    """Rows of docs whose language is known, with a score of at least so many times that of chance, and with a null lang filled in. Where nothing was learned, all texts with a letter."""
    names = [f"c{k}" for k in range(len(docs.columns))]  # free of clashes with the two columns added
    text, lang = names[docs.columns.index("text")], names[docs.columns.index("lang")]
    held = docs.toDF(*names)
    if not model.languages:
        return held.where(F.col(text).rlike(r"\p{L}")).toDF(*docs.columns)
    found = predict(held, model, *names, text=text).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= over / max(4, len(model.languages))))
    return found.withColumn(lang, F.coalesce(lang, "lang_pred")).select(*names).toDF(*docs.columns)


def learned_from(doc_id: Column) -> Column:
    return remainder(doc_id, 3) != 1


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, learned_from(docs["doc_id"]))
    return predict(docs, model, "doc_id").select("doc_id", (~learned_from(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")


QUERIES = {"op3_language": op3_language}
SQL: dict[str, str] = {}
