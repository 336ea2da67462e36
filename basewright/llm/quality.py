"""Quality rules with robust multivariate outliers, in DataFrame operations only.

Each document gets counts from its whole text, and from these four transformed statistics: log of the mean word
length, log of 1 + 10 * symbols a word, the share of duplicate lines and the share of words in repeated windows,
as whole thousandths so that sums are exact. The minimum-covariance-determinant estimate of each language and
source is found by concentration steps: distances from the current centre and covariance, the ``SUPPORT`` share
of documents with the smallest, their mean and covariance, until no determinant falls. The steps begin at three
fixed estimates (median without spread, median and interquartile ranges, mean and covariance), and of these the
one that ends at the least determinant is taken. ``FLOORS`` (a least spread of each statistic) are added to the
covariance, as most texts have no symbol and no repeated line at all.

The same is done for each language, and for all documents. A group of n documents then keeps n parts of its own
estimate and takes ``PRIOR`` parts of its language's, which in the same way takes from that of all: small groups
are judged by what is like them, and no size switches to another rule. Documents whose squared Mahalanobis
distance is above ``CUTOFF`` are rejected. Estimates use documents that pass the base rules; all groups' sums
come from one aggregation with partial sums in each task, so a hot group is no hot task.

Defined cases: a null text has no words; null languages or sources are groups of their own; repeated rows count
and each keep a row; texts without words fail the base rules; where no document passes the base rules there is no
estimate and the base rules decide alone; no rows give an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, Workspace, document_text

SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50
UNIT = 1000
#: Least standard deviations, in the statistics' units.
FLOORS = (0.06, 0.1, 0.1, 0.1)
#: The chi-square quantile of 4 degrees of freedom that one in a thousand exceeds, and its median.
CUTOFF, MEDIAN = 18.467, 3.3567
SUPPORT, PRIOR, STEPS = 0.75, 20, 12
P = len(FLOORS)
X = [f"x{i}" for i in range(P)]
#: Entries of a covariance, of its lower half.
HALF = [(i, j) for i in range(P) for j in range(i + 1)]
#: Groups of each level, from the smallest; the columns that tell them apart.
LEVELS = {"pair": ["lang", "source"], "lang": ["lang"], "all": []}
BLANKS = " \t\n\x0b\f\r"


def counts(docs: DataFrame, *keep: str) -> DataFrame:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of whole texts, besides the columns to keep."""
    text = document_text(docs)
    rows = docs.select(*keep, text.alias("text_"), F.btrim(text, F.lit(BLANKS)).alias("trimmed_"))
    words = F.when(F.col("trimmed_") == "", F.array().cast("array<string>")).otherwise(F.split("trimmed_", SPACE + "+"))
    lines = F.filter(F.split("text_", "\n", -1), lambda s: F.btrim(s, F.lit(BLANKS)) != "")
    rows = rows.withColumn("words_", words).withColumn("lines_", lines)
    n = F.greatest(F.size("words_") - 2, F.lit(0))
    word = lambda i, k: F.get("words_", i + k)
    # the upper bits of a window's hash, and its place: equal windows stand side by side when these are sorted
    key = lambda w, i: F.shiftleft(F.xxhash64(w, word(i, 1), word(i, 2)), 31).bitwiseOR(i.cast("long"))
    rows = rows.select(
        *keep, F.size("words_").cast("long").alias("n_words"),
        F.char_length(F.translate("text_", BLANKS, "")).cast("long").alias("word_chars"),
        (F.char_length("text_") - F.char_length(F.translate("text_", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines_").cast("long").alias("n_lines"),
        (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long").alias("n_dup_lines"),
        "words_", F.sort_array(F.transform(F.slice("words_", 1, n), key)).alias("keys_"),
    )

    def twice(sorted_: str, of) -> Column:
        same = lambda x, i: of(F.get(sorted_, i)) == of(x)
        return F.filter(sorted_, lambda x, i: F.coalesce(F.when(i > 0, same(x, i - 1)), F.lit(False)) | F.coalesce(same(x, i + 1), F.lit(False)))

    # only windows whose hash is found twice are compared as text
    rows = rows.withColumn("near_", twice("keys_", lambda x: F.shiftright(x, 31)))
    place = lambda x: x.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
    named = F.transform("near_", lambda x: F.struct(F.concat_ws(" ", *[word(place(x), k) for k in range(3)]).alias("w"), place(x).alias("at")))
    rows = rows.withColumn("sorted_", F.sort_array(named)).drop("keys_", "words_")
    rows = rows.withColumn("at_", F.sort_array(F.transform(twice("sorted_", lambda x: x["w"]), lambda x: x["at"])))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate("at_", zero, lambda s, p: F.struct((p + 3).alias("end"), (s["n"] + 3 - F.greatest(s["end"] - p, F.lit(0))).alias("n")), lambda s: s["n"])
    return rows.withColumn("n_repeat_words", covered.cast("long")).drop("near_", "sorted_", "at_")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def statistics() -> list[Column]:
    """The transformed statistics in whole thousandths; null for texts without words."""
    n = F.nullif(F.col("n_words"), F.lit(0))
    found = [
        F.log(F.col("word_chars") / n),
        F.log1p(10 * F.col("n_symbols") / n),
        F.col("n_dup_lines") / F.nullif(F.col("n_lines"), F.lit(0)),
        F.col("n_repeat_words") / n,
    ]
    return [F.round(x * UNIT).cast("long").alias(f"x{k}") for k, x in enumerate(found)]


def distance() -> Column:
    """Squared Mahalanobis distance by forward substitution, from the columns m (centre) and l (Cholesky factor)."""
    done: list[str] = []
    for i, x in enumerate(X):
        rest = " - ".join([f"{x} - m{i}", *[f"l{i}{j} * {y}" for j, y in enumerate(done)]])
        done.append(f"(({rest}) / l{i}{i})")
    return F.expr(" + ".join(f"{y} * {y}" for y in done))


def cholesky(params: DataFrame) -> DataFrame:
    """Adds the factor l of the covariance c with the floors on its diagonal, and its log determinant."""
    steps = []  # later columns refer to earlier ones
    for i, j in HALF:
        value = " - ".join([f"c{i}{j} + {(FLOORS[i] * UNIT) ** 2 if i == j else 0.0}D", *[f"l{i}{k} * l{j}{k}" for k in range(j)]])
        steps.append(f"sqrt({value}) AS l{i}{j}" if i == j else f"({value}) / l{j}{j} AS l{i}{j}")
    return params.selectExpr("*", *steps, " + ".join(f"ln(l{i}{i})" for i in range(P)) + " AS log_det")


def hinted(params: DataFrame, few: bool) -> DataFrame:
    """A table of one row a group, to be broadcast only where it has been counted and is small."""
    return F.broadcast(params) if few else params


def is_small(params: DataFrame, most: int = 5_000) -> bool:
    return params.count() <= most


def moments(keep: str = "true") -> list[Column]:
    """Count, sums and sums of products of the statistics, of the rows to keep."""
    sums = [f"sum({x}) FILTER (WHERE {keep}) AS s{i}" for i, x in enumerate(X)] + [f"sum({X[i]} * {X[j]}) FILTER (WHERE {keep}) AS q{i}{j}" for i, j in HALF]
    return [F.expr(x) for x in (f"count(*) FILTER (WHERE {keep}) AS n", *sums)]


def mean_and_covariance() -> list[Column]:
    return [F.expr(x) for x in (*[f"s{i} / n AS m{i}" for i in range(P)], *[f"q{i}{j} / n - s{i} / n * (s{j} / n) AS c{i}{j}" for i, j in HALF])]


def starts(rows: DataFrame) -> DataFrame:
    """group, start, n, centre and covariance: the three estimates that the steps begin at."""
    parts = F.array(*[F.lit(q) for q in (0.25, 0.5, 0.75)])
    found = rows.groupBy("group").agg(*moments(), *[F.percentile_approx(x, parts, 10_000).alias(f"p{i}") for i, x in enumerate(X)])
    centre = [F.col(f"p{i}")[1].cast("double").alias(f"m{i}") for i in range(P)]
    wide = lambda i: ((F.col(f"p{i}")[2] - F.col(f"p{i}")[0]) / 1.349) ** 2
    nothing = [F.lit(0.0).alias(f"c{i}{j}") for i, j in HALF]
    ranges = [(wide(i) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in HALF]
    each = [found.select("group", F.lit(k).alias("start"), "n", *columns) for k, columns in enumerate(([*centre, *nothing], [*centre, *ranges], mean_and_covariance()))]
    return each[0].unionByName(each[1]).unionByName(each[2])


def estimate(rows: DataFrame, work: Workspace, support: float = SUPPORT, steps: int = STEPS) -> DataFrame:
    """rows: group, x0 to x3. group, n, centre and covariance of each group at the least determinant that the steps reach."""
    by = ("group", "start")
    params = work.save(cholesky(starts(rows)), "estimate-0")
    size = params.where("start = 0").select("group", F.col("n").alias("size"))
    few = is_small(params)
    rows = rows.withColumn("start", F.explode(F.array(*[F.lit(k) for k in range(3)])))
    for step in range(1, steps + 1):
        far = rows.join(hinted(params.drop("n"), few), list(by)).select(*by, *X, distance().alias("d"))
        limit = far.groupBy(*by).agg(F.percentile_approx("d", support, 10_000).alias("limit"))
        new = far.join(hinted(limit, few), list(by)).groupBy(*by).agg(*moments("d <= limit"))
        new = work.save(cholesky(new.select(*by, "n", *mean_and_covariance())), f"estimate-{step}")
        moved = new.join(params.select(*by, F.col("log_det").alias("old")), list(by)).agg(F.max(F.abs(F.col("log_det") - F.col("old")))).first()[0]
        params = new
        if moved is None or moved < 1e-9:
            break
    values = [f"m{i}" for i in range(P)] + [f"c{i}{j}" for i, j in HALF]
    best = params.groupBy("group").agg(F.min_by(F.struct(*values), F.struct("log_det", "start")).alias("best"))
    return best.join(size, "group").select("group", F.col("size").alias("n"), "best.*")


def group_name(level: str) -> Column:
    """A group's name; nulls are told from all texts."""
    parts = [F.coalesce(F.concat(F.lit("="), c), F.lit("null")) for c in LEVELS[level]]
    return F.concat_ws("\x1f", F.lit(level), *parts)


def shrunk(groups: DataFrame, params: DataFrame, few: bool, prior: float = PRIOR) -> DataFrame:
    """Each language and source with its estimate, ``prior`` parts of which come from its language, and those from all.

    groups: lang, source of every pair. params: group, n, spread, centre and covariance of all levels.
    """
    values = [f"m{i}" for i in range(P)] + [f"c{i}{j}" for i, j in HALF] + ["spread"]
    out, done = groups, None
    for level in reversed(LEVELS):
        own = params.select(F.col("group").alias("group_"), F.col("n").alias("n_"), *[F.col(v).alias(f"{v}_") for v in values])
        out = out.withColumn("group", group_name(level)).join(hinted(own, few), F.col("group") == F.col("group_"), "left")
        part = F.col("n_") / (F.col("n_") + prior)
        mixed = [F.coalesce(F.col(f"{v}_") if done is None else F.col(f"{v}_") * part + F.col(v) * (1 - part), *([] if done is None else [F.col(v)])).alias(v) for v in values]
        out, done = out.select("lang", "source", *mixed), True
    return cholesky(out)


def assess(docs: DataFrame, cutoff: float = CUTOFF, prior: float = PRIOR) -> DataFrame:
    """doc_id, the counts, base_failed, distance (squared, null without an estimate) and kept of each row."""
    work = Workspace(docs.sparkSession, "quality")
    rows = counts(docs, "doc_id", "lang", "source").withColumn("base_failed", base_failed())
    rows = work.save(rows.select("*", *statistics()), "counts")
    groups = work.save(rows.select("lang", "source").distinct(), "groups")
    names = F.explode(F.array(*[group_name(level) for level in LEVELS])).alias("group")
    fit = work.save(rows.where(~F.col("base_failed")).select(names, *X), "fit")
    params = work.save(estimate(fit, work), "estimate")
    few = is_small(params) and is_small(groups)
    spread = fit.join(hinted(cholesky(params), few), "group").groupBy("group").agg(F.greatest(F.lit(1.0), F.percentile_approx(distance(), 0.5, 10_000) / MEDIAN).alias("spread"))
    params = work.save(params.join(spread, "group"), "spread")
    params = work.save(shrunk(groups, params, few, prior).withColumnsRenamed({"lang": "lang_", "source": "source_"}), "shrunk")
    same = F.col("lang").eqNullSafe(F.col("lang_")) & F.col("source").eqNullSafe(F.col("source_"))
    out = rows.join(hinted(params, few), same).withColumn("distance", distance() / F.col("spread"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", kept.alias("kept"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("distance")


QUERIES = {"op8_quality": op8_quality}
SQL: dict[str, str] = {}
