"""The round-trip report for records of any length: sequences are compared by trees of digests, and no sequence is ever one value.

Records come as chunks (see ``chunks``), cut in any way on either side. A cell is `size` symbols from a multiple of `size`;
its digest is made where the chunk is if it lies inside one, so only the pieces of cells that chunks share are brought
together. `fan` digests make the one above them. A record is compared by its top digest; where two differ, the
first unequal node is followed down level by level, a few small rows a record each time, and at the end the symbols of one cell
are fetched from both sides.

Defined cases: the results are those of ``integrity`` on whole sequences, whatever the chunks are; empty records have no cells;
symbols are bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import integrity
from .chunks import saved

SIZE, FAN = 1 << 16, 64
KEY = ("file", "rec_no")


def letters(data: Column) -> Column:
    return F.decode(data, "ISO-8859-1")


def joined(start: str, data: str) -> Column:
    """Bytes of a group's pieces in order of their places."""
    pieces = F.array_sort(F.collect_list(F.struct(F.col(start).alias("start"), F.hex(data).alias("digits"))))
    return F.unhex(F.array_join(F.transform(pieces, lambda p: p["digits"]), ""))


def cells(chunks: DataFrame, size: int = SIZE) -> DataFrame:
    """file, rec_no, node (the cell's number), sha, plain (the digest with T for U), T, U (how many there are)."""
    end = F.col("start") + F.col("n")
    numbers = F.when(F.col("n") > 0, F.sequence(F.floor(F.col("start") / size), F.floor((end - 1) / size))).otherwise(F.array().cast("array<bigint>"))

    def piece(cell: Column) -> Column:
        begin, stop = F.greatest(cell * size, F.col("start")), F.least((cell + 1) * size, end)
        part = F.substring("data", (begin - F.col("start") + 1).cast("int"), (stop - begin).cast("int"))
        return F.struct(cell.alias("node"), begin.alias("begin"), (stop - begin == size).alias("whole"), part.alias("part"))

    rows = chunks.select(*KEY, F.explode(F.transform(numbers, piece)).alias("p")).select(*KEY, "p.*")
    rows = rows.where("whole").select(*KEY, "node", "part").union(rows.where("not whole").groupBy(*KEY, "node").agg(joined("begin", "part").alias("part")))
    text = letters(F.col("part"))
    many = [(F.length(text) - F.length(F.translate(text, x, ""))).cast("long").alias(x) for x in "TU"]
    return rows.select(*KEY, "node", F.sha2("part", 256).alias("sha"), F.sha2(F.translate(text, "U", "T"), 256).alias("plain"), *many)


class Tree:
    """The digests of all records of chunks: ``levels`` from the cells up to one node a record, and ``records``: file, rec_no, description, n, sha, plain, T, U."""

    def __init__(self, chunks: DataFrame, size: int = SIZE, fan: int = FAN, height: int = 0):
        self.chunks, self.size, self.fan = chunks, size, fan
        whole = saved(cells(chunks, size), "cell-digests")
        self.counts = whole.groupBy(*KEY).agg(F.sum("T").alias("T"), F.sum("U").alias("U"))
        self.levels = [whole.select(*KEY, "node", "sha", "plain")]
        self.top = whole.agg(F.max("node")).first()[0] or 0
        while self.top or len(self.levels) <= height:
            self.rise()
        self.finish()

    def rise(self) -> None:
        own = F.array_sort(F.collect_list(F.struct("node", "sha", "plain")))  # at most fan
        rows = self.levels[-1].groupBy(*KEY, F.floor(F.col("node") / self.fan).alias("above")).agg(own.alias("own"))
        above = [F.sha2(F.array_join(f"own.{c}", ""), 256).alias(c) for c in ("sha", "plain")]
        self.levels.append(saved(rows.select(*KEY, F.col("above").alias("node"), *above), "digests"))
        self.top //= self.fan

    def finish(self) -> None:
        own = self.chunks.groupBy(*KEY).agg(F.max("description").alias("description"), F.sum("n").alias("n"))
        rows = own.join(self.levels[-1].select(*KEY, "sha", "plain"), list(KEY), "left").join(self.counts, list(KEY), "left")
        filled = [F.coalesce(c, F.lit("")).alias(c) for c in ("sha", "plain")] + [F.coalesce(c, F.lit(0)).alias(c) for c in "TU"]
        self.records = saved(rows.select(*KEY, "description", "n", *filled), "record-digests")

    def facts(self) -> DataFrame:
        """As of ``integrity.facts``; the hash is the top digest."""
        return self.records.select("description", F.struct(*KEY).alias("place"), "sha", F.col("n").alias("size"))

    def window(self, wanted: DataFrame, place: str) -> DataFrame:
        """wanted: place (of the pair), the record's place under a name, cell. The symbols of the cell and the context around it: place, begin, symbols."""
        low = F.greatest(F.col("cell") * self.size - integrity.CONTEXT, F.lit(0))
        keys = wanted.select("place", F.col(f"{place}.file").alias("file"), F.col(f"{place}.rec_no").alias("rec_no"), low.alias("low"), ((F.col("cell") + 1) * self.size + integrity.CONTEXT).alias("high"))
        rows = self.chunks.select(*KEY, "start", "n", "data").join(keys, list(KEY)).where((F.col("start") < F.col("high")) & (F.col("start") + F.col("n") > F.col("low")))
        begin = F.greatest("start", "low")
        part = F.substring("data", (begin - F.col("start") + 1).cast("int"), (F.least(F.col("start") + F.col("n"), F.col("high")) - begin).cast("int"))
        rows = rows.select("place", "low", begin.alias("begin"), part.alias("part")).groupBy("place").agg(joined("begin", "part").alias("part"))
        return rows.select("place", letters(F.col("part")).alias("symbols"))


class ChunkReport(integrity.Report):
    """The report of ``integrity`` for chunks of original and decoded records."""

    def __init__(self, original: DataFrame, decoded: DataFrame, size: int = SIZE, fan: int = FAN):
        self.a, self.b = Tree(original, size, fan), Tree(decoded, size, fan)
        for low, high in ((self.a, self.b), (self.b, self.a)):  # digests are compared at equal heights
            while len(low.levels) < len(high.levels):
                low.rise()
                low.finish()
        self.original, self.decoded = self.a.facts(), self.b.facts()

    def first_cells(self, pairs: DataFrame) -> DataFrame:
        """pairs: place, original_place. place, original_place, cell: the first that differs, null if there is none."""
        now = pairs.withColumn("node", F.lit(0).cast("long"))
        fan = self.a.fan
        for level in reversed(range(len(self.a.levels))):
            step = fan if level < len(self.a.levels) - 1 else 1
            below = None
            for tree, place in ((self.a, "original_place"), (self.b, "place")):
                nodes = tree.levels[level].select(F.struct(*KEY).alias(place), F.floor(F.col("node") / step).alias("above"), F.col("node").alias("below"), "sha")
                own = now.withColumnRenamed("node", "above").join(nodes, [place, "above"]).select("place", "below", "sha")
                below = own if below is None else below.union(own)
            below = below.groupBy("place", "below").agg(F.count("*").alias("sides"), F.min("sha").alias("low"), F.max("sha").alias("high"))
            first = below.where("sides = 1 or low <> high").groupBy("place").agg(F.min("below").alias("node"))
            now = saved(now.select("place", "original_place").join(first, "place", "left"), "first-unequal")
        return now.withColumnRenamed("node", "cell")

    def details(self) -> DataFrame:
        """One row per decoded record that differs from the original of its description; chunks that hold its first unequal cell are all that is fetched."""
        rows = integrity.compared(self.original, self.decoded).where(~F.col("equal")).select("place", "original_place")
        found = self.first_cells(saved(rows, "unequal"))
        sides = {}
        for name, tree, place in (("a", self.a, "original_place"), ("b", self.b, "place")):
            facts = tree.records.select(F.struct(*KEY).alias(place), *[F.col(c).alias(f"{name}_{c}") for c in ("description", "n", "plain", "T", "U")])
            sides[name] = tree.window(found.where(F.col("cell").isNotNull() & F.col(place).isNotNull()), place).withColumnRenamed("symbols", name), facts
        rows = found.join(sides["b"][1], "place").join(sides["a"][1], "original_place", "left")
        for name in "ab":
            rows = rows.join(sides[name][0], "place", "left").withColumn(name, F.coalesce(name, F.lit("")))
        size, low = self.a.size, F.greatest(F.col("cell") * self.a.size - integrity.CONTEXT, F.lit(0))
        cell = lambda s: F.substring(s, (F.col("cell") * size - low + 1).cast("int"), F.lit(size))
        at = F.when(F.col("cell").isNull(), F.lit(-1).cast("long")).otherwise(F.col("cell") * size + integrity.first_difference(cell("a"), cell("b")))
        rows = rows.withColumn("at", at)
        begin = F.greatest(F.col("at") - integrity.CONTEXT, F.lit(0))
        many = F.greatest(F.least(F.col("b_n"), F.col("at") + integrity.CONTEXT) - begin, F.lit(0))
        around = lambda s: F.when(F.col("at") < 0, "").otherwise(F.substring(s, (begin - low + 1).cast("int"), many.cast("int")))
        has = lambda name: F.col(name) > 0
        reason = integrity.reason(
            F.col("a_n").isNull(), F.col("a_n") != F.col("b_n"), F.col("a_plain") == F.col("b_plain"),
            has("a_T") & has("a_U"), (has("a_T") != has("b_T")) | (has("a_U") != has("b_U")),
        )
        return rows.select(
            F.col("place.rec_no").alias("index"), F.col("b_description").alias("description"), reason.alias("reason"), F.col("at").alias("first_diff_at"),
            *[F.coalesce(f"{side}_{x}", F.lit(0)).alias(f"{name}_{x}") for name, side in (("orig", "a"), ("dec", "b")) for x in "TU"],
            around("a").alias("ctx_orig"), around("b").alias("ctx_dec"),
        )
