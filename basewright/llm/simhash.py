"""SimHash near-duplicates through BK-trees.

Fingerprints within ``RADIUS`` bits of each other are linked. Cut into ``RADIUS + 1`` or more bands, two linked
fingerprints agree in all but ``RADIUS`` bands, so each distinct fingerprint goes once to every choice of the
other bands, and one BK-tree (children keyed by their integer Hamming distance to the parent) is built for each
value of these bands. A search follows only edges within the radius of the query's distance to the node. A value
shared by more than ``TREE`` fingerprints is dealt over several trees of about that size, and its fingerprints
over as many slices: each tree is copied to every slice that searches it, so that no task holds more than about
``TREE`` nodes and ``TREE`` queries of a value. Each tree is built where its shard lies and is searched there:
broadcasting the trees of all shards to all fingerprints would make every task hold, and every query walk, a share of
the whole corpus.

A tree's links are reduced to stars before they leave the task. Components over all stars come from large-star
and small-star rounds on tables in the shared folder. Nodes are the distinct fingerprints, so equal ones are never
expanded into pairs, and ids may be any numbers; a component's id is found at the end.

Defined cases: null or blank texts have fingerprint zero and are linked like any other; null ids are never a
component's id (it is null if a component has no other); repeated rows each keep a row, and rows that share an id
belong each to the component of its text; no rows give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, document_text, partitions

RADIUS, SHINGLE, SEED, TREE = 3, 3, 42, 8192
#: Rows of (query, node) that a search holds at once.
FRONTIER = 1 << 19
#: Near copies share this part of their distinct shingles of so many words; candidates agree in one of BANDS runs of DEPTH minima.
JACCARD, WORDS, BANDS, DEPTH = 0.8, 5, 20, 4
#: Bits of a set's sketch, and sets of a bucket that are compared in one go.
SKETCH, SLICE = 1024, 4096
#: Hashes of texts, and bytes of shingle sets, that are sent to every task; if there are more, they are joined.
SENT, SENT_BYTES = 1_000_000, 16 << 20


def simhash(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> bytes:
    """Eight bytes, the highest bit first; only A-Z are lower-cased."""
    words = text.lower().split()
    if not words:
        return bytes(8)
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    n = max(1, len(words) - shingle + 1)
    starts = [0, *(e + 1 for e in ends[: n - 1])]
    stops = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        found = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[k : k + (1 << 16)], stops[k : k + (1 << 16)])])
        ones += np.unpackbits(np.frombuffer(found, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.uint32)
    return np.packbits(2 * ones > n).tobytes()


def shingle_set(text: bytes, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """Hashes of the distinct runs of so many words, in order; a shorter text is one run."""
    found = text.lower().split()
    runs = {b" ".join(found[k : k + words]) for k in range(max(1, len(found) - words + 1))} if found else ()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(r, seed) for r in runs), np.uint64, len(runs)))


def sketch(hashes: np.ndarray, bits: int = SKETCH) -> bytes:
    """Parities of how many hashes fall on each bit. Two sets differ in at least as many members as their sketches in bits."""
    return np.packbits(np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).tobytes()


def set_name(hashes: np.ndarray) -> int:
    """One signed number for a set of shingles."""
    return xxhash.xxh64_intdigest(hashes.tobytes()) - (1 << 63)


def minima(hashes: np.ndarray, times: np.ndarray, plus: np.ndarray) -> list[int]:
    """A signed number for each run of ``DEPTH`` minima of a set; none for an empty one."""
    least = np.full(len(times), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[k : k + 1024, None] * times + plus).min(0), out=least)
    runs = least.reshape(-1, DEPTH)
    return [xxhash.xxh64_intdigest(r.tobytes(), k) - (1 << 63) for k, r in enumerate(runs)] if len(hashes) else []


def fingerprints(docs: DataFrame, *keep: str, shingle: int = SHINGLE, seed: int = SEED, copies: bool = False) -> DataFrame:
    """Adds the fingerprint of whole texts as a signed number. keep: columns to carry.

    copies: adds the name of the text's shingle set, the set's size, sketch and runs of minima, too, from the same Python function,
    as a second one in a task would be a second process.
    """
    rng = np.random.default_rng(SEED)
    times, plus = (rng.integers(0, 1 << 63, BANDS * DEPTH, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
    names = [*keep, "fingerprint", *["name", "size", "sketch", "bands"] * copies]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            prints, sets, sizes, sketches, bands = [], [], [], [], []
            for text in batch.column(batch.num_columns - 1).cast(pa.binary()):
                text = text.as_py()
                prints.append(simhash(text, shingle, seed))
                if copies:
                    own = shingle_set(text)
                    sets.append(set_name(own))
                    sizes.append(len(own))
                    sketches.append(sketch(own))
                    bands.append(minima(own, times, plus))
            columns = [*batch.columns[:-1], pa.array(np.frombuffer(b"".join(prints), ">i8").astype(np.int64))]
            if copies:
                columns += [pa.array(sets, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(*keep, document_text(docs).alias("_".join(["text", *keep])))  # no column to keep has this name
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "fingerprint long"])
    return rows.mapInArrow(run, schema + ", name long, size long, sketch binary, bands array<long>" * copies)


class Forest:
    """BK-trees over distinct unsigned numbers, one per group; nodes are the numbers' places."""

    def __init__(self, values: np.ndarray, groups: np.ndarray):
        n = len(values)
        self.values, self.roots = values, {}
        parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        items, key, level = np.arange(n), groups.astype(np.int64), 0
        while len(items):
            order = np.argsort(key, kind="stable")
            items, key = items[order], key[order]
            first = np.concatenate([[True], key[1:] != key[:-1]])
            node = items[np.flatnonzero(first)][np.cumsum(first) - 1]
            if level == 0:
                self.roots = dict(zip(key[first].tolist(), items[first].tolist()))
            items, node = items[~first], node[~first]
            edge[items] = np.bitwise_count(values[items] ^ values[node])
            parent[items] = node
            key = node * 65 + edge[items]
            level += 1
        self.children = np.lexsort((edge, parent))
        self.keys = (parent * 65 + edge)[self.children]

    def links(self, queries: np.ndarray, groups: np.ndarray, radius: int, frontier: int = FRONTIER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place of query, node) within the radius, over each query's own group's tree."""
        root = np.array([self.roots.get(g, -1) for g in groups.tolist()], np.int64)
        # queries are taken in slices; a frontier that grows too large is worked off in parts
        work = [(k, root[k]) for k in [np.flatnonzero(root >= 0)] if len(k)]
        while work:
            query, node = work.pop()
            if len(query) > frontier:
                half = len(query) // 2
                work += [(query[half:], node[half:]), (query[:half], node[:half])]
                continue
            far = np.bitwise_count(queries[query] ^ self.values[node]).astype(np.int64)
            near = far <= radius
            if near.any():
                yield query[near], node[near]
            low = np.searchsorted(self.keys, node * 65 + np.maximum(far - radius, 0))
            high = np.searchsorted(self.keys, node * 65 + np.minimum(far + radius, 64), "right")
            n = high - low
            if total := int(n.sum()):
                query = np.repeat(query, n)
                place = np.repeat(low - np.cumsum(n) + n, n) + np.arange(total)
                work.append((query, self.children[place]))


def spread(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins labels over links in place: both ends get the least label of their trees of labels."""
    while True:
        x, y = labels[a], labels[b]
        if (x == y).all():
            return
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(labels, high, low)
        while not np.array_equal(up := labels[labels], labels):
            labels[:] = up


def band_masks(classes: int, radius: int = RADIUS) -> list[int]:
    """Masks such that any two numbers within the radius agree under one of them; finer for more classes, exact for any number."""
    bands = radius + (1 if classes < 1 << 24 else 2 if classes < 1 << 32 else 3)
    cuts = [64 * k // bands for k in range(bands + 1)]
    band = [((1 << cuts[k + 1]) - 1) ^ ((1 << cuts[k]) - 1) for k in range(bands)]
    return [sum(c) for c in combinations(band, bands - radius)]


def band_shards(classes: DataFrame, work: Workspace, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """classes: fingerprint. Rows of band, key, part (a tree and a slice of queries), inside (is a node), asks (is a query), fingerprint."""
    spark = classes.sparkSession
    masks = [m - (1 << 64) if m >> 63 else m for m in band_masks(classes.count(), radius)]
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("band"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)]))
    banded = classes.select("fingerprint", keys.alias("k")).select("fingerprint", "k.band", "k.key")
    many = work.save(banded.groupBy("band", "key").agg(F.count("*").alias("n")).where(F.col("n") > tree), "hot-bands")
    trees = many.select(F.col("band").alias("band_"), F.col("key").alias("key_"), F.ceil(F.col("n") / tree).alias("trees"))
    if hot := many.count():
        trees = F.broadcast(trees) if hot <= 10_000 else trees
        banded = banded.join(trees, (F.col("band") == F.col("band_")) & (F.col("key") == F.col("key_")), "left").drop("band_", "key_")
    else:
        banded = banded.withColumn("trees", F.lit(None).cast("long"))
    n = F.coalesce("trees", F.lit(1))
    own = F.pmod(F.xxhash64("fingerprint"), n).cast("long")
    slice_ = F.pmod(F.xxhash64(F.lit(SEED), "fingerprint"), n).cast("long")
    part = lambda t, s, inside, asks: F.struct((t * F.col("n") + s).alias("part"), inside.alias("inside"), F.lit(asks).alias("asks"))
    # a fingerprint searches its own tree and the later ones; its own tree is copied to the other slices
    searched = F.transform(F.sequence("own", F.col("n") - 1), lambda t: part(t, F.col("slice"), t == F.col("own"), True))
    copied = F.transform(F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda s: s != F.col("slice")), lambda s: part(F.col("own"), s, F.lit(True), False))
    shards = banded.select("fingerprint", "band", "key", n.cast("long").alias("n"), own.alias("own"), slice_.alias("slice"))
    return shards.select("band", "key", F.explode(F.concat(searched, copied)).alias("p"), "fingerprint").select("band", "key", "p.*", "fingerprint")


def star_links(classes: DataFrame, work: Workspace, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """classes: fingerprint. Pairs (a, b) of fingerprints, a above b, that connect what lies within the radius."""
    shards = band_shards(classes, work, radius, tree)
    shards = shards.repartition(partitions(classes.sparkSession), "band", "key", "part").sortWithinPartitions("band", "key", "part", "fingerprint")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for band, key, part, inside, asks, prints in bundles(source):
            new = np.concatenate([[True], (band[1:] != band[:-1]) | (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
            group = np.cumsum(new)
            place, query = np.flatnonzero(inside), np.flatnonzero(asks)
            values = prints.view(np.uint64)
            forest = Forest(values[place], group[place])
            # labels are places among the distinct fingerprints in rising order
            distinct, name = np.unique(prints, return_inverse=True)
            labels = np.arange(len(distinct))
            for q, x in forest.links(values[query], group[query], radius):
                a, b = name[query[q]], name[place[x]]
                differ = a != b
                spread(labels, a[differ], b[differ])
            moved = np.flatnonzero(labels != np.arange(len(labels)))
            if len(moved):
                yield pa.record_batch([pa.array(distinct[moved]), pa.array(distinct[labels[moved]])], ["a", "b"])

    return shards.mapInArrow(run, "a long, b long").distinct()


def bundles(source: Iterator[pa.RecordBatch], least: int = 1 << 16) -> Iterator[list[np.ndarray]]:
    """Columns of at least so many rows, cut between groups of the first three columns."""
    held: list[list[np.ndarray]] = []
    rows = 0
    for batch in source:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(columns[0]):
            continue
        held.append(columns)
        rows += len(columns[0])
        if rows < least:
            continue
        whole = [np.concatenate(c) for c in zip(*held)]
        edge = np.flatnonzero((whole[0][1:] != whole[0][:-1]) | (whole[1][1:] != whole[1][:-1]) | (whole[2][1:] != whole[2][:-1]))
        if len(edge):
            cut = int(edge[-1]) + 1
            yield [c[:cut] for c in whole]
            whole = [c[cut:] for c in whole]
        held, rows = [whole], len(whole[0])
    if rows:
        yield [np.concatenate(c) for c in zip(*held)]


def components(links: DataFrame, work: Workspace) -> DataFrame:
    """links: (a, b), a above b. Returns (node, component), the least node that each linked node reaches.

    Rounds of large-star and small-star until nothing changes. Each round's tables are written, so that joins
    shuffle plain rows and a hub's partition can be split.
    """

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first())

    def starred(edges: DataFrame, name: str, large: bool) -> DataFrame:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("least")) if large else edges.groupBy("a").agg(F.min("b").alias("least"))
        least = work.save(least.withColumnRenamed("a", "hub"), f"{name}-least")
        around = both.join(least, F.col("a") == F.col("hub"))
        if large:
            new = around.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
        else:
            new = around.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("least").alias("b")), F.struct(F.col("a"), F.col("least").alias("b")))).alias("e")).select("e.a", "e.b")
        return work.save(new.where(F.col("a") != F.col("b")).distinct(), name)

    edges, seen, k = links, state(links), 0
    while seen[0]:
        edges = starred(starred(edges, f"large-{k}", True), f"small-{k}", False)
        now = state(edges)
        for old in (f"large-{k}-least", f"large-{k}", f"small-{k}-least", f"small-{k - 1}"):
            work.drop(old)
        if now == seen:
            break
        seen, k = now, k + 1
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def look_alikes(split: DataFrame, work: Workspace, step: str, similarity: float, best: bool, size: int = SLICE) -> DataFrame:
    """split: band, key, name, component, size, sketch of sets. Pairs (name, other) of a bucket and of different components whose sizes and sketches do not rule out the similarity.

    best: of a set's pairs with one component, only that of the most similar sketches. Sets of a bucket are compared in
    slices, a pair of slices a group; what sketches rule out never leaves a task.
    """
    many = work.save(split.groupBy("band", "key").agg(F.ceil(F.count("*") / size).cast("long").alias("slices")), f"slices-{step}")
    own = F.pmod(F.xxhash64("name"), F.col("slices"))
    part = lambda x: F.struct((F.least("own", x) * F.col("slices") + F.greatest("own", x)).alias("part"), (F.col("own") <= x).alias("mine"), (F.col("own") >= x).alias("theirs"))
    rows = split.join(many, ["band", "key"]).withColumn("own", own)
    rows = rows.select("band", "key", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1), part)).alias("p"), "name", "component", "size", "sketch")
    rows = rows.select("band", "key", "p.*", "name", "component", "size", "sketch")
    rows = rows.repartition(partitions(split.sparkSession), "band", "key", "part").sortWithinPartitions("band", "key", "part", "name")
    apart = (1 - similarity) / (1 + similarity)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for band, key, part, mine, theirs, name, component, size, bits in bundles(source, 1 << 14):
            words = np.frombuffer(b"".join(bits), np.uint64).reshape(len(bits), -1)
            new = np.flatnonzero(np.concatenate([[True], (band[1:] != band[:-1]) | (key[1:] != key[:-1]) | (part[1:] != part[:-1])]))
            for begin, end in zip(new.tolist(), [*new[1:].tolist(), len(band)]):
                first, second = begin + np.flatnonzero(mine[begin:end]), begin + np.flatnonzero(theirs[begin:end])
                for k in range(0, len(first), 256):
                    rows = first[k : k + 256]
                    x, y = size[rows][:, None], size[second][None, :]
                    due = (component[rows][:, None] != component[second][None, :]) & (np.minimum(x, y) >= similarity * np.maximum(x, y))
                    a, b = np.nonzero(due)
                    far = np.zeros(len(a), np.int64)
                    for w in range(words.shape[1]):
                        far += np.bitwise_count(words[rows[a], w] ^ words[second[b], w])
                    near = far <= apart * (size[rows[a]] + size[second[b]]) + 1e-6
                    a, b, far = rows[a[near]], second[b[near]], far[near]
                    if best and len(a):
                        order = np.lexsort((name[b], far, component[b], a))
                        a, b = a[order], b[order]
                        once = np.concatenate([[True], (a[1:] != a[:-1]) | (component[b][1:] != component[b][:-1])])
                        a, b = a[once], b[once]
                    if len(a):
                        yield pa.record_batch([pa.array(name[a]), pa.array(name[b])], ["name", "other"])

    return rows.mapInArrow(run, "name long, other long")


def copy_links(docs: DataFrame, rows: DataFrame, work: Workspace, similarity: float = JACCARD) -> DataFrame:
    """Pairs (a, b) of fingerprints, a above b, that hold texts of at least so similar shingle sets.

    docs: lot (a hash of the text), text. rows: lot, fingerprint, name, bands of each document.
    Candidates agree in a run of minima, which misses 3 in 100,000 pairs of just 0.8; each is confirmed by its sets,
    made again from one text of each set that a candidate needs, so that the corpus's sets are never kept on disk.
    Only links that join something new are sought: each set is compared with the first or last of its buckets that
    shares most of them, then with the others of these that are still apart, and after that sets of different components
    in a bucket, as far as their sizes and sketches allow the similarity.
    """

    def hashed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            sets = [shingle_set(text.as_py()) for text in batch.column(0).cast(pa.binary())]
            yield pa.record_batch([pa.array([set_name(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["name", "held"])

    def confirmed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            near = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))

    sets = rows.where(F.size("bands") > 0)
    banded = work.save(sets.select("name", "bands").distinct().select("name", F.posexplode("bands").alias("band", "key")), "minima")
    texts = work.save(sets.groupBy("name").agg(F.min("lot").alias("lot")), "set-texts")

    def links_of(pairs: DataFrame, step: str) -> DataFrame:
        """The pairs (a, b) of names whose sets are similar."""
        pairs = work.save(pairs.select(F.greatest("name", "other").alias("a"), F.least("name", "other").alias("b")).distinct(), f"pairs-{step}")
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct()
        wanted = work.save(texts.join(wanted, "name", "left_semi").select("lot"), f"wanted-{step}")
        few = wanted.count() <= SENT
        held = docs.select("lot", document_text(docs).alias("text")).join(F.broadcast(wanted) if few else wanted, "lot", "left_semi").dropDuplicates(["lot"])
        held = work.save(held.select("text").mapInArrow(hashed, "name long, held binary"), f"sets-{step}")
        small = (held.agg(F.sum(F.length("held") + 32)).first()[0] or 0) <= SENT_BYTES
        x, y = (held.withColumnsRenamed({"name": n, "held": h}) for n, h in ("ax", "by"))
        both = pairs.join(F.broadcast(x) if small else x, "a").join(F.broadcast(y) if small else y, "b")
        near = work.save(both.select("a", "b", "x", "y").mapInArrow(confirmed, "a long, b long"), f"near-{step}")
        work.drop(f"sets-{step}")
        return near

    def joined(near: DataFrame, step: str) -> DataFrame:
        """Every linked name with its component so far."""
        return components(near, Workspace(docs.sparkSession, f"copies-{step}")).withColumnRenamed("node", "name")

    # 1. every set against the one of the first and the last of its buckets that it shares most buckets with
    many = banded.groupBy("band", "key").agg(F.min("name").alias("first"), F.max("name").alias("last")).where(F.col("first") < F.col("last"))
    many = work.save(many, "buckets")
    led = banded.join(many, ["band", "key"]).select("name", F.explode(F.array("first", "last")).alias("other")).where(F.col("name") != F.col("other"))
    led = work.save(led.groupBy("name", "other").agg(F.count("*").alias("shared")), "led")
    near = links_of(led.groupBy("name").agg(F.max_by("other", F.struct("shared", "other")).alias("other")), "best")
    # 2. against the others of these, where that may join something
    known = joined(near, "best")
    apart = led.join(known, "name", "left").withColumnRenamed("component", "own")
    apart = apart.join(known.withColumnsRenamed({"name": "other", "component": "theirs"}), "other", "left")
    near = near.union(links_of(apart.where(F.coalesce("own", "name") != F.coalesce("theirs", "other")), "led"))
    # 3. what these have not joined, in buckets of several components, as far as sketches allow: first the best of a set and a component, then all
    sketches = work.save(sets.groupBy("name").agg(F.first("size").alias("size"), F.first("sketch").alias("sketch")), "sketches")
    for step, best in (("rest", True), ("last", False)):
        known = joined(near, f"before-{step}")
        members = banded.join(many.select("band", "key"), ["band", "key"]).join(known, "name", "left").withColumn("component", F.coalesce("component", "name"))
        members = work.save(members, f"members-{step}")
        parts = members.groupBy("band", "key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where(F.col("least") < F.col("most"))
        split = members.join(parts.select("band", "key"), ["band", "key"]).join(sketches, "name")
        near = near.union(links_of(look_alikes(split, work, step, similarity, best), step))
        work.drop(f"members-{step}")
    # equal sets may have several fingerprints; the least stands for the set
    nodes = work.save(sets.select("name", F.col("fingerprint").alias("node")).distinct(), "set-nodes")
    least = work.save(nodes.groupBy("name").agg(F.min("node").alias("least")), "set-least")
    ends = [least.select(F.col("name").alias(c), F.col("least").alias(f"node_{c}")) for c in "ab"]
    links = near.join(ends[0], "a").join(ends[1], "b").select(F.greatest("node_a", "node_b").alias("a"), F.least("node_a", "node_b").alias("b"))
    links = links.union(nodes.join(least, "name").select(F.col("node").alias("a"), F.col("least").alias("b")))
    return links.where(F.col("a") > F.col("b")).distinct()


def linked(docs: DataFrame, rows: DataFrame, work: Workspace, radius: int, tree: int, copies: bool) -> DataFrame:
    """rows: doc_id, fingerprint of docs; for copies lot, name and bands, too. print_ (each distinct fingerprint), component (a fingerprint of it), component_id."""
    classes = work.save(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "classes")
    links = star_links(classes, work, radius, tree)
    links = work.save(links.union(copy_links(docs, rows, work)).distinct() if copies else links, "links")
    known = components(links, work)
    found = classes.join(known, F.col("fingerprint") == F.col("node"), "left").select(F.col("fingerprint").alias("print_"), F.coalesce("component", "fingerprint").alias("component"), "least")
    found = work.save(found, "components")
    ids = found.groupBy("component").agg(F.min("least").alias("component_id"))
    return work.save(found.drop("least").join(ids, "component"), "component-ids")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", radius: int = RADIUS, shingle: int = SHINGLE, tree: int = TREE, copies: bool = False) -> DataFrame:
    """doc_id, fingerprint (number), component_id for every row. copies: links near copies by their shingle sets, too."""
    work = Workspace(docs.sparkSession, "simhash")
    own = docs.select(docs[id_column].cast("long").alias("doc_id"), docs["text"].alias("text"), F.xxhash64(docs["text"]).alias("lot"))
    rows = work.save(fingerprints(own, "doc_id", *["lot"] * copies, shingle=shingle, copies=copies), "fingerprints")
    found = linked(own, rows, work, radius, tree, copies)
    return rows.join(found, F.col("fingerprint") == F.col("print_")).select("doc_id", "fingerprint", "component_id")


def first_of_each(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, copies: bool = False) -> DataFrame:
    """One row of docs for each component: one with its id, or one without an id where the component has none."""
    work = Workspace(docs.sparkSession, "simhash-first")
    names = [f"c{k}" for k in range(len(docs.columns))]  # free of clashes with the columns added
    held = docs.toDF(*names)
    id_, text = (held[names[docs.columns.index(c)]] for c in ("doc_id", "text"))
    own = held.select(id_.cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("lot"))
    rows = work.save(fingerprints(own, "doc_id", "lot", shingle=shingle, copies=copies), "fingerprints")
    found = linked(own, rows, work, radius, TREE, copies)
    best = rows.join(found, F.col("fingerprint") == F.col("print_")).groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "lot")).alias("best"))
    best = best.select("component", F.col("best.doc_id").alias("best_id"), F.col("best.lot").alias("best_lot"))
    kept = held.join(best, id_.cast("long").eqNullSafe(F.col("best_id")) & (F.xxhash64(text) == F.col("best_lot")))
    return kept.dropDuplicates(["component"]).select(*names).toDF(*docs.columns)


def fingerprint_hex(column: Column) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", fingerprint_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")


QUERIES = {"op7_simhash": op7_simhash}
SQL: dict[str, str] = {}
