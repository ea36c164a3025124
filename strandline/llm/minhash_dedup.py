"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

Every text is the set of its distinct word shingles. Its sketch has T coordinates that are filled in rounds: in each
of the first T rounds every shingle is thrown into one hashed bin, in the next T rounds all shingles go to one bin in
turn, and a bin keeps the smallest value of the first round that reached it. So every coordinate is filled even for
a single shingle, and two sets agree in a coordinate with the probability of their Jaccard similarity. Bands of ROWS
coordinates give candidate buckets. With 32 bands of 4 a pair of similarity 0.8 misses all buckets with a
probability below 1e-7.

Texts of one and the same set form a class first, so thousands of copies cost one row each. Within a bucket, sketches
are compared: classes that agree in LEAST_AGREEMENT coordinates are joined to clusters (a pair at 0.8 fails that with a
probability below 1e-7). Within a cluster the full sets are compared, and that alone makes links. Both comparisons run
in blocks of at most BLOCK classes, every two blocks of a bucket or cluster together, and walk from class to
class, so a block returns what connects its classes and never its pairs. No bucket or cluster is capped.

Components: each task contracts its links to stars, so a node comes once from a task and a hub's links are nobody's
group. Nodes that no task has as a root point to one and are done; links between roots are left for the next round.

Defined results: a null or wordless text has no shingles and its own component. A row with a null doc_id belongs to
the component of its class (rows of one shingle set) and links nothing else; it is kept only if no row with an id is
in its class. Rows that repeat a doc_id are one node and judged alike. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import batch_words, byte_values, chunks, give_back, mix, ragged, shingles, stage, table

T, BANDS, ROWS = 128, 32, 4
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Of 128 coordinates, pairs at 0.8 agree in 102 on average with a deviation of 4.5.
LEAST_AGREEMENT = 77
#: Classes in a block, and shingles at most (on average).
BLOCK, BLOCK_GRAMS = 512, 1 << 21
#: Links that a task contracts at once.
LINKS = 1 << 18


def distinct_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text one after the other, and how many each has."""
    words, counts = batch_words(texts)
    grams, have = shingles(words, counts, k)
    out, sizes, at = [], np.zeros(len(texts), np.int64), 0
    for i, n in enumerate(have):
        g = np.sort(grams[at : at + n])
        at += n
        if n > 1:
            g = g[np.concatenate([[True], g[1:] != g[:-1]])]
        out.append(g)
        sizes[i] = len(g)
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), sizes


def sketch(grams: np.ndarray, sizes: np.ndarray, t: int = T) -> np.ndarray:
    """The fast similarity sketch of each set: an array of (sets, t); t is a power of two. Empty sets keep the empty mark."""
    n = len(sizes)
    out = np.full(n * t, _EMPTY, np.uint64)
    filled = np.zeros(n * t, bool)
    have = np.zeros(n, np.int64)
    e, d = grams, np.repeat(np.arange(n), sizes)
    shift, low = np.uint64(t.bit_length() - 1), np.uint64(t - 1)
    for i in range(2 * t):
        if not len(e):
            break
        r = mix(e ^ mix(np.array([i + 1], np.uint64))[0])
        cell = d * t + ((r & low).astype(np.int64) if i < t else i - t)
        fresh = ~filled[cell]
        cell, value = cell[fresh], r[fresh] >> shift
        if len(cell):
            np.minimum.at(out, cell, value)
            hit = np.unique(cell)
            out[hit] = mix(out[hit] + np.uint64(i * 0x9E3779B97F4A7C15 % (1 << 64)))
            filled[hit] = True
            np.add.at(have, hit // t, 1)
            open_ = have[d] < t
            if not open_.all():
                e, d = e[open_], d[open_]
    return out.reshape(n, t)


def band_keys(sketches: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A key for each set and band; the band is part of the key."""
    s = sketches.reshape(len(sketches), -1)[:, : bands * rows].reshape(len(sketches), bands, rows)
    acc = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), s.shape[:2])
    for j in range(rows):
        acc = mix((acc ^ s[:, :, j]) + np.uint64(j + 1))
    return acc


def _sketched(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids, prints = byte_values(batch.column("text")), batch.column("doc_id"), batch.column("print")
            for a, b in chunks(texts):
                grams, sizes = distinct_sets(texts[a:b], k)
                ends = np.cumsum(sizes)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(grams ^ np.uint64(c)))]) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
                sig = [(s[ends] - s[ends - sizes]).view(np.int64) for s in sums]
                s = sketch(grams, sizes)
                short = (s >> np.uint64(56)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), prints.slice(a, b - a), pa.array(sizes), *map(pa.array, sig), ragged(band_keys(s).view(np.int64).ravel(), np.full(b - a, BANDS)), pa.array([x.tobytes() for x in short], pa.binary())],
                    names=["doc_id", "print", "n_shingles", "sig0", "sig1", "bands", "marks"],
                )
        give_back()

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = byte_values(batch.column("text")), batch.column("doc_id")
            for a, b in chunks(texts):
                grams, sizes = distinct_sets(texts[a:b], k)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), ragged(grams.view(np.int64), sizes)], names=["node", "grams"])

    return run


def stars(pairs: np.ndarray, seed: int = 0) -> np.ndarray:
    """(node, root) of all nodes that pairs connect with their root: the smallest one, or with a seed the first in a hashed order."""
    nodes, at = np.unique(pairs, return_inverse=True)
    if seed:
        order = np.argsort(mix(nodes.view(np.uint64) ^ mix(np.array([seed], np.uint64))[0]))
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        nodes, at = nodes[order], place[at]
    low, high = at.reshape(-1, 2).T
    up = np.arange(len(nodes))
    while True:
        low, high = np.minimum(up[low], up[high]), np.maximum(up[low], up[high])
        open_ = low < high
        if not open_.any():
            break
        low, high = low[open_], high[open_]
        np.minimum.at(up, high, low)
        while (up != (far := up[up])).any():
            up = far
    below = np.flatnonzero(up != np.arange(len(nodes)))
    return np.column_stack([nodes[below], nodes[up[below]]])


class Forest:
    """The links of a task, held as stars."""

    def __init__(self, seed: int = 0) -> None:
        self.held: list[np.ndarray] = []
        self.seed = seed

    def add(self, pairs: list[np.ndarray]) -> np.ndarray:
        """Takes pairs; returns stars that have become too many to be held, or none."""
        self.held += pairs
        if sum(map(len, self.held)) > LINKS:
            self.held = [stars(np.concatenate(self.held), self.seed)]
            if len(self.held[0]) > LINKS // 2:
                return self.rest()
        return np.empty((0, 2), np.int64)

    def rest(self) -> np.ndarray:
        held, self.held = self.held, []
        return stars(np.concatenate(held), self.seed) if held else np.empty((0, 2), np.int64)


def _starred(found: np.ndarray) -> pa.RecordBatch:
    """Stars as rows, each root with a row of its own."""
    roots = np.unique(found[:, 1])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([found[:, i], roots])) for i in (0, 1)], names=["node", "up"])


def _contracted(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest(seed)
        for batch in batches:
            yield _starred(forest.add([np.column_stack([c.to_numpy() for c in batch.columns])]))
        yield _starred(forest.rest())
        give_back()

    return run


def _settled(seed: int):
    """From each node with all its roots: where it points (to itself if it is a root), and links between the roots."""

    def rows(pairs: np.ndarray, done: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(np.full(len(pairs), done))], names=["node", "up", "done"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest(seed)
        for batch in batches:
            node, least = batch.column("node").to_numpy(), batch.column("up").to_numpy()
            ups = batch.column("ups")
            row = np.repeat(np.arange(len(node)), ups.value_lengths().to_numpy())
            up = ups.flatten().to_numpy()
            root = np.zeros(len(node), bool)
            root[row[up == node[row]]] = True
            yield rows(np.column_stack([node, np.where(root, node, least)]), True)
            more = up != least[row]
            yield rows(forest.add([np.column_stack([up[more], least[row[more]]])]), False)
        yield rows(forest.rest(), False)
        give_back()

    return run


def _grouped(walk: Callable[[pa.Table], np.ndarray], keys: list[str]):
    """Streams rows that are sorted by keys; walk gets each group of several rows and returns pairs of nodes, which are contracted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last, forest = None, Forest()
        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in keys], axis=1)
            edges = np.concatenate([[0], np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1, [batch.num_rows]])
            found = []
            if held and tuple(k[0]) != last:
                found.append(walk(pa.Table.from_batches(held)))
                held = []
            table_ = pa.Table.from_batches([batch])
            for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                if b == batch.num_rows:  # may go on in the next batch
                    held.append(batch.slice(a))
                elif i == 0 and held:
                    found.append(walk(pa.Table.from_batches([*held, batch.slice(a, b - a)])))
                    held = []
                elif b - a > 1:
                    found.append(walk(table_.slice(a, b - a)))
            last = tuple(k[-1])
            yield _starred(forest.add(found))
        if held:
            yield _starred(forest.add([walk(pa.Table.from_batches(held))]))
        yield _starred(forest.rest())
        give_back()

    return run


def _walked(nodes: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """Pairs that connect nodes as all links would: each node is compared with the ones not reached yet."""
    out, rest = [], np.arange(len(nodes))
    front: list[int] = []
    while len(rest):
        if not front:
            front, rest = [int(rest[0])], rest[1:]
        i = front.pop()
        if not len(rest):
            break
        hit = near(i, rest)
        new = rest[hit]
        rest = rest[~hit]
        front += new.tolist()
        out.append(np.column_stack([np.full(len(new), nodes[i]), nodes[new]]))
    return np.concatenate(out) if out else np.empty((0, 2), np.int64)


def _by_sketch(percent: int):
    def walk(group: pa.Table) -> np.ndarray:
        if group.num_rows < 2:
            return np.empty((0, 2), np.int64)
        nodes, n = (group.column(c).to_numpy() for c in ("node", "n_shingles"))
        marks = np.frombuffer(b"".join(group.column("marks").to_pylist()), np.uint8).reshape(-1, T)

        def near(i: int, rest: np.ndarray) -> np.ndarray:
            size = 100 * np.minimum(n[i], n[rest]) >= percent * np.maximum(n[i], n[rest])
            return size & ((marks[rest] == marks[i]).sum(axis=1) >= LEAST_AGREEMENT)

        return _walked(nodes, near)

    return walk


def _by_set(percent: int):
    def walk(group: pa.Table) -> np.ndarray:
        if group.num_rows < 2:
            return np.empty((0, 2), np.int64)
        nodes = group.column("node").to_numpy()
        lists = group.column("grams").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        flat = lists.flatten().to_numpy()
        n = lists.value_lengths().to_numpy().astype(np.int64)
        ends = np.cumsum(n)
        _, flat = np.unique(flat, return_inverse=True)
        mine = np.zeros(int(flat.max()) + 1 if len(flat) else 0, np.int32)

        def near(i: int, rest: np.ndarray) -> np.ndarray:
            fit = 100 * np.minimum(n[i], n[rest]) >= percent * np.maximum(n[i], n[rest])
            some = rest[fit]
            if len(some):
                own = flat[ends[i] - n[i] : ends[i]]
                mine[own] = 1
                sizes = n[some]
                stops = np.cumsum(sizes)
                common = np.add.reduceat(mine[flat[np.repeat(ends[some] - stops, sizes) + np.arange(stops[-1])]], stops - sizes)
                mine[own] = 0
                fit[fit] = 100 * common >= percent * (n[i] + sizes - common)
            return fit

        return _walked(nodes, near)

    return walk


def in_blocks(df: DataFrame, key: str, sizes: DataFrame) -> DataFrame:
    """df with columns i, j: every two rows of a key meet in at least one (key, i, j). sizes: key and its number of blocks."""
    few = df.join(sizes, key).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    return few.withColumn("other", other).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("own", "other", "blocks")


def compared(df: DataFrame, key: str, walk: Callable[[pa.Table], np.ndarray], payload: list[str]) -> DataFrame:
    """What walk finds in each (key, i, j), contracted to stars (node, up) by each task."""
    keys = [key, "i", "j"]
    dealt = df.select(*keys, "node", *payload).repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(_grouped(walk, keys), "node long, up long")


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of links(a, b): comp is the smallest node reachable."""
    return settled(links.select("a", "b").filter("a <> b").mapInArrow(_contracted(0), "node long, up long"))


def settled(found: DataFrame) -> DataFrame:
    """(node, comp) for every node of the stars (node, up) of many tasks: comp is the smallest node reachable.

    A round leaves links between roots only, for one task as long as they are at most LINKS. If more than half of them
    were left once (as of a long chain dealt out over many tasks), roots are taken in another hashed order each time.
    """
    rounds, seed, before = [], 0, None
    while True:
        ups = found.groupBy("node").agg(F.min("up").alias("up"), F.collect_set("up").alias("ups"))
        rounds.append(stage(ups.mapInArrow(_settled(seed), "node long, up long, done boolean"), "links"))
        links = rounds[-1].filter("not done").select("node", "up")
        left = links.count()
        if not left:
            break
        if seed or before is not None and left > before // 2:
            seed = len(rounds)
        before = left
        found = links.coalesce(-(-left // LINKS)).mapInArrow(_contracted(seed), "node long, up long")
    ends = rounds[-1].filter("done").select("node", F.col("up").alias("comp"))
    for r in rounds[-2::-1]:  # a root of one round may point to another since the next
        later = ends.withColumnRenamed("node", "up")
        ends = stage(r.filter("done").join(later, "up", "left").select("node", F.coalesce("comp", "up").alias("comp")), "components")
    if seed:
        least = stage(ends.groupBy("comp").agg(F.min("node").alias("least")), "components")
        ends = stage(ends.join(least, "comp").select("node", F.col("least").alias("comp")), "components")
    return ends


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, print (xxhash64 of text), n_shingles, component_id, kept for each row of docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("print"))
    rows = stage(docs.mapInArrow(_sketched(k), "doc_id long, print long, n_shingles long, sig0 long, sig1 long, bands array<long>, marks binary"), "sketches")
    key = ["n_shingles", "sig0", "sig1"]
    # Only rows with the class's smallest id carry its bands: what a shuffle moves of thousands of copies are their ids.
    classes = stage(rows.filter("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("node")), "classes")
    nodes = stage(rows.join(classes.filter("node is not null").withColumnRenamed("node", "doc_id"), [*key, "doc_id"], "left_semi").dropDuplicates([*key, "doc_id"]).select(F.col("doc_id").alias("node"), "n_shingles", "bands", "marks"), "nodes")
    members = nodes.select("node", F.explode("bands").alias("band"))
    buckets = members.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    placed = in_blocks(members, "band", buckets).join(nodes.select("node", "n_shingles", "marks"), "node")
    alike = compared(placed, "band", _by_sketch(percent), ["n_shingles", "marks"])
    clusters = settled(alike)

    texts = docs.join(clusters.withColumnRenamed("node", "doc_id"), "doc_id")
    sets = texts.select("doc_id", "text").mapInArrow(_sets(k), "node long, grams array<long>").join(clusters, "node").join(nodes.select("node", "n_shingles"), "node")
    loads = clusters.join(nodes, "node").groupBy("comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("grams"))
    loads = loads.select("comp", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("grams") / BLOCK_GRAMS)).alias("blocks"))
    links = compared(in_blocks(sets.filter(F.size("grams") == F.col("n_shingles")), "comp", loads), "comp", _by_set(percent), ["grams"])
    comp = settled(links)

    ids = classes.join(comp, "node", "left").select(*key, F.coalesce("comp", "node").alias("node"))
    out = rows.select("doc_id", "print", *key).join(ids.withColumnRenamed("node", "class_id"), key, "left")
    own = F.when(F.col("n_shingles") > 0, F.col("class_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "print", "n_shingles", own.alias("component_id"), F.when(F.col("doc_id").isNull(), own.isNull()).otherwise(F.col("doc_id") == own).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near copies; all columns stay."""
    keep = near_duplicates(docs, k, percent).filter("kept").groupBy("doc_id", "print").agg(F.count("*").alias("n"))
    keep = stage(keep.select(F.col("doc_id").alias("_id"), F.col("print").alias("_print"), F.col("n").alias("_n")), "kept")
    found = docs.withColumn("_text", F.xxhash64("text")).join(keep, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_print")))
    once, often = found.filter("_n = 1"), found.filter("_n > 1").dropDuplicates(["_id", "_print"])
    return once.unionByName(often).select(*docs.columns)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near copies: four words, 100 * intersection >= 80 * union."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("print")
