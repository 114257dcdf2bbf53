"""Exact Jaccard join of word n-gram sets by skipping over set relations.

A text is the set of its runs of ``SHINGLE`` words (A-Z in lower case, split at ASCII white space). Equal sets are one
node. Elements have one order for all sets, the rarest first: a table of counters over all texts tells frequent elements
from the rest. Two sets of sizes n and m are linked if they share at least ``ceil(a (n + m) / (a + b))`` elements for a
similarity of a / b; then the first elements of both (n - ceil(a n / b) + 1 of the larger one, fewer of the smaller one)
have one in common. These prefixes are the index: a list of sets, with sizes and positions, for each element that
several sets have.

First relation, within a list: a position bounds what two sets can still share, so each entry knows the sizes that it can
reach. Entries stand in blocks by size and by reach, and a probe meets only the blocks that can answer; the rest are
skipped unread.

Second relation, between sets: in each list all sets are compared with one, its centre, which meets most others. A set
that is linked with a centre is in its class, and what the centre found needn't be searched again; the most similar
centre leads the set. What is left are pairs of sets in different classes. Bitmaps of the sets bound what two of them can
share, so that sets with a chance n-gram in common are not read. A leader is compared once with each set that
one of its followers meets. What the leader shares, and the number of elements that the follower has beside it, bound what
the follower can share; if that is not enough to decide, the follower's overlap is derived from the leader's by the few
elements in which the two differ.

The result is exact but for the chance that two of all n-grams have one 64-bit hash. Texts of fewer words are one element; texts
without words, also null and empty ones, are linked with nothing. Repeated rows are linked, null ids come last. An empty
table gives no rows. Other columns are ignored. Texts are read whole, and no list is cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquarry.llm.arrays import K1, K2, K3, lowered, mix, slices, text_column, utf8, word_hash, words
from mailquarry.llm.bitmap import bitmap, maybe
from mailquarry.llm.components import components
from mailquarry.llm.exact import located
from mailquarry.plans.staging import written

SHINGLE = 5
SIMILARITY = (4, 5)
COUNTER_BITS = 22           # counters of the frequency table
BLOCKS = 16                 # parts in which the table is added up
SURE = 6.0                  # standard deviations by which a counter stands out
STEP = 1.08                 # ratio of successive size and reach classes
ROW_BITS = 40               # rows of one task; the bits above hold the task's partition
BITS = 2048                 # of the bitmap of a set, at least; long sets have two to four bits an element
MARKED = "doc_id long, locator struct<file: string, row: long>, row long, low long, high long, n long, prefix array<long>, bits array<long>"


def elements(data: np.ndarray, borders: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of every distinct run of words, sorted by both."""
    start, stop, text = words(data, borders)
    word = word_hash(lowered(data), start, stop)
    n = np.bincount(text, minlength=len(borders) - 1)
    owners, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    if len(word) >= size:
        run = np.zeros(len(word) - size + 1, np.uint64)
        for j in range(size):
            run += mix(word[j:len(word) - size + 1 + j] ^ mix(np.array([j + 1], np.uint64) * K2))
        whole = text[size - 1:] == text[:len(text) - size + 1]
        owners.append(text[:len(run)][whole])
        hashes.append(mix(run[whole]))
    short = np.flatnonzero(n[text] < size)
    if len(short):
        place = (short - np.searchsorted(text, text[short]) + 1).astype(np.uint64)
        own, first = np.unique(text[short], return_index=True)
        owners.append(own)
        hashes.append(mix(np.add.reduceat(mix(word[short] ^ mix(place * K3)), first) + K1))
    owner, element = np.concatenate(owners), np.concatenate(hashes)
    order = np.lexsort((element, owner))
    owner, element = owner[order], element[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (element[1:] != element[:-1])
    return owner[new], element[new]


def _counter(element: np.ndarray) -> np.ndarray:
    return (element >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def levels(rows: DataFrame) -> np.ndarray:
    """Frequency level of every counter: 0 for counters that don't stand out, else about eight times the logarithm of the count.

    Each task counts the elements of its texts in one table, whose blocks are added up in tasks. The table has a fixed
    size, so it stands for counts the better the more frequent an element is; levels order elements and decide nothing.
    """
    size = 1 << COUNTER_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.uint32)
        for batch in batches:
            for part in slices(batch):
                np.add.at(total, _counter(elements(*utf8(text_column(part)))[1]), 1)
        if total.any():
            payload = [zlib.compress(block.tobytes(), 1) for block in total.reshape(BLOCKS, -1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BLOCKS, dtype=np.int32)), pa.array(payload, pa.binary())], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("counts"), strict=True):
                counts = np.frombuffer(zlib.decompress(payload.as_py()), np.uint32)
                total[block] = total[block] + counts if block in total else counts.astype(np.uint64)
        logs = [np.rint(8 * np.log2(1.0 + c)).astype(np.uint8).tobytes() for c in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(logs, pa.binary())], ["block", "counts"])

    kind = "block int, counts binary"
    found = rows.select("text").mapInArrow(count, kind).repartition(BLOCKS, "block").mapInArrow(add, kind).collect()       # a byte per counter
    log = np.zeros((BLOCKS, size // BLOCKS), np.uint8)
    for r in found:
        log[r.block] = np.frombuffer(r.counts, np.uint8)
    log = log.reshape(-1)
    mean = float((np.exp2(log / 8.0) - 1).mean())
    return np.where(log > 8 * np.log2(1 + mean + SURE * np.sqrt(mean)), log, 0).astype(np.uint8)


def prefix_size(n: np.ndarray, a: int, b: int) -> np.ndarray:
    """Elements of a set of size n of which a linked set that isn't larger has at least one."""
    return np.where(n > 0, n + 1 + -n * a // b, 0)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.view(np.int64)))


def _bitmaps(owner: np.ndarray, element: np.ndarray, count: int) -> pa.ListArray:
    """One bit per element in each set's bitmap, as long integers. Sets differ in as many elements as their bitmaps in bits, at least."""
    n = np.bincount(owner, minlength=count)
    width = np.maximum(BITS, 1 << np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64))
    start = np.concatenate([[0], np.cumsum(width)])
    out = np.zeros(start[-1] // 8, np.uint8)
    bit = start[owner] + (element & (width[owner] - 1).astype(np.uint64)).astype(np.int64)
    np.bitwise_or.at(out, bit >> 3, np.left_shift(1, bit & 7).astype(np.uint8))
    return pa.ListArray.from_arrays(pa.array((start // 64).astype(np.int32)), pa.array(out.view("<i8")))


def _differing(x: Column, y: Column) -> Column:
    """Bits in which two bitmaps differ; the wider one is folded to the width of the other."""
    k = F.least(F.size(x), F.size(y))

    def folded(z: Column) -> Column:
        layers = F.sequence(F.lit(0), (F.size(z) / k).cast("int") - 1)
        fold = F.transform(F.slice(z, F.lit(1), k), lambda v, i: F.aggregate(layers, v, lambda acc, j: acc.bitwiseOR(F.get(z, i + j * k))))
        return F.when(F.size(z) == k, z).otherwise(fold)

    return F.aggregate(F.zip_with(folded(x), folded(y), lambda v, w: F.bit_count(v.bitwiseXOR(w))), F.lit(0), lambda acc, v: acc + v)


def _marked(rows: DataFrame, level: np.ndarray, a: int, b: int) -> DataFrame:
    """Of every row: its number, two sums of hashes that name its set, the set's size and prefix."""
    shared = rows.sparkSession.sparkContext.broadcast(level)           # 2 ** COUNTER_BITS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << ROW_BITS
        for batch in batches:
            for part in slices(batch):
                owner, element = elements(*utf8(text_column(part)))
                count = part.num_rows
                n = np.bincount(owner, minlength=count)
                sums = [np.zeros(count, np.uint64) for _ in range(2)]
                some = np.flatnonzero(n)
                first = (np.cumsum(n) - n)[some]
                for out, salt in zip(sums, (K1, K2), strict=True):
                    if len(first):
                        out[some] = np.add.reduceat(mix(element ^ salt), first)
                order = np.lexsort((shared.value[_counter(element)], owner))           # within a level by hash
                taken = prefix_size(n, a, b)
                place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                prefix = element[order][place < taken[owner]]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("locator"), pa.array(at + np.arange(count)), *(pa.array(s.view(np.int64)) for s in sums),
                                                  pa.array(n), _lists(prefix, taken), _bitmaps(owner, element, count)], ["doc_id", "locator", "row", "low", "high", "n", "prefix", "bits"])
                at += count

    return rows.select("doc_id", "locator", "text").mapInArrow(run, MARKED)


def _sets(rows: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Elements of the wanted nodes, from the text of one row of each."""
    keys = written(nodes.join(wanted, "node").select("node", "locator"))
    texts = maybe(rows, "locator", bitmap(keys, "locator", keys.count())).join(keys, "locator").select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                owner, element = elements(*utf8(text_column(part)))
                yield pa.RecordBatch.from_arrays([part.column("node"), _lists(element, np.bincount(owner, minlength=part.num_rows))], ["node", "elements"])

    return written(texts.mapInArrow(run, "node long, elements array<long>"))


def _index(marked: DataFrame, nodes: DataFrame, a: int, b: int) -> DataFrame:
    """Entries (element, node, n, reach) of all lists with several sets, with the list's length and its centre."""
    marked = maybe(marked, "row", bitmap(nodes, "node", nodes.count()))          # copies of a set make no list
    several = marked.select(F.explode("prefix").alias("element")).groupBy("element").agg(F.count("*").alias("rows")).where("rows > 1").select("element")
    several = written(several)
    entries = maybe(marked.select(F.col("row").alias("node"), "n", F.posexplode("prefix").alias("position", "element")), "element", bitmap(several, "element", several.count()))
    reach = F.floor((F.col("n") - F.col("position")) * ((a + b) / a) - F.col("n") + 1e-6)          # the largest set that can be linked, if this is the first common element
    entries = written(entries.withColumn("reach", reach).drop("position").join(nodes.select("node"), "node"))
    sizes = entries.groupBy("element").agg(F.count("*").alias("length"), F.sum("n").alias("sum_n"), F.sum("reach").alias("sum_reach")).where("length > 1")
    both = entries.join(sizes, "element").withColumn("other_n", F.col("sum_n") - F.col("n")).withColumn("other_reach", F.col("sum_reach") - F.col("reach"))
    fits = f"n * {b} >= other_n * {a} AND other_n * {b} >= n * {a} AND n <= other_reach AND other_n <= reach"          # a list of two is one pair
    entries = written(both.where(f"length > 2 OR {fits}").drop("sum_n", "sum_reach", "other_n", "other_reach"))
    weight = entries.groupBy("node").agg(F.sum("length").alias("weight"))              # how many others a set meets
    centre = entries.join(weight, "node").groupBy("element").agg(F.max_by(F.struct("node", "n", "reach"), F.struct("weight", "node")).alias("centre"))
    return written(entries.join(centre, "element"))


def _joined(pairs: DataFrame, table: DataFrame, value: str, *sides: str) -> DataFrame:
    """The pairs with a value of each side, ``{side}_{value}``; rows of the table that no pair needs are not shuffled."""
    pairs = written(pairs)
    n, out = pairs.count(), pairs
    for c in sides:
        out = out.join(maybe(table.select(F.col("node").alias(c), F.col(value).alias(f"{c}_{value}")), c, bitmap(pairs.select(c), c, n)), c)
    return out


def _able(pairs: DataFrame, nodes: DataFrame, x: str, y: str, a: int, b: int) -> DataFrame:
    """The pairs (sizes n and m) that can be linked by their bitmaps."""
    differ = _differing(F.col(f"{x}_bits"), F.col(f"{y}_bits"))
    both = _joined(pairs, nodes, "bits", x, y)
    return written(both.where((F.col("n") + F.col("m") - differ) * (a + b) >= (F.col("n") + F.col("m")) * (2 * a)).drop(f"{x}_bits", f"{y}_bits"))


def _shared(pairs: DataFrame, sets: DataFrame, left: str, right: str) -> DataFrame:
    """The pairs with the number of common elements."""
    both = _joined(pairs, sets, "elements", right, left)
    return written(both.withColumn("shared", F.size(F.array_intersect(f"{left}_elements", f"{right}_elements"))).drop(f"{left}_elements", f"{right}_elements"))


def _linked_by(shared: Column, n: Column, m: Column, a: int, b: int) -> Column:
    return shared * (a + b) >= (n + m) * a


def _class(size: Column) -> Column:
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / np.log(STEP))


def _meeting(index: DataFrame, found: DataFrame | None, a: int, b: int) -> DataFrame:
    """Pairs (x, y) of sets in different classes, y not larger than x, that may be linked by their places in a list."""
    rooted = index if found is None else index.join(found, "node", "left")
    rooted = rooted.withColumn("root", F.col("node") if found is None else F.coalesce("root", "node"))
    parts = rooted.groupBy("element", "root").agg(F.count("*").alias("k")).groupBy("element").agg(F.max_by("root", F.struct("k", "root")).alias("largest"), F.count("*").alias("parts"))
    mixed = rooted.where("length > 2 AND node <> centre.node").join(parts.where("parts > 1"), "element")
    mixed = written(mixed.select("element", "node", "root", "n", "reach", (F.col("root") == F.col("largest")).alias("large")))
    blocks = mixed.where("reach >= n").select("element", _class(F.col("n")).alias("own"), _class(F.col("reach")).alias("far"), *[F.col(c).alias(f"y_{c}") for c in ("node", "root", "n", "reach", "large")])
    sized = mixed.select("*", F.ceil(F.col("n") * (a / b) - 1e-6).alias("least"), F.least("n", "reach").alias("most")).where("least <= most")
    probes = (sized.withColumn("own", F.explode(F.sequence(_class(F.col("least")), _class(F.col("most")))))
              .withColumn("far", F.explode(F.sequence(_class(F.col("n")), _class(F.col("n") * (b / a))))))
    probes = probes.select("element", "own", "far", *[F.col(c).alias(f"x_{c}") for c in ("node", "root", "n", "least", "most", "large")])
    keep = F.expr("x_root <> y_root AND y_n BETWEEN x_least AND x_most AND x_n <= y_reach")
    keys = ["element", "own", "far"]
    pairs = probes.where("NOT x_large").join(blocks, keys).where(keep).unionByName(probes.where("x_large").join(blocks.where("NOT y_large"), keys).where(keep))
    return pairs.groupBy(F.col("x_node").alias("x"), F.col("y_node").alias("y")).agg(F.min("x_n").alias("n"), F.min("y_n").alias("m"))


def _derived(pairs: DataFrame, leaders: DataFrame, sets: DataFrame, a: int, b: int) -> DataFrame:
    """Links among the pairs, from the answers of the leaders of x."""
    led = pairs.join(leaders.withColumnRenamed("node", "x"), "x", "left").withColumn("leader", F.coalesce("leader", "x")).withColumn("more", F.coalesce("more", F.lit(0)))
    answers = _shared(led.select("leader", "y").distinct(), sets, "leader", "y")
    open_ = written(led.join(answers, ["leader", "y"]).where(_linked_by(F.col("shared") + F.col("more"), F.col("n"), F.col("m"), a, b)))
    followers = open_.where("x <> leader")
    apart = _joined(followers.select("x", "leader").distinct(), sets, "elements", "x", "leader")
    apart = written(apart.select("x", F.array_except("x_elements", "leader_elements").alias("own"), F.array_except("leader_elements", "x_elements").alias("other")))
    exact = F.col("shared") + F.size(F.array_intersect("own", "y_elements")) - F.size(F.array_intersect("other", "y_elements"))
    derived = _joined(followers.join(apart, "x"), sets, "elements", "y").withColumn("shared", exact).select("x", "y", "n", "m", "shared")
    every = open_.where("x = leader").select("x", "y", "n", "m", "shared").unionByName(derived)
    return written(every.where(_linked_by(F.col("shared"), F.col("n"), F.col("m"), a, b)).select(F.col("x").alias("a"), F.col("y").alias("b")))


def _linked(rows: DataFrame, marked: DataFrame, nodes: DataFrame, a: int, b: int) -> DataFrame | None:
    """Root of every node that isn't its own; None without links."""
    index = _index(marked, nodes, a, b)
    fits = F.expr(f"node <> centre.node AND n * {b} >= centre.n * {a} AND centre.n * {b} >= n * {a} AND n <= centre.reach AND centre.n <= reach")
    stars = index.where(fits).groupBy(F.col("centre.node").alias("centre"), "node").agg(F.min("n").alias("n"), F.min("centre.n").alias("m"))
    stars = _able(stars, nodes, "centre", "node", a, b)
    sets = _sets(rows, nodes, stars.select("node").unionByName(stars.select(F.col("centre").alias("node"))).distinct())
    linked = written(_shared(stars, sets, "centre", "node").where(_linked_by(F.col("shared"), F.col("n"), F.col("m"), a, b)))
    links = linked.select(F.col("centre").alias("a"), F.col("node").alias("b"))
    found = components(links)
    pairs = _able(_meeting(index, found, a, b), nodes, "x", "y", a, b)
    if pairs.isEmpty():
        return found
    near = F.col("shared") / (F.col("n") + F.col("m"))
    leaders = linked.groupBy("node").agg(F.max_by(F.struct(F.col("centre").alias("leader"), (F.col("n") - F.col("shared")).alias("more")), F.struct(near, "centre")).alias("best")).select("node", "best.*")
    rest = pairs.select(F.col("x").alias("node")).unionByName(pairs.select(F.col("y").alias("node"))).distinct().join(sets.select("node"), "node", "left_anti")
    more = _derived(pairs, leaders, sets.unionByName(_sets(rows, nodes, rest)), a, b)
    return found if more.isEmpty() else components(links.unionByName(more))


def classes(docs: DataFrame, similarity: tuple[int, int] = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles and component_id, the smallest id that links lead to."""
    a, b = similarity
    rows = located(docs, id_col, text_col)
    marked = written(_marked(rows, levels(rows), a, b))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("least")
    nodes = marked.where("n > 0").groupBy("low", "high").agg(F.min(F.struct("row", "locator")).alias("first"), F.min("n").alias("n"), F.min("bits").alias("bits"), least)
    nodes = written(nodes.select("low", "high", F.col("first.row").alias("node"), "first.locator", "n", "bits", "least"))
    found = _linked(rows, marked, nodes, a, b)
    if found is None:
        named = nodes.select("low", "high", F.col("least.doc_id").alias("component_id"))
    else:
        rooted = written(nodes.join(found, "node", "left").select("low", "high", "least", F.coalesce("root", "node").alias("root")))
        named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("first")), "root").select("low", "high", F.col("first.doc_id").alias("component_id"))
    some = marked.where("n > 0").join(named, ["low", "high"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return some.unionByName(marked.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
