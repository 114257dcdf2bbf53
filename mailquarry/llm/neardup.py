"""Near-duplicates by DartMinHash signatures, banded joining and exact verification.

A text is a set of runs of ``SHINGLE`` words (split at ASCII white space, A-Z in lower case), each with a weight. The plane of
weight and rank over every element holds hashed darts, one per unit of area on average, and every dart is dealt to one of
``COORDINATES`` coordinates. The darts below an element's weight hit it; the signature is the hit of lowest rank in every
coordinate. Darts are drawn cell by cell (dyadic in weight and rank) and only up to the rank at which a text of its total
weight has enough of them, so a signature costs about as much as a look at each element. Equal coordinates are as likely
as the weighted Jaccard similarity.

Texts that share a band of coordinates are candidates. In every bucket all members are compared with its centre, the one
that meets most others in all its buckets, and the links (similarity of the whole sets >= ``SIMILARITY``) are joined
into components. Only buckets that still hold several components go on: there the members outside the largest
component are compared with those members of other components that can be similar to them by the sizes of the sets, by
what they can share and by sketches of the signatures (which pass 0.8 but for a chance of 1e-5). So no candidate link between different classes is lost, and no group is compared all to all.

Exact copies are one node from the start. Texts of fewer words have their words as one element; texts without words, also null
and empty ones, equal exact copies only. The smallest id of a class stays (nulls last, equal ids by locator). An empty table
gives no rows. Other columns are ignored. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquarry.llm.arrays import K1, K3, forget, lowered, mix, prefix_hash, slices, span_hash, text_column, utf8, words
from mailquarry.llm.bitmap import bitmap, maybe
from mailquarry.llm.components import components
from mailquarry.llm.exact import located, without
from mailquarry.plans.staging import written

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 4         # a pair of similarity 0.8 shares no band with a chance of 3e-6
COORDINATES = BANDS * ROWS
SIZE_STEP = 1.12            # ratio of successive size classes
SKETCH = 1024               # coordinates of the sketches that tell pairs in mixed buckets apart
SKETCH_ROWS = 16            # texts that are sketched at once
SLICE = 1 << 17             # bytes of text that are signed at once
SURE = 4.5                  # standard deviations by which the sketches of a similar pair may differ more than expected
SMALLEST_RANK = -8          # ranks below 2**-8 are one cell
_UNIT = 2.0 ** -53


def shingles(data: np.ndarray, borders: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and number of occurrences of every distinct run of words, sorted by text and hash."""
    start, stop, text = words(data, borders)
    word = span_hash(prefix_hash(lowered(data)), start, stop)
    n = np.bincount(text, minlength=len(borders) - 1)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    if len(word) >= size:
        run = np.zeros(len(word) - size + 1, np.uint64)
        for j in range(size):
            run += mix(word[j:len(word) - size + 1 + j] + np.array([j + 1], np.uint64) * K3)
        whole = text[size - 1:] == text[:len(text) - size + 1]
        found.append((text[:len(run)][whole], run[whole]))
    short = np.flatnonzero(n[text] < size) if len(word) else np.zeros(0, np.int64)
    if len(short):
        place = short - np.searchsorted(text, text[short])
        part = mix(word[short] + (place + 1).astype(np.uint64) * K3)
        owner, first = np.unique(text[short], return_index=True)
        found.append((owner, np.add.reduceat(part, first)))
    owner, element = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((element, owner))
    owner, element = owner[order], element[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (element[1:] != element[:-1])
    at = np.flatnonzero(new)
    return owner[at], element[at], np.diff(np.append(at, len(owner)))


def _poisson(mean: float) -> np.ndarray:
    """Distribution function of the number of darts in a cell of this area."""
    n = np.arange(int(mean + 12 * np.sqrt(mean) + 12))
    log = n * np.log(mean) - mean - np.concatenate([[0], np.cumsum(np.log(np.maximum(n[1:], 1)))])
    return np.cumsum(np.exp(log))


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)) * _UNIT


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int = COORDINATES) -> np.ndarray:
    """Signature (n x k dart hashes) of ``n`` weighted sets; sets without elements have zeros."""
    total = np.bincount(owner, weight, n)
    out, rank_of = np.zeros((n, k), np.uint64), np.full((n, k), np.inf)
    reach = np.where(total > 0, (k * np.log(k) + 2 * k) / np.maximum(total, 1e-300), 0.0)
    left = total > 0
    while left.any():
        use = np.flatnonzero(left[owner])
        _throw(owner[use], element[use], weight[use], np.where(left, reach, 0), out, rank_of, k)
        left &= np.isinf(rank_of).any(1)
        reach = reach * 2
    return out


def _throw(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, reach: np.ndarray, out: np.ndarray, rank_of: np.ndarray, k: int) -> None:
    """Darts of rank below each set's reach, the earliest per coordinate into the signature."""
    far = reach[owner]
    texts, ids, ranks = [], [], []
    for v in range(max(0, int(np.ceil(np.log2(max(1.0, weight.max()))))) + 1):
        low_w, high_w = (0.0, 1.0) if v == 0 else (2.0 ** (v - 1), 2.0 ** v)
        heavy = np.flatnonzero(weight > low_w)
        for c in range(SMALLEST_RANK, int(np.ceil(np.log2(far[heavy].max()))) + 1):
            low_r, high_r = (0.0, 2.0 ** c) if c == SMALLEST_RANK else (2.0 ** (c - 1), 2.0 ** c)
            own = heavy[far[heavy] > low_r]
            if not len(own):
                continue
            seed = mix(np.array([(v << 8) + c + 128], np.uint64) * K1)
            cell = mix(element[own] ^ seed)
            count = np.searchsorted(_poisson((high_w - low_w) * (high_r - low_r)), _uniform(cell), side="right")
            hit = np.flatnonzero(count)
            dart = np.repeat(hit, count[hit])
            number = np.arange(len(dart)) - np.repeat(np.cumsum(count[hit]) - count[hit], count[hit])
            h = mix(cell[dart] + (number + 1).astype(np.uint64) * K3)
            own = own[dart]
            rank = low_r + (high_r - low_r) * _uniform(h)
            keep = (low_w + (high_w - low_w) * _uniform(mix(h + np.uint64(1))) < weight[own]) & (rank < far[own])
            texts.append(owner[own[keep]])
            ids.append(h[keep])
            ranks.append(rank[keep])
    text, h, rank = np.concatenate(texts), np.concatenate(ids), np.concatenate(ranks)
    place = text * k + (mix(h + np.uint64(2)) % np.uint64(k)).astype(np.int64)
    flat, best = out.reshape(-1), rank_of.reshape(-1)
    np.minimum.at(best, place, rank)
    first = best[place] == rank
    flat[place[first]] = h[first]


def bands(signature: np.ndarray) -> np.ndarray:
    """Hash of every band of every signature, different from band to band."""
    n = len(signature)
    rows = mix(signature.reshape(n, BANDS, ROWS) + np.arange(1, ROWS + 1, dtype=np.uint64) * K3)
    return mix(rows.sum(2) + np.arange(1, BANDS + 1, dtype=np.uint64) * K1).astype(np.int64)


def sketch_limit(similarity: float) -> float:
    """Differing bits up to which the sketches of two texts speak for this similarity: every second coordinate that differs shows."""
    p = (1 - similarity) / 2
    return SKETCH * p + SURE * np.sqrt(SKETCH * p * (1 - p))


def _sketched(sets: DataFrame) -> DataFrame:
    """One bit of each of SKETCH coordinates, as long integers (node, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SKETCH_ROWS):
                part = batch.slice(start, SKETCH_ROWS)
                lists = part.column("elements")
                element = lists.flatten().to_numpy().view(np.uint64)
                owner = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                bits = mix(signatures(owner, element, np.ones(len(element)), part.num_rows, SKETCH)) >> np.uint64(63)
                longs = np.packbits(bits.astype(np.uint8), axis=1).view("<i8")
                out = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * longs.shape[1]), pa.array(longs.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column("node"), out], ["node", "sketch"])

    return sets.select("node", "elements").mapInArrow(run, "node long, sketch array<long>")


def weights(count: np.ndarray, counted: bool) -> np.ndarray:
    """Weight of each element: one, or how often it occurs."""
    return count.astype(np.float64) if counted else np.ones(len(count))


def signed(rows: DataFrame, counted: bool = False) -> DataFrame:
    """Rows (doc_id, text, locator) with the digest of the text as ``th`` and the bands of its signature (none without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                owner, element, count = shingles(*utf8(text_column(part)))
                n = part.num_rows
                hashes = bands(signatures(owner, element, weights(count, counted), n))
                some = np.bincount(owner, minlength=n) > 0
                borders = np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(borders), pa.array(hashes[some].reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("locator"), part.column("th"), lists], ["doc_id", "locator", "th", "bands"])

    keyed = rows.select("doc_id", "locator", digest().alias("th"), "text")
    return keyed.mapInArrow(run, "doc_id long, locator struct<file: string, row: long>, th binary, bands array<long>")


def digest(text: str = "text") -> Column:
    """First 128 bits of the SHA-256 of a text."""
    return F.unhex(F.substring(F.sha2(F.coalesce(F.col(text), F.lit("")), 256), 1, 32))


def _sets(rows: DataFrame, nodes: DataFrame, wanted: DataFrame, n_wanted: int, counted: bool) -> DataFrame:
    """Elements (sorted hashes, repeated by weight if counted) of the wanted nodes."""
    keys = nodes.join(wanted, "node").select("th", "node")
    texts = maybe(rows.select(digest().alias("th"), F.coalesce("text", F.lit("")).alias("text")), "th", bitmap(keys, "th", n_wanted))
    once = texts.groupBy("th").agg(F.min("text").alias("text")).join(keys, "th").select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                owner, element, count = shingles(*utf8(text_column(part)))
                if counted:                              # the j-th occurrence is an element of its own
                    number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    owner, element = np.repeat(owner, count), mix(np.repeat(element, count) + number.astype(np.uint64) * K3)
                borders = np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.ListArray.from_arrays(pa.array(borders), pa.array(element.astype(np.int64)))], ["node", "elements"])

    return written(once.mapInArrow(run, "node long, elements array<long>"))


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets are at least so similar; only the sets of these pairs are shuffled."""
    pairs = written(pairs)
    n = pairs.count()
    side = lambda c: maybe(sets.select(F.col("node").alias(c), F.col("elements").alias(f"{c}_set")), c, bitmap(pairs.select(c), c, n))
    both = F.size(F.array_intersect("a_set", "b_set"))
    ratio = both / (F.size("a_set") + F.size("b_set") - both)
    return pairs.join(side("a"), "a").join(side("b"), "b").where(ratio >= least).select("a", "b")


def classes(docs: DataFrame, similarity: float = SIMILARITY, counted: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (the id that stays), class_size, kept, locator."""
    rows = located(docs, id_col, text_col)
    marked = written(signed(rows, counted))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "locator")).alias("stay")
    nodes = written(marked.groupBy("th").agg(F.count("*").alias("n"), first, F.min("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id()))
    found = _components(rows, nodes, similarity, counted)
    if found is None:
        named = nodes.select("th", "n", "stay", F.col("node").alias("root"))
    else:
        named = nodes.join(found, "node", "left").select("th", "n", "stay", F.coalesce("root", "node").alias("root"))
    named = written(named)
    groups = named.groupBy("root").agg(F.sum("n").alias("class_size"), F.min("stay").alias("stay"))
    answer = named.select("th", "root").join(groups, "root").select("th", "class_size", "stay")
    kept = F.col("stay.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("stay.locator") == F.col("locator"))
    return marked.select("doc_id", "locator", "th").join(answer, "th").select("doc_id", F.col("stay.doc_id").alias("class_id"), "class_size", kept.alias("kept"), "locator")


def _partners(nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """For each node the sizes (node, size, low, high) that the set of a similar text can have.

    Elements that no other of these nodes has can't be shared, which leaves ``shared``; sets of sizes n and m are similar
    only if they share at least (n + m) s / (1 + s). Nodes that can't have a partner are left out. The sets are not shuffled: a
    bitmap tells those of the nodes, and one that it takes in addition can only make an element count as shared.
    """
    own = maybe(sets, "node", bitmap(nodes, "node", nodes.count()))
    single = (own.select("node", F.explode("elements").alias("element")).groupBy("element").agg(F.count("*").alias("k"), F.min("node").alias("node"))
              .where("k = 1").groupBy("node").agg(F.count("*").alias("alone")))
    known = own.select("node", F.size("elements").alias("size")).join(nodes, "node").join(single, "node", "left")
    most = (F.col("size") - F.coalesce("alone", F.lit(0))) * ((1 + similarity) / similarity) - F.col("size")
    return (known.withColumn("low", F.ceil(F.col("size") * similarity - 1e-6)).withColumn("high", F.floor(F.least(most, F.col("size") / similarity) + 1e-6))
            .where("low <= high").select("node", "size", "low", "high"))


def _size_class(size: Column) -> Column:
    return F.floor(F.log(size.cast("double")) / np.log(SIZE_STEP))


def _components(rows: DataFrame, nodes: DataFrame, similarity: float, counted: bool) -> DataFrame | None:
    keys = nodes.select("node", F.explode("bands").alias("bucket"))
    full = written(keys.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    members = written(maybe(keys, "bucket", bitmap(full, "bucket", full.count())).join(full, "bucket"))
    central = members.groupBy("node").agg(F.sum("n").alias("weight"))           # texts near a group's centre meet more others
    centre = members.join(central, "node").groupBy("bucket").agg(F.max_by("node", F.struct("weight", "node")).alias("centre"))
    pairs = members.join(centre, "bucket").where("node <> centre")
    stars = written(pairs.select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")).distinct())
    if stars.isEmpty():
        return None
    ends = written(members.select("node").distinct())
    sets = _sets(rows, nodes, ends, ends.count(), counted)
    links = written(_similar(stars, sets, similarity))
    found = components(links)

    rooted = members if found is None else members.join(found, "node", "left")
    rooted = written(rooted.select("bucket", "node", (F.col("node") if found is None else F.coalesce("root", "node")).alias("root")))
    shares = rooted.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    largest = shares.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("largest"), F.count("*").alias("parts")).where("parts > 1")
    mixed = written(rooted.join(largest.select("bucket", "largest"), "bucket"))
    able = written(_partners(written(mixed.select("node").distinct()), sets, similarity))
    marks = bitmap(able, "node", able.count())
    told = able.join(_sketched(maybe(sets, "node", marks)), "node").join(maybe(nodes.select("node", "bands"), "node", marks), "node")
    sized = mixed.join(told, "node").withColumn("own", _size_class(F.col("size")))
    wide = written(sized.withColumn("other", F.explode(F.sequence(_size_class(F.col("low")), _size_class(F.col("high"))))))
    side = lambda df, tag, own, other: df.select(
        "bucket", F.col("own").alias(own), F.col("other").alias(other), *[F.col(c).alias(f"{tag}_{c}") for c in ("node", "root", "size", "low", "high", "sketch", "bands")])
    differ = sum((F.bit_count(F.col("x_sketch")[i].bitwiseXOR(F.col("y_sketch")[i])) for i in range(SKETCH // 64)), F.lit(0))
    few = side(wide.where("root <> largest"), "x", "first", "second")
    pairs = few.join(side(wide, "y", "second", "first"), ["bucket", "first", "second"]).where(
        "x_root <> y_root AND x_size BETWEEN y_low AND y_high AND y_size BETWEEN x_low AND x_high").where(differ <= sketch_limit(similarity))
    pairs = pairs.where(F.get(F.array_intersect("x_bands", "y_bands"), F.lit(0)) == F.col("bucket"))       # each pair once, in its first bucket
    rest = pairs.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    more = written(_similar(rest, sets, similarity))
    return found if more.isEmpty() else components(links.unionByName(more))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows that stay, one of each class, with all their columns."""
    return without(docs, lambda source: classes(source, similarity).where("NOT kept"))
