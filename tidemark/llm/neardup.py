"""Near-duplicate classes by BagMinHash over multisets of word shingles.

A text is the multiset of its shingles of five words (a shorter one: of all its words). BagMinHash draws, for every
shingle, Poisson points in (time, weight, signature component); a text keeps, for each component, its earliest point
whose weight coordinate lies below the shingle's multiplicity. Two texts agree in a component with probability equal to
their weighted Jaccard similarity. The weight axis is discretised at whole numbers and laid out in dyadic intervals
[0,1), [1,2), [2,4), [4,8), ..: each interval is one Poisson process of the rate of its width, drawn in time order from
a seed of (shingle, interval), and it stops as soon as its next point is later than every component already held; an
interval that the multiplicity cuts is thinned. So heavy shingles cost a logarithm of their weight, and equal shingles
draw equal points everywhere.

Signatures are banded; texts that share a band are candidates, and every reported link is verified by exact multiset
overlap (sum of minima over sum of maxima):

1. exact copies fold into one vertex before anything is compared;
2. each bucket's leader, the member that meets most texts over all bands, is compared with the others (in chunks of
   bounded size, so that a hot bucket is spread);
3. buckets whose members are not yet in one class are united where they share members, dealt into random chunks, each
   compared in full, which joins nearly all that belong together; then every member outside the largest class is
   compared with all, in blocks of bounded size that emit only links that join two classes; nothing is capped;
4. connected components of the verified links are the classes.

Before shingles are compared, signatures are: of 96 components a pair of similarity 0.8 shares 77 on average and fewer
than ``NEAR`` (57) with probability 1e-6, so shingles travel only for texts that have a partner by signature. Texts are not
shuffled; those that shingles are wanted of are found by a second scan behind a bitmap of bounded size.

With 24 bands of 4 components a pair of similarity 0.8 shares no band with probability 3e-6.

Defined results: null and empty texts are one class (equal multisets); a class is named by its least doc_id (nulls
last); repeated rows fall in one class; an empty table gives no rows. Other columns, whatever their names and types, are
ignored by ``near_duplicates``; ``keep_one`` returns them as they are, and of rows that agree in id and text the one whose
columns come first as JSON.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.blocks import U64, blocks, mix, words
from tidemark.llm.presence import bitmap, marked, possible
from tidemark.session import cut, drop

SHINGLE = 5
BANDS, ROWS = 24, 4
SIMILAR = 0.8
#: Members of a bucket that one task compares at a time.
CHUNK = 128
#: Equal signature components, of all, that two texts need before their shingles are compared: 57 of 96.
NEAR = 0.59
_GOLD = U64(0x9E3779B97F4A7C15)


def shingles(raw: np.ndarray, off: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, multiplicity) of a block of at most 4,096 rows, sorted by row and shingle (52-bit hashes)."""
    h, _, _, woff = words(raw, off, False)
    n = np.diff(woff)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    row = np.repeat(np.arange(len(n)), count)
    at = np.repeat(woff[:-1] - np.cumsum(count) + count, count) + np.arange(count.sum())
    s = np.zeros(len(at), U64)
    size = np.minimum(n, width)[row]
    for k in range(width):
        inside = size > k
        s = np.where(inside, s * U64(0xD1342543DE82EF95) + h[np.minimum(at + k, max(0, len(h) - 1))] if len(h) else s, s)
    key = np.sort((mix(s + size.astype(U64)) >> U64(12)) | (row.astype(U64) << U64(52)))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    return (key[first] >> U64(52)).astype(np.int64), key[first] & U64((1 << 52) - 1), np.diff(np.append(first, len(key)))


def bag_min_hash(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """Signatures (n x m) of n texts: the times of the earliest points, infinity for an empty text."""
    h = np.full(n * m, np.inf)
    level, levels = 0, []
    left = np.arange(len(row))
    while len(left):  # dyadic intervals [0,1), [1,2), [2,4), ..: those that start below the weight
        low, size = (0, 1) if level == 0 else (1 << (level - 1), 1 << (level - 1))
        left = left[weight[left] > low]
        levels.append((left, low, size))
        level += 1
    who = np.concatenate([x for x, _, _ in levels]) if levels else left
    low = np.concatenate([np.full(len(x), a, np.float64) for x, a, _ in levels]) if levels else np.empty(0)
    size = np.concatenate([np.full(len(x), b, np.float64) for x, _, b in levels]) if levels else np.empty(0)
    tag = np.concatenate([np.full(len(x), k, U64) for k, (x, _, _) in enumerate(levels)]) if levels else np.empty(0, U64)
    seed = mix(shingle[who] * _GOLD + tag)
    doc, limit, time = row[who] * m, weight[who].astype(np.float64), np.zeros(len(who))
    whole = limit >= low + size
    while len(seed):
        seed = seed + _GOLD
        a = mix(seed)
        b = mix(a ^ U64(0x94D049BB133111EB))
        time = time - np.log1p(-(a >> U64(11)).astype(np.float64) * 2.0**-53) / (m * size)
        component = ((b & U64(0xFFFFFFFF)) * U64(m) >> U64(32)).astype(np.int64)
        inside = whole | (low + (b >> U64(32)).astype(np.float64) * 2.0**-32 * size < limit)
        np.minimum.at(h, (doc + component)[inside], time[inside])
        going = time < h.reshape(n, m).max(axis=1)[doc // m]
        seed, doc, limit, time, low, size, whole = (x[going] for x in (seed, doc, limit, time, low, size, whole))
    return h.reshape(n, m)


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each text."""
    bits = np.ascontiguousarray(signature).view(U64)
    keys = np.zeros((len(bits), bits.shape[1] // rows), U64) + np.arange(bits.shape[1] // rows, dtype=U64)[None, :]
    for r in range(rows):
        keys = mix(keys * U64(0xD1342543DE82EF95) + bits[:, r::rows])
    return keys.astype(np.int64)


def _sign(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for part, raw, off in blocks(batches):
        row, shingle, weight = shingles(raw, off)
        n = part.num_rows
        keys = band_keys(bag_min_hash(row, shingle, weight, n, bands * rows), rows)
        some = np.bincount(row, minlength=n) > 0
        ptr = np.concatenate([[0], np.cumsum(np.where(some, bands, 0))])
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(keys[some].ravel(), pa.int64()))], names=["doc_id", "text_key", "bands"])


def units(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A multiset as a set: (row, hash of shingle and copy number), so that minima and maxima become intersection and union."""
    copy = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
    return np.repeat(row, weight), mix(np.repeat(shingle, weight) * _GOLD + copy.astype(U64)).astype(np.int64)


def _expand(batches: Iterator[pa.RecordBatch], m: int) -> Iterator[pa.RecordBatch]:
    """(text_key, signature in 32 bits a component, units) from (text_key, text)."""
    for part, raw, off in blocks(batches):
        row, shingle, weight = shingles(raw, off)
        times = bag_min_hash(row, shingle, weight, part.num_rows, m)
        short = (mix(np.ascontiguousarray(times).view(U64)) >> U64(32)).astype(np.uint32).view(np.int32)
        row, unit = units(row, shingle, weight)
        ptr = np.searchsorted(row, np.arange(part.num_rows + 1))
        signature = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * m, pa.int32()), pa.array(short.ravel()))
        yield pa.RecordBatch.from_arrays([part.column(0), signature, pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(unit, pa.int64()))], names=["text_key", "signature", "units"])


def _near_members(table: pa.Table, near: float) -> pa.Table:
    """Members of a block that agree with one of another class by signature. Rows: family, i, j, side, vertex, class, signature."""
    n = table.num_rows
    sign = _lists(table, "signature")[1].reshape(n, -1)
    vertex, group, side = (table.column(c).to_numpy() for c in ("vertex", "class", "side"))
    equal = np.zeros((n, n), np.int16)
    for column in sign.T:
        equal += column[:, None] == column[None, :]
    met = (equal >= near * sign.shape[1]) & (group[:, None] != group[None, :]) & ((side[:, None] != side[None, :]) | (side[:, None] == 0)) & (vertex[:, None] != vertex[None, :])
    return table.select(["family", "i", "j", "side", "vertex", "class"]).filter(pa.array(met.any(axis=1)))


def _lists(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    col = table.column(name).combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = col.chunk(0)
    off = col.offsets.to_numpy()
    return off - off[0], col.flatten().to_numpy()


def _verify_star(table: pa.Table, similar: float) -> pa.Table:
    """One leader and a chunk of members: the members similar to it. Rows: leader, chunk, vertex, units."""
    leader, vertex = table.column("leader").to_numpy(), table.column("vertex").to_numpy()
    off, unit = _lists(table, "units")
    head = int(np.flatnonzero(vertex == leader)[0])
    own = np.sort(unit[off[head] : off[head + 1]])
    at = np.searchsorted(own, unit)
    both = np.concatenate([[0], np.cumsum(own[np.minimum(at, len(own) - 1)] == unit)]) if len(own) else np.zeros(len(unit) + 1, np.int64)
    shared, size = both[off[1:]] - both[off[:-1]], np.diff(off)
    ok = (shared >= similar * (size + len(own) - shared)) & (vertex != leader)
    return pa.table({"a": leader[ok], "b": vertex[ok]})


def _verify_block(table: pa.Table, similar: float, columns: int = 1 << 13) -> pa.Table:
    """Members of one side against all (side 0), or of side 1 against side 2; links that join two classes only. Rows: side, vertex, class, units."""
    vertex, group, side = (table.column(c).to_numpy() for c in ("vertex", "class", "side"))
    off, unit = _lists(table, "units")
    n, size = len(vertex), np.diff(off)
    row, (distinct, col) = np.repeat(np.arange(n), size), np.unique(unit, return_inverse=True)
    shared = np.zeros((n, n), np.float32)
    for lo in range(0, len(distinct), columns):
        part = (col >= lo) & (col < lo + columns)
        x = np.zeros((n, min(columns, len(distinct) - lo)), np.float32)
        x[row[part], col[part] - lo] = 1
        shared += x @ x.T
    a, b = np.nonzero(np.triu(shared.astype(np.float64) >= similar * (size[:, None] + size[None, :] - shared), 1))
    top: dict[int, int] = {}

    def root(x: int) -> int:
        while top.get(x, x) != x:
            x = top[x]
        return x

    links = []
    for p, q in zip(a.tolist(), b.tolist(), strict=True):
        if side[p] == side[q] != 0 or vertex[p] == vertex[q]:
            continue  # that pair belongs to another block
        if (r := root(int(group[p]))) != (s := root(int(group[q]))):
            top[max(r, s)] = min(r, s)
            links.append((int(vertex[p]), int(vertex[q])))
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(vertex, class) of every vertex of the links (a, b): alternating large-star and small-star rounds, lineage cut each round.

    A round's table goes as soon as the next one is written; the last round is the one that changes no link.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).withColumn("m", F.least("u", "m"))
        joined = both.join(least, both["a"] == least["u"])
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return moved.where("a <> b").distinct()

    now = cut(edges.select("a", "b").where("a <> b").distinct(), name)
    while True:
        before, now = now, cut(star(star(now, True), False), name)
        # both are sets, so they are equal if they have the same size and one lies in the other
        same = now.count() == before.count() and now.join(before, ["a", "b"], "left_anti").isEmpty()
        drop(before)
        if same:
            break
    root = now.groupBy(F.col("a").alias("vertex")).agg(F.min("b").alias("class"))
    out = cut(root.unionByName(root.select(F.col("class").alias("vertex"), "class").distinct()), name)
    drop(now)
    return out


def _open(buckets: DataFrame, classes: DataFrame) -> DataFrame:
    """(family, vertex): the members of buckets that hold more than one class; buckets that share members are one family,
    so that what many bands say is looked at once."""
    placed = cut(buckets.select("bucket", "vertex").join(classes, "vertex", "left").withColumn("class", F.coalesce("class", "vertex")), "placed")
    mixed = placed.groupBy("bucket").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.min("vertex").alias("a")).where("lo <> hi").select("bucket", "a")
    met = placed.join(mixed, "bucket").select("a", F.col("vertex").alias("b"))
    united = components(met, "families")
    found = cut(united.select(F.col("class").alias("family"), "vertex"), "families")
    drop(placed, united)
    return found


def _dealt(families: DataFrame, classes: DataFrame, chunk: int) -> DataFrame:
    """(family, vertex, class, k, chunk) of the families that still hold more than one class, dealt into k chunks."""
    placed = families.join(classes, "vertex", "left").withColumn("class", F.coalesce("class", "vertex"))
    mixed = placed.groupBy("family").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.expr(f"cast(ceil(count(*) / {chunk}) as int)").alias("k")).where("lo <> hi").select("family", "k")
    return placed.join(mixed, "family").withColumn("chunk", F.expr("pmod(hash(vertex), k)"))


class _Bags:
    """Signatures and shingles of the texts that share a bucket with others; shingles travel for those asked for alone."""

    def __init__(self, source: DataFrame, wanted: DataFrame, m: int, similar: float, near: float):
        self.similar, self.near, self.m = similar, near, m
        likely = possible(source, wanted, "text_key", "first_id").select("text_key", "text")
        found = likely.mapInArrow(lambda it: _expand(it, m), "text_key string, signature array<int>, units array<long>")
        # joined and told apart by the same key: one shuffle
        self.table = cut(wanted.select("text_key", "vertex").join(found, "text_key").dropDuplicates(["text_key"]).select("vertex", "signature", "units"), "bags")

    def signatures(self) -> DataFrame:
        return self.table.select("vertex", "signature")

    def units(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the units of their vertex."""
        return rows.join(possible(self.table.select("vertex", "units"), rows, "vertex"), "vertex")

    def stars(self, pairs: DataFrame, chunk: int) -> DataFrame:
        """Verified links (a, b) of the pairs (leader, vertex)."""
        near, need = self.near, self.near * self.m
        own, other = self.signatures(), self.signatures().select(F.col("vertex").alias("leader"), F.col("signature").alias("leading"))
        alike = pairs.join(own, "vertex").join(other, "leader").where(F.size(F.filter(F.zip_with("signature", "leading", lambda x, y: x == y), lambda x: x)) >= need)
        alike = cut(alike.select("leader", "vertex"), "alike")
        degree = alike.groupBy("leader").agg(F.count("*").alias("d"))
        dealt = alike.join(degree, "leader").withColumn("chunk", F.expr(f"pmod(hash(vertex), cast(ceil(d / {chunk}) as int))")).drop("d")
        heads = dealt.select("leader", "chunk", F.col("leader").alias("vertex")).distinct()
        stars = cut(dealt.select("leader", "chunk", "vertex").unionByName(heads), "stars")
        similar = self.similar
        links = self.units(stars).select("leader", "chunk", "vertex", "units").groupBy("leader", "chunk").applyInArrow(lambda t: _verify_star(t, similar), "a long, b long")
        links = cut(links, "links")
        drop(alike, stars)
        return links

    def blocks(self, rows: DataFrame) -> DataFrame:
        """Verified links (a, b) that join classes, from members (family, i, j, side, vertex, class) compared by block."""
        near, similar = self.near, self.similar
        kinds = "family long, i int, j int, side int, vertex long, class long"
        likely = cut(rows.join(self.signatures(), "vertex").groupBy("family", "i", "j").applyInArrow(lambda t: _near_members(t, near), kinds), "likely")
        links = cut(self.units(likely).groupBy("family", "i", "j").applyInArrow(lambda t: _verify_block(t, similar), "a long, b long"), "links")
        drop(likely)
        return links


def text_classes(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, similar: float = SIMILAR, chunk: int = CHUNK, near: float = NEAR) -> tuple[DataFrame, DataFrame]:
    """(signed: doc_id, text_key; classes: text_key, doc_id of the text's first document, class and its first document)."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("text_key", F.md5("text"))
    signed = cut(source.select("doc_id", "text_key", "text").mapInArrow(lambda it: _sign(it, bands, rows), "doc_id long, text_key string, bands array<long>"), "signed")
    vertices = cut(signed.groupBy("text_key").agg(F.min("doc_id").alias("first_id"), F.first("bands").alias("bands")).withColumn("vertex", F.monotonically_increasing_id()), "vertices")
    member = vertices.select("vertex", F.explode("bands").alias("bucket"))
    size = member.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    met = cut(member.join(size, "bucket"), "met")
    # a text that meets most others over all bands is nearest to the middle of its group: it leads its buckets
    central = met.groupBy("vertex").agg(F.sum("n").alias("central"))
    leader = met.join(central, "vertex").groupBy("bucket").agg(F.max_by("vertex", F.struct("central", "vertex")).alias("leader"))
    buckets = cut(met.select("bucket", "vertex").join(leader, "bucket"), "buckets")
    drop(met)
    # stars: each bucket's leader against the others, once for all bands that say the same
    wanted = cut(buckets.select("vertex").distinct().join(vertices.select("vertex", "text_key", "first_id"), "vertex"), "wanted")
    bags = _Bags(source.withColumnRenamed("doc_id", "first_id"), wanted, bands * rows, similar, near)
    stars = bags.stars(buckets.where("vertex <> leader").select("leader", "vertex").distinct(), chunk)
    # buckets whose members are not yet one class: random chunks of them in full, which joins nearly all that belong together
    found = components(stars, "classes")
    families = _open(buckets, found)
    drop(buckets, wanted)
    dealt = _dealt(families, found, 2 * chunk).select("family", F.lit(0).alias("i"), F.col("chunk").alias("j"), F.lit(0).alias("side"), "vertex", "class")
    links = cut(stars.unionByName(bags.blocks(dealt)), "links")
    drop(found)
    # what is still apart: every member outside a family's largest class against all members of the family, in blocks
    joined = components(links, "joined")
    apart = cut(_dealt(families, joined, chunk), "apart")
    size = apart.groupBy("family", "class").agg(F.count("*").alias("c"))
    main = size.groupBy("family").agg(F.max_by("class", F.struct("c", "class")).alias("main"), F.expr(f"cast(ceil((sum(c) - max(c)) / {chunk}) as int)").alias("kf"))
    spread = apart.join(main, "family")
    minor = spread.where("class <> main").withColumn("i", F.expr("pmod(hash(vertex, 1), kf)")).select("family", "i", F.explode(F.expr("sequence(0, k - 1)")).alias("j"), F.lit(1).alias("side"), "vertex", "class")
    every = spread.select("family", F.explode(F.expr("sequence(0, kf - 1)")).alias("i"), F.col("chunk").alias("j"), F.lit(2).alias("side"), "vertex", "class")
    final = components(links.unionByName(bags.blocks(minor.unionByName(every))), "final")
    named = vertices.select("vertex", "text_key", "first_id").join(final, "vertex", "left").withColumn("class", F.coalesce("class", "vertex"))
    named = cut(named.select("text_key", "first_id", "class"), "named")
    drop(vertices, stars, links, families, joined, apart, bags.table, final)
    first = named.groupBy("class").agg(F.min("first_id").alias("class_id"), F.count("*").alias("n_texts"))
    return signed.select("doc_id", "text_key"), named.join(first, "class")


def near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class), n_texts (distinct texts in the class): one row per document."""
    signed, classes = text_classes(docs, **how)
    return signed.join(classes.select("text_key", "class_id", "n_texts"), "text_key").select("doc_id", "class_id", "n_texts")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """One document of each class, with all its columns: that of the least doc_id.

    Rows that surely stay are read straight from ``docs``; only those that a bitmap of the others' keys may hold are
    shuffled and looked at.
    """
    signed, classes = text_classes(docs, **how)
    best = classes.groupBy("class").agg(F.min(F.struct(F.col("first_id").isNull().alias("z"), "first_id", "text_key")).alias("b")).select(F.col("b.first_id").alias("doc_id"), F.col("b.text_key").alias("text_key"), F.lit(True).alias("best"))
    told = signed.groupBy("doc_id", "text_key").agg(F.count("*").alias("rows")).join(best, (signed["text_key"] == best["text_key"]) & signed["doc_id"].eqNullSafe(best["doc_id"]), "left")
    told = cut(told.select(signed["doc_id"], signed["text_key"], "rows", F.coalesce("best", F.lit(False)).alias("best")), "told")
    doubted = told.where("not best or rows > 1")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_key"))
    split = marked(whole, bitmap(doubted, "doc_id", "text_key"), "doubt", "doc_id", "text_key")
    looked = split.where("doubt").select("doc", F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    kept = looked.join(told.where("best"), (F.col("key") == F.col("text_key")) & F.col("id").eqNullSafe(F.col("doc_id")))
    one = kept.groupBy("id", "key").agg(F.min_by("doc", F.to_json("doc")).alias("doc"))
    return split.where("not doubt").select("doc.*").unionByName(one.select("doc.*"))
