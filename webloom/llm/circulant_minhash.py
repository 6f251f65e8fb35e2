"""Near-duplicates by circulant MinHash.

Two permutations make the whole signature (C-MinHash, Li & Li 2021): sigma scatters a document's
shingles over [0, UNIVERSE), pi is one permutation of it, and coordinate k is the least
pi[(sigma(x) + k) mod UNIVERSE], that is pi shifted circularly by k. BANDS bands of ROWS coordinates
give candidates; the exact Jaccard similarity of their shingle sets decides.

Groups are the connected components of the pairs that share a band and reach the threshold. Copies of
a text are one node from the start, the text's least doc_id, and only that row is banded. Buckets are resolved in
few rounds. In the first every member is compared with the bucket's least document. In STAR_ROUNDS more each
member that is not in its bucket's largest component is compared with one document of that. Then, in the buckets
whose members are still not in one component, all members are compared with those outside the largest one: the
bucket is cut into blocks by hash, of BLOCK_DOCS documents and BLOCK_SHINGLES shingles about, and two blocks at a
time are brought to a task with their sets, whose common shingles are counted by a product of matrices. So a set
travels once for each block that it meets, not for each document; and as what is in one component needs no
comparison, the result is that of comparing all candidates. No bucket is brought together in one task: least
documents and components are aggregates that combine before they move, and the rows of a hot bucket, text or
centre are spread. In the first rounds, sets of which one has less than ``threshold`` of the other's size can't
reach it and are not compared.

Shingles are runs of SHINGLE lower-case words (a shorter text is one shingle), as 64-bit hashes.

Defined cases: a null text is a duplicate of nothing; blank texts are copies of each other; rows with
the same doc_id are one document where their texts are the same, and where they are not the document
belongs to the groups of all of them, which thereby are one; of a group the least doc_id stays; an
empty table gives no rows; rows with a null doc_id belong to no group and stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.common import MAX_BROADCAST_ROWS, named, sized, small_batches, spread, stored
from webloom.llm.wordpieces import encode_runs, flat_bytes, frugal, spans_of, text_slices, _SPACE

SHINGLE = 3
BANDS = 40
ROWS = 4
UNIVERSE = 1 << 20
THRESHOLD = 0.5
STAR_ROUNDS = 2
BLOCK_DOCS = 512
BLOCK_SHINGLES = 1_000_000
#: Pairs of a document, at least, for which its shingle set is sent to several tasks.
HOT_PAIRS = 10_000
#: Edges that one task may join into components; beyond it the components are iterated over the cluster.
MAX_LOCAL_EDGES = 3_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SIGMA = np.uint64(0xD6E8FEB86659FD93)  # odd: a permutation of the 64-bit hashes


def shingles(text: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the shingle hashes of document d, repeats included."""
    raw, offsets = flat_bytes(text)
    inside = ~_SPACE[raw]
    starts, ends = spans_of(inside, offsets)
    encoded = encode_runs(raw[inside], ends - starts)
    lower = pc.utf8_lower(encoded.dictionary).to_numpy(zero_copy_only=False)
    distinct = np.fromiter((xxhash.xxh64_intdigest(w) for w in lower), np.uint64, len(lower))
    words = distinct[np.asarray(encoded.indices)]
    first = np.searchsorted(starts, offsets)
    return roll(words, first, width)


def roll(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    count = np.diff(first)
    out = np.where(count > 0, np.maximum(count - width + 1, 1), 0)
    offsets = np.concatenate([[0], np.cumsum(out)])
    at = np.arange(offsets[-1]) + np.repeat(first[:-1] - offsets[:-1], out)
    end = np.repeat(first[1:], out)
    h = np.zeros(len(at), np.uint64)
    for i in range(width):
        there = at + i < end
        word = np.where(there, words[np.minimum(at + i, max(len(words) - 1, 0))], np.uint64(0)) if len(words) else h
        h = (h ^ word) * _MIX
        h ^= h >> np.uint64(29)
    return h, offsets


def pi(size: int, universe: int = UNIVERSE, seed: int = 5) -> np.ndarray:
    """The permutation, going on from its start again, so that shifts are slices."""
    p = np.random.default_rng(seed).permutation(universe).astype(np.int32)
    return np.concatenate([p, p[:size]])


def signatures(hashes: np.ndarray, offsets: np.ndarray, circle: np.ndarray, size: int, universe: int = UNIVERSE, at_once: int = 20_000) -> np.ndarray:
    """One row of ``size`` coordinates a document; universe where it has no shingle."""
    shift = np.uint64(64 - int(universe).bit_length() + 1)
    place = (hashes * _SIGMA >> shift).astype(np.int64)
    rows = np.lib.stride_tricks.sliding_window_view(circle, size)  # row p: pi shifted by 0, 1, ... at p
    out = np.full((len(offsets) - 1, size), universe, np.int32)
    d, n = 0, len(offsets) - 1
    while d < n:
        upto = max(d + 1, int(np.searchsorted(offsets, offsets[d] + at_once, "right")) - 1)
        for lo in range(int(offsets[d]), int(offsets[upto]), at_once):  # one very long text in parts
            hi = min(lo + at_once, int(offsets[upto]))
            own = np.flatnonzero((offsets[d + 1 : upto + 1] > lo) & (offsets[d:upto] < hi) & (offsets[d + 1 : upto + 1] > offsets[d:upto])) + d
            if len(own):
                least = np.minimum.reduceat(rows[place[lo:hi]], np.maximum(offsets[own] - lo, 0), axis=0)
                out[own] = np.minimum(out[own], least)
        d = upto
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band, with the band's number mixed in."""
    parts = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _SIGMA, parts.shape[:2]).copy()
    for i in range(rows):
        h = (h ^ parts[:, :, i]) * _MIX
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def _bander(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        circle = pi(bands * rows)
        for text in batches:
            keys, some = np.zeros((0, bands), np.int64), np.zeros(0, bool)
            for _, part in text_slices(text):
                hashes, offsets = shingles(part, width)
                keys = np.concatenate([keys, band_keys(signatures(hashes, offsets, circle, bands * rows), bands, rows)])
                some = np.concatenate([some, np.diff(offsets) > 0])
            ends = np.concatenate([[0], np.cumsum(np.where(some, bands, 0))]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[some].ravel()))

    return F.arrow_udf(frugal(run), T.ArrayType(T.LongType()))


def _set_maker(width: int):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in batches:
            sets = [np.zeros(0, np.uint64)]
            for _, part in text_slices(text):
                hashes, offsets = shingles(part, width)
                sets += (np.unique(hashes[a:b]) for a, b in zip(offsets, offsets[1:]))
            ends = np.cumsum([len(s) for s in sets]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))

    return F.arrow_udf(frugal(run), T.ArrayType(T.LongType()))


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component) for every node of the edges a, b."""
    n = edges.count()
    if n <= MAX_LOCAL_EDGES:
        return edges.select("a", "b").coalesce(1).mapInArrow(_join_locally, "node long, label long")
    return _iterate(edges)


def _join_locally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [np.stack([b.column("a").to_numpy(), b.column("b").to_numpy()]) for b in batches]
    if not parts:
        return
    nodes, flat = np.unique(np.concatenate(parts, axis=1), return_inverse=True)
    a, b = flat.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:  # nodes are in order, so the least index is the least node
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (label[a], label[b], a, b):
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "label"])


def _iterate(edges: DataFrame) -> DataFrame:
    """Large-star and small-star steps (Kiveris et al. 2014) until nothing changes."""
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    e, before = edges.select("a", "b").distinct(), None
    while True:
        least = stored(both(e).groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n")), "near-least")
        large = spread(both(e).filter("b > a"), least, "a", "n", "b").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        m = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(m, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m")), F.struct(F.col("b").alias("a"), F.col("m")))).alias("x")).select(F.col("x.a").alias("a"), F.col("x.m").alias("b")).filter("a != b").distinct()
        e = stored(small, "near-stars")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    labels = e.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), "label")
    return labels.union(labels.select(F.col("label").alias("node"), "label").distinct())


def groups(docs: DataFrame, *, threshold: float = THRESHOLD, width: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, stars: int = STAR_ROUNDS, block: int = BLOCK_DOCS) -> DataFrame:
    """doc_id, group_id for every document that has a duplicate; group_id is the least doc_id."""
    small_batches(docs.sparkSession)
    texts = docs.select(named(docs, "doc_id").cast("long").alias("doc_id"), named(docs, "text").alias("text")).filter("text is not null and doc_id is not null")
    # a copy is one by the exact text; node: the least doc_id with that text
    hashed = texts.select("doc_id", F.sha2(F.when(F.trim(F.translate("text", "\t\n\r\f\x0b", "     ")) == "", F.lit("")).otherwise(F.col("text")).cast("binary"), 256).alias("h"), _bander(width, bands, rows)("text").alias("keys"))
    signed = stored(hashed.withColumn("h", F.unhex("h")), "near-signatures")
    own = stored(signed.groupBy("h", "doc_id").agg(F.count("*").alias("times")), "near-texts")
    copied = stored(own.groupBy("h").agg(F.min("doc_id").alias("node"), F.count("*").alias("docs")).filter("docs > 1"), "near-copied")
    copies = stored(spread(own.select("h", "doc_id"), copied, "h", "docs", "doc_id").select("h", "doc_id", "node"), "near-copies")
    repeated = not own.filter("times > 1").isEmpty()
    first = signed.join(copies.filter("doc_id != node").select("doc_id", "h"), ["doc_id", "h"], "left_anti")
    first = first.dropDuplicates(["doc_id", "h"]) if repeated else first

    member = first.select(F.col("doc_id").alias("doc"), F.explode("keys").alias("key"))
    keys = member.groupBy("key").agg(F.min("doc").alias("centre"), F.max("doc").alias("most"), F.count("*").alias("n"))
    keys = stored(keys.filter("centre != most").select("key", "centre", "n"), "near-keys")
    members = stored(spread(member, keys, "key", "n", "doc").select("key", "doc", "centre"), "near-members")
    sets = _sets(texts, members.select(F.col("doc").alias("doc_id")).distinct(), width, repeated)

    # texts of one document are in one component
    several = own.groupBy("doc_id").agg(F.count("*").alias("texts")).filter("texts > 1").select("doc_id")
    found = stored(copies.filter("doc_id != node").join(several, "doc_id", "left_semi").select(F.col("node").alias("a"), F.col("doc_id").alias("b")), "near-bridges")
    sizes = sets.groupBy("doc_id").agg(F.min(F.size("s")).alias("least"), F.max(F.size("s")).alias("most"))
    sizes = stored(sizes, "near-sizes")
    alive = members.filter("doc != centre").select("key", "doc").join(sizes.select(F.col("doc_id").alias("doc"), F.col("most").cast("long").alias("size")), "doc")
    alive, pairs, seen, r = stored(alive, "near-alive"), members.filter("doc != centre").select(F.col("centre").alias("a"), F.col("doc").alias("b")), None, 0
    for r in range(stars + 1):
        new = pairs.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")}).dropDuplicates(["lo", "hi"])
        new = new if seen is None else new.join(seen, ["lo", "hi"], "left_anti")
        new = stored(_of_like_sizes(new, sizes, threshold).select("a", "b", "lo", "hi"), f"near-pairs{r}")
        seen = new.select("lo", "hi") if seen is None else seen.unionByName(new.select("lo", "hi"))
        checked = stored(_verify(new.select("a", "b"), sets), f"near-checked{r}")
        found = found.unionByName(checked.filter(F.col("j") >= threshold).select("a", "b"))
        labels = stored(components(found), f"near-labels{r}")
        alive = _open(alive, labels, r)
        if alive is None:
            break
        pairs = alive.filter("label != top").select(F.col("head").alias("a"), F.col("doc").alias("b"))
    else:
        found = found.unionByName(stored(_in_blocks(alive, sets, threshold, block), "near-blocks"))
        labels = stored(components(found), "near-labels")

    per_node = stored(copied.groupBy("node").agg(F.sum("docs").alias("docs")).join(labels, "node", "left").select("node", "docs", F.coalesce("label", "node").alias("group_id")), "near-nodes")
    of_copies = spread(copies.select("doc_id", "node"), per_node, "node", "docs", "doc_id").select("doc_id", "group_id")
    return of_copies.unionByName(labels.select(F.col("node").alias("doc_id"), F.col("label").alias("group_id"))).distinct()


def _sets(texts: DataFrame, wanted: DataFrame, width: int, repeated: bool) -> DataFrame:
    """The shingle sets of each wanted document's texts: 64-bit hashes."""
    wanted = stored(wanted, "near-wanted")
    some = texts.join(sized(wanted, wanted.count()), "doc_id", "left_semi")
    some = some.dropDuplicates(["doc_id", "text"]) if repeated else some
    return stored(some.select("doc_id", _set_maker(width)("text").alias("s")), "near-sets")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; the texts had a shingle each."""
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, j. pairs are stored. b is in few pairs, but a may be in many: then its set goes to as many
    tasks as its pairs ask for."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / HOT_PAIRS).cast("int").alias("parts")).filter("parts > 1")
    a = sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb"))
    n, on = parts.count(), ["a"]
    if n:
        hot = sized(stored(parts, "near-hot"), n)
        salt = F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")), F.lit(0)).cast("int")
        pairs = pairs.join(hot, "a", "left").select("a", "b", salt.alias("salt"))
        a = a.join(hot, "a", "left").select("a", "sa", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("salt"))
        on = ["a", "salt"]
    met = pairs.join(b, "b").join(a, on)
    return met.select("a", "b", jaccard(F.col("sa"), F.col("sb")).alias("j")).groupBy("a", "b").agg(F.max("j").alias("j"))


def _of_like_sizes(pairs: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """Without pairs whose sets are too unlike in size."""
    a = sizes.select(F.col("doc_id").alias("a"), F.col("least").alias("la"), F.col("most").alias("ma"))
    b = sizes.select(F.col("doc_id").alias("b"), F.col("least").alias("lb"), F.col("most").alias("mb"))
    met = pairs.join(b, "b").join(a, "a")
    return met.filter((F.col("ma") >= threshold * F.col("lb")) & (F.col("mb") >= threshold * F.col("la")))


def _open(alive: DataFrame, labels: DataFrame, r: int) -> DataFrame | None:
    """Members of the buckets that are not yet in one component: key, doc, size, label; of the bucket n, shingles,
    top (its largest component) and head (a document of that). None if there is none. Of buckets with the
    same members one goes on."""
    labelled = alive.select("key", "doc", "size").join(labels.withColumnRenamed("node", "doc"), "doc", "left").select("key", "doc", "size", F.coalesce("label", "doc").alias("label"))
    marks = {f"x{i}": F.xxhash64("doc", F.lit(i)) for i in (1, 2)}
    per = labelled.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"), F.min_by("doc", F.xxhash64("doc", F.lit(r))).alias("head"), *(F.bit_xor(m).alias(k) for k, m in marks.items()))
    per = per.groupBy("key").agg(F.sum("n").alias("n"), F.sum("shingles").alias("shingles"), F.max(F.struct("n", "label", "head")).alias("top"), F.count("*").alias("labels"), *(F.bit_xor(k).alias(k) for k in marks))
    per = per.filter("labels > 1").groupBy("n", *marks).agg(F.min(F.struct("key", "shingles", "top")).alias("b"))
    per = stored(per.select("b.key", "n", "b.shingles", F.col("b.top.label").alias("top"), F.col("b.top.head").alias("head")), f"near-open{r}")
    if per.isEmpty():
        return None
    return stored(spread(labelled, per, "key", "n", "doc"), f"near-going{r}")


def _in_blocks(alive: DataFrame, sets: DataFrame, threshold: float, block: int) -> DataFrame:
    """a, b of different components that reach the threshold, of all members of a bucket and those outside its
    largest component. Tile (i, j) has the latter of block i and the former of block j."""
    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")
    member = alive.withColumn("blocks", blocks).withColumn("own", own)
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    tile = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    outside = F.when(F.col("label") != F.col("top"), F.transform(every, lambda j: tile(F.col("own"), j)))
    tiles = F.array_distinct(F.concat(F.transform(every, lambda i: tile(i, F.col("own"))), F.coalesce(outside, F.array().cast("array<struct<i:int,j:int>>"))))
    member = member.select("key", "doc", "label", F.explode(tiles).alias("t")).select("key", "doc", "label", "t.i", "t.j")
    whole = member.join(sets.withColumnRenamed("doc_id", "doc"), "doc").groupBy("key", "i", "j").agg(F.collect_list(F.struct("doc", "label", "s")).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("m").flatten()
            doc, label = (flat.field(c).to_numpy() for c in ("doc", "label"))
            size = pc.list_value_length(flat.field("s")).to_numpy(zero_copy_only=False)
            values = flat.field("s").flatten().to_numpy()
            ends = np.cumsum(pc.list_value_length(batch.column("m")).to_numpy(zero_copy_only=False))
            at, upto = np.concatenate([[0], np.cumsum(size)]), 0
            found = [np.zeros((2, 0), np.int64)]
            for end in ends.tolist():
                a, b = similar(values[at[upto] : at[end]], size[upto:end], threshold)
                a, b = a + upto, b + upto
                other = (label[a] != label[b]) & (doc[a] != doc[b])
                found.append(np.stack([doc[a[other]], doc[b[other]]]))
                upto = end
            out = np.concatenate(found, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1])], names=["a", "b"])

    return whole.select("m").mapInArrow(frugal(run), "a long, b long").distinct()


def similar(values: np.ndarray, size: np.ndarray, threshold: float, at_once: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets that reach the threshold; the sets lie one after another in values."""
    n = len(size)
    _, which, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = times > 1  # what one set alone has is in no intersection
    member, column = np.repeat(np.arange(n), size)[shared[which]], (np.cumsum(shared) - 1)[which[shared[which]]]
    order = np.argsort(column, kind="stable")
    member, column = member[order], column[order]
    common = np.zeros((n, n), np.float64)
    for lo in range(0, int(shared.sum()), at_once):
        a, b = np.searchsorted(column, [lo, lo + at_once])
        m = np.zeros((n, at_once), np.float32)
        m[member[a:b], column[a:b] - lo] = 1
        common += m @ m.T
    with np.errstate(divide="ignore", invalid="ignore"):
        j = common / (size[:, None] + size[None, :] - common)
    return np.nonzero(np.triu(j >= threshold, 1))


def kept(docs: DataFrame, **options) -> DataFrame:
    """docs without the documents of a group but its first; rows that repeat a doc_id stay or go
    together."""
    rest = stored(groups(docs, **options).filter("doc_id != group_id").select("doc_id").distinct(), "near-dropped")
    n = rest.count()
    ids = rest.withColumnRenamed("doc_id", "_gone")
    return docs.join(sized(ids, n, MAX_BROADCAST_ROWS), named(docs, "doc_id").cast("long") == ids["_gone"], "left_anti")
