"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents of SHARD_BYTES at most. Its text is its sequence of words (runs of letters and
digits, lower case), as symbols of the benchmark's vocabulary; words that no test phrase has can be
part of no match and, with document ends, become separators, and stretches between separators that
are shorter than the shortest phrase hold no match and are left out. A stretch of more than SHARD_WORDS
words is cut into overlapping ones, so a shard's memory is bounded whatever the benchmark's words and
however long a document is. Over that text the shard builds
a suffix array (prefix doubling), its Burrows-Wheeler transform, a wavelet matrix with rank
directories, and suffix positions at every SAMPLE-th place and at stretch starts. All test phrases
(every run of PHRASE words of a benchmark item; a shorter item whole, if it has MIN_PHRASE words) are
searched backwards at once, occurrences are located by walking to a sampled position, and overlapping
or touching occurrences merge into removal spans, in characters of the document.

Texts are neither shuffled nor collected. The benchmark goes to the workers in parts of at most
MAX_PHRASE_BYTES of item text; a larger benchmark takes several passes, whose occurrences are merged
by the numbers of their words, as those of one pass are, so that the spans are the same.

Defined cases: null and empty texts have no spans and pass unchanged; a null benchmark text has no
phrase; an item with a null item_id is searched but not named; repeated items and phrases count once and all their item_ids are named; without a phrase
nothing is removed; an empty table gives no rows; a document of which only white space is left is
dropped by ``cleaned``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.common import fresh, named, small_batches
from webloom.llm.wordpieces import flat_bytes, frugal, spans_of, text_slices

PHRASE = 8
MIN_PHRASE = 4
SAMPLE = 8
#: Bytes of text to a shard, at most (a longer document is one).
SHARD_BYTES = 2_000_000
#: Words of stretches to an index, about.
SHARD_WORDS = 400_000
MAX_PHRASE_BYTES = 8_000_000

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

#: start, end: characters; first, last: numbers of the words.
_SPAN = T.StructType([T.StructField(n, T.IntegerType()) for n in ("start", "end", "first", "last")])
SPANS = T.StructType([T.StructField("spans", T.ArrayType(_SPAN)), T.StructField("items", T.ArrayType(T.LongType()))])


def word_spans(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, document offsets, word starts, word ends)."""
    raw, offsets = flat_bytes(text)
    starts, ends = spans_of(_LETTER[raw], offsets)
    return raw, offsets, starts, ends


def encoded_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.DictionaryArray:
    bounds = np.zeros(2 * len(starts) + 1, np.int64)
    bounds[1::2] = starts
    bounds[2::2] = ends
    if len(starts):
        bounds[0] = starts[0]
    everything = pa.LargeStringArray.from_buffers(2 * len(starts), pa.py_buffer(bounds), pa.py_buffer(raw))
    return everything.take(pa.array(np.arange(1, 2 * len(starts), 2))).dictionary_encode()


@dataclass(frozen=True)
class Phrases:
    """Distinct test phrases, as rows of symbols 1.. of the vocabulary, by length."""

    vocabulary: pa.Array
    by_length: dict[int, np.ndarray]
    items: dict[int, list[list[int]]]

    @property
    def shortest(self) -> int:
        return min(self.by_length)

    @property
    def longest(self) -> int:
        return max(self.by_length)


def phrases_of(items: list[tuple[int, str | None]], phrase: int = PHRASE, min_phrase: int = MIN_PHRASE) -> Phrases | None:
    raw, offsets, starts, ends = word_spans(pa.array([t for _, t in items], pa.string()))
    if not len(starts):
        return None
    encoded = encoded_words(raw, starts, ends)
    vocabulary, symbol = np.unique(pc.utf8_lower(encoded.dictionary).to_numpy(zero_copy_only=False).astype(object), return_inverse=True)
    words = symbol[np.asarray(encoded.indices)] + 1
    first = np.searchsorted(starts, offsets)
    of: dict[tuple[int, ...], set[int]] = {}
    for (item, _), a, b in zip(items, first, first[1:]):
        n = min(phrase, b - a)
        if n >= min(min_phrase, phrase):
            for i in range(a, b - n + 1):
                of.setdefault(tuple(words[i : i + n].tolist()), set()).update([] if item is None else [item])
    if not of:
        return None
    by: dict[int, list[tuple[int, ...]]] = {}
    for p in sorted(of):
        by.setdefault(len(p), []).append(p)
    return Phrases(pa.array(vocabulary, pa.large_string()), {n: np.array(p) for n, p in by.items()}, {n: [sorted(of[x]) for x in p] for n, p in by.items()})


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Of a text of symbols whose zeros are separators, each another, less than all symbols and in the
    order of their places; the last symbol is a separator. Prefix doubling over what is yet equal."""
    n = len(text)
    bits = int(text.max()).bit_length() if n else 1
    h = max(1, min(4, 62 // max(bits, 1)))
    key = text.astype(np.int64)
    open_ = text > 0
    for i in range(1, h):
        shifted = np.zeros(n, np.int64)
        shifted[: n - i] = text[i:]
        shifted[~open_] = 0
        key = key << bits | shifted
        open_ = open_ & (shifted > 0)  # no separator among the symbols so far
    order = np.argsort(key, kind="stable")  # ties that meet a separator: by place
    edge = np.concatenate([[True], key[order[1:]] != key[order[:-1]]]) if n else np.zeros(0, bool)
    edge |= ~open_[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(edge, np.arange(n), 0))
    while True:
        size = np.diff(np.append(np.flatnonzero(edge), n))
        wide = np.repeat(size > 1, size)
        where = np.flatnonzero(wide)
        if not len(where):
            return order
        suffix = order[where]
        second = rank[suffix + h]
        inner = np.lexsort((second, rank[suffix]))
        suffix, second = suffix[inner], second[inner]
        group = rank[suffix]
        order[where] = suffix
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])])
        edge[where] = new
        rank[suffix] = where[np.maximum.accumulate(np.where(new, np.arange(len(where)), 0))]
        h *= 2


class BitRank:
    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)])
        self.words = packed.view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.zeros = len(bits) - int(self.before[-1])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        w = i >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray):
        self.bits = max(1, int(symbols.max()).bit_length()) if len(symbols) else 1
        self.levels, s = [], symbols
        for level in reversed(range(self.bits)):
            one = (s >> level & 1).astype(bool)
            self.levels.append(BitRank(one))
            s = np.concatenate([s[~one], s[one]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol[j] is among the first i[j]."""
        lo = np.zeros_like(i)
        for level, b in zip(reversed(range(self.bits)), self.levels):
            one = (symbol >> level & 1).astype(bool)
            l1, i1 = b.ones(lo), b.ones(i)
            lo, i = np.where(one, b.zeros + l1, lo - l1), np.where(one, b.zeros + i1, i - i1)
        return i - lo

    def step(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at i[j], how often it is before)."""
        symbol, lo = np.zeros_like(i), np.zeros_like(i)
        for b in self.levels:
            one = b.get(i)
            l1, i1 = b.ones(lo), b.ones(i)
            lo, i = np.where(one, b.zeros + l1, lo - l1), np.where(one, b.zeros + i1, i - i1)
            symbol = symbol << 1 | one
        return symbol, i - lo


class FMIndex:
    """Of a text as suffix_array takes it, with a separator before its first symbol too."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        order = suffix_array(text)
        self.bwt = WaveletMatrix(text[order - 1])
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=int(text.max()) + 1))])
        kept = (order % sample == 0) | (text[order - 1] == 0)
        self.sampled = BitRank(kept)
        self.places = order[kept]
        self.size = len(text)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix array intervals [lo, hi) of the rows of phrases."""
        n = len(phrases)
        lo, hi = np.zeros(n, np.int64), np.full(n, self.size, np.int64)
        alive = np.arange(n)
        for j in reversed(range(phrases.shape[1])):
            c = phrases[alive, j]
            known = c < len(self.less) - 1
            lo[alive[~known]] = hi[alive[~known]] = 0
            alive, c = alive[known], c[known]
            lo[alive] = self.less[c] + self.bwt.rank(c, lo[alive])
            hi[alive] = self.less[c] + self.bwt.rank(c, hi[alive])
            alive = alive[lo[alive] < hi[alive]]
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of the suffixes in these rows of the suffix array."""
        out, steps, todo, at = np.zeros_like(rows), 0, np.arange(len(rows)), rows.copy()
        while len(todo):
            here = self.sampled.get(at)
            out[todo[here]] = self.places[self.sampled.ones(at[here])] + steps
            todo, at = todo[~here], at[~here]
            symbol, before = self.bwt.step(at)
            at = self.less[symbol] + before
            steps += 1
        return out


def find(text: pa.Array, phrases: Phrases) -> tuple[np.ndarray, ...]:
    """(document, start, end, first word, last word, items) of the merged spans, in bytes and in words of
    the document, by document and place."""
    raw, offsets, starts, ends = word_spans(text)
    none = (np.zeros(0, np.int64),) * 5 + ([],)
    if not len(starts):
        return none
    encoded = encoded_words(raw, starts, ends)
    symbol = pc.fill_null(pc.index_in(pc.utf8_lower(encoded.dictionary), phrases.vocabulary), -1).to_numpy() + 1
    words = symbol[np.asarray(encoded.indices)]
    del encoded
    first = np.searchsorted(starts, offsets)
    a, b = spans_of(words > 0, first)  # stretches, inside documents
    some = b - a >= phrases.shortest
    a, b = a[some], b[some]
    if not len(a):
        return none
    hits = []
    for lo, hi in shards_of(a, b, phrases.longest):
        hits += occurrences(words, lo, hi, phrases)
    if not hits:
        return none
    hits.sort()
    merged: list[list] = []
    for w, last, (n, p) in hits:
        d = int(np.searchsorted(first, w, "right")) - 1
        if merged and merged[-1][0] == d and w <= merged[-1][2] + 1:
            merged[-1][2] = max(merged[-1][2], last)
            merged[-1][3].update(phrases.items[n][p])
        else:
            merged.append([d, w, last, set(phrases.items[n][p])])
    doc, w, last = (np.array([m[i] for m in merged]) for i in range(3))
    return doc, starts[w] - offsets[doc], ends[last] - offsets[doc], w - first[doc], last - first[doc], [sorted(m[3]) for m in merged]


def shards_of(a: np.ndarray, b: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The stretches [a, b) in groups of about SHARD_WORDS words; longer ones are cut so that every
    run of ``longest`` words is whole in one piece."""
    count = np.maximum(1, -(-(b - a) // SHARD_WORDS))
    k = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    lo = np.repeat(a, count) + k * SHARD_WORDS
    hi = np.minimum(lo + SHARD_WORDS + longest - 1, np.repeat(b, count))
    upto, i = np.cumsum(hi - lo), 0
    while i < len(lo):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + SHARD_WORDS, "right")))
        yield lo[i:j], hi[i:j]
        i = j


def occurrences(words: np.ndarray, a: np.ndarray, b: np.ndarray, phrases: Phrases) -> list[tuple[int, int, tuple[int, int]]]:
    """(first word, last word, (length, number) of the phrase) of all that an index over the stretches finds."""
    # a separator, then stretch and separator in turn
    length = b - a + 1
    at = np.cumsum(length) - length + 1
    code = np.zeros(int(length.sum()) + 1, np.int32)
    origin = np.zeros(len(code), np.int64)
    inner = np.arange(int((b - a).sum())) - np.repeat(np.cumsum(b - a) - (b - a), b - a)
    place, source = inner + np.repeat(at, b - a), inner + np.repeat(a, b - a)
    code[place], origin[place] = words[source], source
    del place, source, inner
    index = FMIndex(code)
    hits = []
    for n, rows in phrases.by_length.items():
        lo, hi = index.search(rows)
        count = hi - lo
        which = np.repeat(np.arange(len(rows)), count)
        row = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        word = origin[index.locate(row)]
        hits += [(w, w + n - 1, (n, p)) for w, p in zip(word.tolist(), which.tolist())]
    return hits


def _finder(phrases):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in batches:
            out: list = [None] * len(text)
            for first, shard in text_slices(text, SHARD_BYTES):
                doc, start, end, w, last, items = find(shard, phrases.value)
                for i in np.unique(doc).tolist():
                    raw = np.frombuffer(shard[i].as_py().encode(), np.uint8)
                    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # characters before a byte
                    own = np.flatnonzero(doc == i)
                    out[first + i] = {"spans": [{"start": int(chars[start[k]]), "end": int(chars[end[k]]), "first": int(w[k]), "last": int(last[k])} for k in own], "items": sorted(set().union(*(items[k] for k in own)))}
            yield pa.array(out, pa.struct([("spans", pa.list_(pa.struct([(n, pa.int32()) for n in _SPAN.names]))), ("items", pa.list_(pa.int64()))]))

    return F.arrow_udf(frugal(run), SPANS).asNondeterministic()  # else a filter on it calls it once more


def _merge(spans: Column) -> Column:
    """One sorted list of spans from those of several passes: what overlaps or touches is one."""
    kind = T.ArrayType(_SPAN)

    def step(acc: Column, s: Column) -> Column:
        top = F.element_at(acc, -1)
        both = F.struct(top["start"].alias("start"), F.greatest(top["end"], s["end"]).alias("end"), top["first"].alias("first"), F.greatest(top["last"], s["last"]).alias("last"))
        return F.when((F.size(acc) > 0) & (top["last"] + 1 >= s["first"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(both))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast(kind), step)


def marked(docs: DataFrame, benchmark: DataFrame, name: str, *, phrase: int = PHRASE, min_phrase: int = MIN_PHRASE, max_bytes: int = MAX_PHRASE_BYTES) -> DataFrame:
    """docs with a column of SPANS, null where there is none."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(named(benchmark, "item_id").cast("long").alias("i"), named(benchmark, "text").alias("t")).filter("t is not null").distinct()
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    passes = -(-size // max_bytes)
    found = []
    for p in range(passes):
        part = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == p)
        phrases = phrases_of(sorted(((r.i, r.t) for r in part.collect()), key=lambda x: (x[0] is None, x)), phrase, min_phrase)
        if phrases is not None:
            found.append(_finder(spark.sparkContext.broadcast(phrases)))
    text = named(docs, "text")
    if not found:
        return docs.withColumn(name, F.lit(None).cast(SPANS))
    if len(found) == 1:
        return docs.withColumn(name, found[0](text))
    names = [f"{name}_{i}" for i in range(len(found))]
    out = docs.withColumns({n: f(text) for n, f in zip(names, found)})
    spans = _merge(F.flatten(F.array(*(F.coalesce(out[n]["spans"], F.array()) for n in names))))
    ids = F.array_sort(F.array_distinct(F.flatten(F.array(*(F.coalesce(out[n]["items"], F.array().cast("array<long>")) for n in names)))))
    return out.withColumn(name, F.when(F.size(spans) > 0, F.struct(spans.alias("spans"), ids.alias("items")))).drop(*names)


def _without(text: Column, spans: Column) -> Column:
    """The text between the spans."""
    starts = F.concat(F.array(F.lit(0)), spans["end"])
    ends = F.concat(spans["start"], F.array(F.char_length(text)))
    return F.array_join(F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda g: F.substring(text, g["s"] + 1, g["e"] - g["s"])), "")


def removals(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row for each contaminated document: doc_id, spans, items, and the text that is left."""
    rows = marked(docs.select(named(docs, "doc_id").alias("doc_id"), named(docs, "text").alias("text")), benchmark, "found", **options).filter("found is not null")
    spans = F.transform("found.spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return rows.select("doc_id", spans.alias("spans"), F.col("found.items").alias("items"), _without(F.col("text"), F.col("found.spans")).alias("text"))


def cleaned(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the spans, n_chars anew where a text changed; emptied documents go."""
    found, changed = fresh(docs, "found"), fresh(docs, "changed")
    rows = marked(docs, benchmark, found, **options)
    rows = rows.withColumn(changed, F.when(rows[found].isNotNull(), _without(named(rows, "text"), rows[found]["spans"])))
    new = {"text": F.coalesce(rows[changed], named(rows, "text")), "n_chars": F.when(rows[changed].isNull(), named(rows, "n_chars")).otherwise(F.char_length(rows[changed])).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return rows.filter(rows[changed].isNull() | rows[changed].rlike(r"\S")).select(*((new[c].alias(c) if new.get(c) is not None else named(rows, c)) for c in docs.columns))
