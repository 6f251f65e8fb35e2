"""Mixture-controlled packing by deficit round-robin over source queues.

In a round every source that has tokens left earns its quantum: its deficit counter grows by it, the
source sends as many whole tokens of its queue as the counter holds, and the fraction that is left is
carried to the next round, over windows and partitions alike. A source that runs dry loses its counter
and is passed over. The grants, by round and in a round by source, are one stream; it is cut into
windows of exactly ``window`` tokens (the last one has what is left). Quanta are in proportion to the
weights and sum to ``window`` at first; whenever the live sources' quanta have come down to half of it
or less they are doubled, so that a round is always about a window. So until a source is dry, the stream
up to the end of any round has of each source its exact share to within one token, and up to any place
to within one round's quantum.

A source's counter depends on no other source: after it has earned v base quanta it has sent the whole
part of v * quantum. So the round of each token is known from its place in its queue, and the rounds'
places in the stream are sums of grants. What one task or the driver sees is bounded: documents are
cumulated inside buckets of a source, grants inside blocks of BLOCK_ROUNDS rounds, blocks inside groups
of BLOCK_GROUP; the sources' weights, one row a source, are a table; the driver reads one row for each
doubling. Texts are never shuffled.

Defined cases: null or blank texts have no tokens and are not packed; a null source is the queue
""; a null doc_id is packed as null; repeated rows are packed as often as they occur; with ``targets``,
sources that have none go last, in rounds of equal quanta; an empty table gives no rows; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from webloom.llm.common import named, sized, small_batches, stored
from webloom.llm.wordpieces import frugal, piece_counts, text_slices, TOKENIZERS, words_of

WINDOW = 2048
VOCABULARY = f"{TOKENIZERS}/piece_bpe_32k.model"
#: Without given targets a source's weight is its share of tokens to this power: rare sources rise.
ALPHA = 0.7
#: Weights are whole numbers that sum to about this; a share is off by 1e-12 at most.
WEIGHT_UNITS = 10**12
#: Documents of a source to a bucket, about.
BUCKET_DOCS = 20_000
#: Rounds to a block: no more than so many windows of tokens.
BLOCK_ROUNDS = 256
BLOCK_GROUP = 4096
#: Equal rows that are unfolded at once.
COPIES = 10_000

SCHEMA = "window_id long, position int, source string, doc_id long, doc_start int, n_tokens int"


def token_counter(vocabulary: str):
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in batches:
            counts = [np.zeros(0, np.int64)]
            for _, part in text_slices(text):
                words = words_of(part)
                counts.append(words.sums(piece_counts(vocabulary, words.distinct)))
            yield pa.array(np.concatenate(counts), pa.int64())

    return F.arrow_udf(frugal(count), T.LongType())


@dataclass(frozen=True)
class Epochs:
    """From progress[e] base quanta on, which are earned after rounds[e] rounds, a round earns 2**e."""

    progress: tuple[int, ...]
    rounds: tuple[int, ...]

    @classmethod
    def of(cls, halved: dict[int, int]) -> Epochs:
        """halved: e -> the least progress at which the live weight is 2**-e of all or less."""
        progress, rounds = [0], [0]
        for e in range(1, max(halved, default=0) + 1):
            at = min(v for k, v in halved.items() if k >= e)
            more = max(0, -(-(at - progress[-1]) >> (e - 1)) if at > progress[-1] else 0)  # whole rounds
            rounds.append(rounds[-1] + more)
            progress.append(progress[-1] + (more << (e - 1)))
        return cls(tuple(progress), tuple(rounds))

    def round_of(self, v: Column) -> Column:
        """The round (from 1) in which the v-th base quantum (from 1) is earned."""
        out = F
        for e in reversed(range(len(self.rounds))):
            out = out.when(v > self.progress[e], F.shiftright(v - self.progress[e] + ((1 << e) - 1), e) + self.rounds[e])
        return out

    def progress_at(self, r: Column) -> Column:
        """Base quanta earned after round r; after round 0 none."""
        out = F
        for e in reversed(range(len(self.rounds))):
            out = out.when(r > self.rounds[e], F.shiftleft(r - self.rounds[e], e) + self.progress[e])
        return out.otherwise(F.lit(0))


def _whole(x: Column | int) -> Column:
    return (F.lit(x) if isinstance(x, int) else x).cast("decimal(19,0)")


def _floor_div(a: Column, b: Column) -> Column:
    """Whole numbers of up to 38 digits; a long."""
    return F.call_function("div", a, b)


def weighed(size: DataFrame, targets: dict[str, float] | None, alpha: float) -> DataFrame:
    """size (source, tokens) with weight, and phase: 1 for what goes last, else 0."""
    if targets is None:
        raw = size.withColumn("raw", F.pow(F.col("tokens").cast("double"), F.lit(float(alpha))))
    else:
        given = size.sparkSession.createDataFrame([(s, max(float(x), 0.0)) for s, x in targets.items()], "source string, raw double")
        raw = size.join(given, "source", "left").withColumn("raw", F.coalesce("raw", F.lit(0.0)))
    whole = raw.agg(F.sum("raw")).first()[0] or 0.0
    if not whole:
        return raw.select("source", "tokens", F.lit(1).cast("long").alias("weight"), F.lit(0).alias("phase"))
    weight = F.greatest(F.lit(1), F.round(F.col("raw") / whole * WEIGHT_UNITS)).cast("long")
    return raw.select("source", "tokens", F.when(F.col("raw") > 0, weight).otherwise(F.lit(1)).alias("weight"), F.when(F.col("raw") > 0, 0).otherwise(1).alias("phase"))


def schedule(sources: DataFrame, window: int) -> dict[int, tuple[int, int, Epochs]]:
    """phase -> (sum of weights, its last round, Epochs). sources: weighed and stored."""
    out = {}
    for phase, whole in sorted((r.phase, int(r.w)) for r in sources.groupBy("phase").agg(F.sum(_whole(F.col("weight"))).alias("w")).collect()):
        dry = _floor_div(_whole(F.col("tokens")) * F.lit(whole).cast("decimal(18,0)") + _whole(F.col("weight")) * window - 1, _whole(F.col("weight")) * window)
        ends = sources.filter(F.col("phase") == phase).select(dry.alias("v"), "weight").groupBy("v").agg(F.sum("weight").alias("w"))
        live = ends.withColumn("live", F.coalesce(F.sum("w").over(Window.orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        near = F.floor(F.log2(F.lit(float(whole)) / F.col("live"))).cast("int")
        exact = F.when(F.expr("shiftleft(live, near + 1)") <= whole, F.col("near") + 1).when(F.expr("shiftleft(live, near)") > whole, F.col("near") - 1).otherwise(F.col("near"))
        halved = live.filter("live > 0").withColumn("near", near).groupBy(exact.alias("e")).agg(F.min("v").alias("v"))
        epochs = Epochs.of({r.e: r.v for r in halved.collect() if r.e > 0})
        last = live.agg(F.max("v").alias("v")).select(epochs.round_of(F.col("v"))).first()[0]
        out[phase] = (whole, last, epochs)
    return out


def grants(queued: DataFrame, plan: dict[int, tuple[int, int, Epochs]], window: int) -> DataFrame:
    """What each round sends of each document. queued: phase, weight, first (its place in its queue),
    n_tokens, ...; adds round, at (its first token of the grant in the document), n."""

    def of(f) -> Column:
        out, before = None, 0
        for phase, (whole, last, epochs) in plan.items():
            x = f(whole, before, epochs)
            out = x if out is None else F.when(F.col("phase") == phase, x).otherwise(out)
            before += last
        return out

    quantum = _whole(F.col("weight")) * F.lit(window).cast("decimal(9,0)")  # times the sum of weights

    def round_of(token: Column) -> Column:
        return of(lambda whole, before, epochs: epochs.round_of(_floor_div(_whole(token + 1) * F.lit(whole).cast("decimal(18,0)") + quantum - 1, quantum)) + before)

    def sent(r: Column) -> Column:
        return of(lambda whole, before, epochs: _floor_div(_whole(epochs.progress_at(r - before)) * quantum, F.lit(whole).cast("decimal(18,0)")))

    last = F.col("first") + F.col("n_tokens") - 1
    small = of(lambda whole, before, epochs: quantum < whole)  # not a token a round
    rounds = F.when(small, F.array_distinct(F.transform(F.sequence("first", last), round_of))).otherwise(F.sequence(round_of(F.col("first")), round_of(last)))
    each = queued.withColumn("round", F.explode(rounds))
    each = each.withColumn("token", F.greatest("first", sent(F.col("round") - 1))).withColumn("n", F.least(last + 1, sent(F.col("round"))) - F.col("token"))
    return each.filter("n > 0").withColumn("at", F.col("token") - F.col("first"))


def pack(docs: DataFrame, *, targets: dict[str, float] | None = None, window: int = WINDOW, alpha: float = ALPHA, vocabulary: str = VOCABULARY, queue: str = "source") -> DataFrame:
    """One row for each piece of a document in a window: SCHEMA. Queue order: bucket of the
    document's hash, then doc_id."""
    spark = docs.sparkSession
    small_batches(spark)
    counted = docs.select(
        named(docs, "doc_id").cast("long").alias("doc_id"),
        F.coalesce(named(docs, queue).cast("string"), F.lit("")).alias("source"),
        F.xxhash64(named(docs, "text")).alias("h"),
        token_counter(vocabulary)(F.coalesce(named(docs, "text"), F.lit(""))).alias("n_tokens"),
    )
    counted = stored(counted, "pack-counts").filter("n_tokens > 0")
    size = stored(counted.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens")), "pack-sizes")
    most = size.agg(F.count("*").alias("n"), F.max("docs").alias("docs")).first()
    if not most.n:
        return spark.createDataFrame([], SCHEMA)
    sources = stored(weighed(size.select("source", "tokens"), targets, alpha), "pack-sources")
    plan = schedule(sources, window)

    # places in the queues; equal rows count as one of so many copies
    rows = counted.groupBy("source", "doc_id", "h", "n_tokens").agg(F.count("*").alias("copies"))
    bucketed = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "h"), F.lit(max(1, -(-most.docs // BUCKET_DOCS)))).cast("int"))
    tokens = F.col("n_tokens") * F.col("copies")
    starts = (
        counted.groupBy("source", F.pmod(F.xxhash64("doc_id", "h"), F.lit(max(1, -(-most.docs // BUCKET_DOCS)))).cast("int").alias("bucket"))
        .agg(F.sum("n_tokens").alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
        .select("source", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    )
    inside = Window.partitionBy("source", "bucket").orderBy("doc_id", "n_tokens", "h").rowsBetween(Window.unboundedPreceding, 0)
    queued = bucketed.withColumn("upto", F.sum(tokens).over(inside)).join(starts, ["source", "bucket"])
    queued = queued.withColumn("first", F.col("before") + F.col("upto") - tokens)
    some = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long")))
    queued = queued.withColumn("c", some).repartition("source", "doc_id", "h", "c")
    queued = queued.withColumn("c", F.explode(F.sequence(F.col("c"), F.least(F.col("c") + (COPIES - 1), F.col("copies") - 1))))
    queued = queued.select("source", "doc_id", "n_tokens", (F.col("first") + F.col("c") * F.col("n_tokens")).alias("first"))
    queued = queued.join(sized(sources.select("source", "weight", "phase"), most.n), "source")

    pieces = stored(grants(queued, plan, window).select("round", "source", "token", "doc_id", "at", "n"), "pack-grants")

    # places in the stream
    block = F.floor((F.col("round") - 1) / BLOCK_ROUNDS).cast("long")
    blocks = pieces.groupBy(block.alias("block")).agg(F.sum("n").alias("tokens")).withColumn("group", F.floor(F.col("block") / BLOCK_GROUP).cast("long"))
    upto = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = blocks.groupBy("group").agg(F.sum("tokens").alias("t")).select("group", F.coalesce(F.sum("t").over(upto), F.lit(0)).alias("base"))
    upto = Window.partitionBy("group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begin = blocks.join(groups, "group").select("block", (F.col("base") + F.coalesce(F.sum("tokens").over(upto), F.lit(0))).alias("begin"))
    order = Window.partitionBy("block").orderBy("round", "source", "token").rowsBetween(Window.unboundedPreceding, 0)
    placed = pieces.withColumn("block", block).join(begin, "block").withColumn("place", F.col("begin") + F.sum("n").over(order) - F.col("n"))
    w = F.lit(window).cast("long")
    cut = placed.withColumn("window_id", F.explode(F.sequence(_floor_div(F.col("place"), w), _floor_div(F.col("place") + F.col("n") - 1, w))))
    lo, hi = F.greatest(F.col("place"), F.col("window_id") * w), F.least(F.col("place") + F.col("n"), (F.col("window_id") + 1) * w)
    return cut.select("window_id", (lo - F.col("window_id") * w).cast("int").alias("position"), "source", "doc_id", (F.col("at") + lo - F.col("place")).cast("int").alias("doc_start"), (hi - lo).cast("int").alias("n_tokens"))
