"""Token counts without token ids.

Texts are split into pre-tokens in the JVM; a byte-pair vocabulary never merges across them. Each row's
pre-tokens become frequencies where the row is. The number of pieces of each distinct pre-token of the
corpus is counted once and joined to the documents' pre-token frequencies; the products are summed.

The join has two ways for every frequency. The most frequent pre-tokens, HEAD of them and HEAD_BYTES
of text at most, are broadcast: they are the bulk of all frequencies and would be hot keys. What is left is
summed by document and pre-token and joined by shuffle, however many distinct pre-tokens there are.

Defined cases: null, empty and blank-free texts count what they hold (null and empty: 0); rows that
repeat a doc_id are counted together; a null doc_id is a group of its own; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.common import named, small_batches, stored
from webloom.llm.wordpieces import frugal, PATTERN, tiktoken_model, TOKENIZERS

VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
HEAD = 200_000
HEAD_BYTES = 16_000_000
#: A longer pre-token is never broadcast; it can't be frequent for its share of the bytes.
LONG = 4096
#: Steps of frequency in which the head is chosen, to a doubling.
STEPS = 16
#: (?U): white space as Unicode has it.
JAVA_PATTERN = "(?U)" + PATTERN


def piece_counter(vocabulary: str):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = tiktoken_model(vocabulary)
        for words in batches:
            yield pa.array(np.fromiter((len(model.encode_ordinary(w)) for w in words.to_pylist()), np.int32, len(words)))

    return F.arrow_udf(frugal(run), T.IntegerType())


COUNTED = T.ArrayType(T.StructType([T.StructField("w", T.StringType()), T.StructField("n", T.LongType())]))


def frequencies(pieces: pa.Array) -> pa.Array:
    """Of each list of strings its distinct ones with their numbers."""
    size = pc.fill_null(pc.list_value_length(pieces), 0).to_numpy(zero_copy_only=False)
    flat = pieces.flatten().dictionary_encode()
    width = max(1, len(flat.dictionary))
    key, n = np.unique(np.repeat(np.arange(len(pieces)), size) * width + flat.indices.to_numpy(), return_counts=True)
    ends = np.searchsorted(key, np.arange(len(pieces) + 1) * width).astype(np.int32)
    words = flat.dictionary.take(pa.array(key % width))
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([words.cast(pa.string()), pa.array(n.astype(np.int64))], names=["w", "n"]))


def counter():
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pieces in batches:
            yield frequencies(pieces)

    return F.arrow_udf(frugal(run), COUNTED).asNondeterministic()  # else what Spark filters before an explode calls it once more


def count_tokens(docs: DataFrame, *, vocabulary: str = VOCABULARY, head: int = HEAD, head_bytes: int = HEAD_BYTES) -> DataFrame:
    """doc_id, n_tokens."""
    small_batches(docs.sparkSession)
    pieces = F.regexp_extract_all(named(docs, "text"), F.lit(JAVA_PATTERN), F.lit(0))
    rows = docs.select(named(docs, "doc_id").alias("doc_id"), counter()(pieces).alias("f"))
    words = rows.select(F.explode("f").alias("x")).groupBy("x.w").agg(F.sum("x.n").alias("n"))
    counted = stored(words.withColumn("p", piece_counter(vocabulary)("w")), "token-words")
    step = F.when(F.octet_length("w") <= LONG, F.floor(F.log2("n") * STEPS).cast("int"))
    least, total, size = None, 0, 0
    for r in counted.groupBy(step.alias("step")).agg(F.count("*").alias("c"), F.sum(F.octet_length("w")).alias("b")).filter("step is not null").orderBy(F.desc("step")).collect():
        total, size = total + r.c, size + r.b
        if total > head or size > head_bytes:
            break
        least = r.step
    chosen = F.coalesce(step >= least, F.lit(False)) if least is not None else F.lit(False)
    frequent = F.broadcast(counted.filter(chosen).select("w", F.col("p").alias("known")))
    each = rows.select("doc_id", F.explode_outer("f").alias("x")).select("doc_id", "x.w", "x.n").join(frequent, "w", "left")
    # what the head has counts under a key that is no pre-token (it has a digit after a sign), spread as the join is by key
    none = F.concat(F.lit("\x00"), F.pmod(F.xxhash64("doc_id"), F.lit(1000)).cast("string"))
    rare = F.coalesce(F.when(F.col("known").isNull(), F.col("w")), none)
    freq = each.groupBy("doc_id", rare.alias("w")).agg(F.sum(F.col("known") * F.col("n")).alias("known"), F.sum("n").alias("n"))
    tail = counted.filter(~chosen)
    summed = freq.join(tail.select("w", "p"), "w", "left").select("doc_id", (F.coalesce("known", F.lit(0)) + F.coalesce(F.col("p") * F.col("n"), F.lit(0))).alias("t"))
    return summed.groupBy("doc_id").agg(F.sum("t").alias("n_tokens"))
