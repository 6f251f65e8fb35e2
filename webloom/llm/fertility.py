"""Quality rules from tokeniser fertility.

Public vocabularies read every document (white space collapsed to single spaces): characters per
token, share of tokens that are bytes rather than characters, and Shannon entropy (bits) of the
document's token distribution. Bands per language, or per script where the language is unknown,
reject what lies outside. Each distinct word of a batch is encoded once; a document's tokens are
those of its words, so nothing is shuffled and one pass over the text is enough.

Defined cases: null and blank texts have 0 tokens, null measures and are rejected ("empty");
documents of fewer than ``min_tokens`` tokens are judged by no band; a null or unknown language is
judged by the band of its text's script (by entropy alone if the script has none), without letters by
``DEFAULT_BAND``; repeated rows are judged alike;
an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import astuple, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.common import fresh, named, small_batches
from webloom.llm.wordpieces import byte_pieces, frugal, piece_csr, text_slices, TOKENIZERS, words_of

#: Name and file of each vocabulary that measures.
VOCABULARIES = {"pieces": f"{TOKENIZERS}/piece_bpe_32k.model", "bytes": f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken"}
MIN_TOKENS = 64


@dataclass(frozen=True)
class Band:
    """What is kept. least_entropy_share: entropy over the most that so many tokens could have,
    log2(min(tokens, 1024))."""

    least_chars: float
    most_chars: float
    most_bytes: float
    least_entropy_share: float


DEFAULT_BAND = Band(1.2, 8.0, 0.35, 0.45)
#: By language and vocabulary.
BANDS: dict[str, dict[str, Band]] = {
    "en": {"pieces": Band(1.7, 8.0, 0.02, 0.6), "bytes": Band(1.7, 8.0, 0.04, 0.6)},
    "de": {"pieces": Band(1.6, 8.0, 0.02, 0.6), "bytes": Band(1.8, 8.0, 0.12, 0.6)},
    "fr": {"pieces": Band(1.5, 8.0, 0.02, 0.6), "bytes": Band(1.6, 8.0, 0.06, 0.6)},
    "es": {"pieces": Band(1.4, 8.0, 0.02, 0.6), "bytes": Band(1.6, 8.0, 0.15, 0.6)},
}
#: By script, for languages without bands: (first, last code point) of its letters.
SCRIPTS = {"latin": (0x41, 0x24F), "greek": (0x370, 0x3FF), "cyrillic": (0x400, 0x52F), "arabic": (0x600, 0x6FF), "devanagari": (0x900, 0x97F), "indic": (0x980, 0xDFF), "hebrew": (0x590, 0x5FF), "thai": (0xE00, 0xE7F), "kana": (0x3040, 0x30FF), "hangul": (0xAC00, 0xD7A3), "han": (0x4E00, 0x9FFF)}
SCRIPT_BANDS = {
    "latin": Band(1.1, 8.0, 0.35, 0.45),
    "greek": Band(0.4, 8.0, 0.6, 0.4),
    "cyrillic": Band(0.5, 8.0, 0.4, 0.4),
    "arabic": Band(0.4, 8.0, 0.7, 0.4),
    "devanagari": Band(0.3, 8.0, 0.9, 0.3),
    "indic": Band(0.3, 8.0, 1.0, 0.25),
    "hebrew": Band(0.4, 8.0, 0.7, 0.25),
    "thai": Band(0.3, 8.0, 0.9, 0.25),
    "kana": Band(0.3, 8.0, 0.9, 0.25),
    "hangul": Band(0.3, 8.0, 0.9, 0.25),
    "han": Band(0.3, 4.0, 0.9, 0.4),
    "other": Band(0.0, math.inf, 1.0, 0.25),  # neither vocabulary may have the script: entropy alone
}

MEASURES = T.StructType([T.StructField("tokens", T.LongType()), T.StructField("chars_per_token", T.DoubleType()), T.StructField("byte_share", T.DoubleType()), T.StructField("entropy", T.DoubleType())])


def measure(text: pa.Array, vocabularies: list[str]) -> list[tuple[np.ndarray, ...]]:
    """For each vocabulary: tokens, characters per token, byte share, entropy by document."""
    words = words_of(text)
    chars = words.sums(np.fromiter(map(len, words.distinct), np.int64, len(words.distinct)))
    count = np.diff(words.offsets)
    chars = chars + np.maximum(count - 1, 0)  # the single spaces between
    doc = np.repeat(np.arange(words.docs), count)
    out = []
    for vocabulary in vocabularies:
        seen, leading = words, []
        if not vocabulary.endswith(".model"):  # which puts a space before the first word too
            first = words.offsets[:-1][count > 0]
            lead, which = np.unique(words.codes[first], return_inverse=True)
            codes = words.codes.astype(np.int64)
            codes[first] = len(words.distinct) + which
            seen, leading = replace(words, codes=codes), [words.distinct[i] for i in lead]
        starts, ids = piece_csr(vocabulary, words.distinct, leading)
        lengths = np.diff(starts)
        tokens = seen.sums(lengths)
        byte = np.concatenate([[0], np.cumsum(byte_pieces(vocabulary)[ids])])
        byte_tokens = seen.sums(byte[starts[1:]] - byte[starts[:-1]])
        with np.errstate(divide="ignore", invalid="ignore"):
            out.append((tokens, chars / tokens, byte_tokens / tokens, entropies(seen.codes, doc, starts, ids, tokens)))
    return out


def entropies(codes: np.ndarray, doc: np.ndarray, starts: np.ndarray, ids: np.ndarray, tokens: np.ndarray, at_once: int = 1_000_000) -> np.ndarray:
    """Entropy of the ids of each document; documents are in order. log2(n) - sum(c log2 c) / n."""
    total = np.zeros(len(tokens))
    ends = np.cumsum(tokens)
    first_word = np.searchsorted(doc, np.arange(len(tokens) + 1))
    d = 0
    while d < len(tokens):
        upto = max(d + 1, int(np.searchsorted(ends, (ends[d - 1] if d else 0) + at_once, "right")))
        w = codes[first_word[d] : first_word[upto]]
        n = starts[w + 1] - starts[w]
        where = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[w], n)
        key = np.sort(np.repeat(doc[first_word[d] : first_word[upto]], n) << 20 | ids[where])
        if len(key):
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            c = np.diff(np.append(edge, len(key)))
            total += np.bincount(key[edge] >> 20, c * np.log2(c), len(tokens))
        d = upto
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.maximum(np.log2(tokens) - total / tokens, 0.0)


def script_of(text: str) -> str | None:
    """The script that most of the letters of a text are of; "other": one that SCRIPTS hasn't."""
    found = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    counts = {name: int(((found >= a) & (found <= b)).sum()) for name, (a, b) in SCRIPTS.items()}
    points, times = np.unique(found[found > 0x24F], return_counts=True)
    counts["other"] = sum(n for p, n in zip(points.tolist(), times.tolist()) if chr(p).isalpha() and not any(a <= p <= b for a, b in SCRIPTS.values()))
    most = max(counts, key=lambda s: counts[s])
    return most if counts[most] else None


def measurer(vocabularies: dict[str, str]):
    kind = T.StructType([T.StructField("script", T.StringType()), *(T.StructField(v, MEASURES) for v in vocabularies)])

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, lang in batches:
            parts = [measure(part, list(vocabularies.values())) for _, part in text_slices(text)]
            measured = [tuple(map(np.concatenate, zip(*own))) for own in zip(*parts)] or [(np.zeros(0, np.int64), *[np.zeros(0)] * 3)] * len(vocabularies)
            unknown = [x not in BANDS for x in lang.to_pylist()]
            scripts = [script_of(text[i].as_py() or "") if u else None for i, u in enumerate(unknown)]
            fields = [pa.array(scripts, pa.string())]
            for tokens, *rest in measured:
                none = tokens == 0
                fields.append(pa.StructArray.from_arrays([pa.array(tokens), *(pa.array(x, pa.float64(), mask=none) for x in rest)], fields=[pa.field(n, t) for n, t in zip(MEASURES.names, [pa.int64(), *[pa.float64()] * 3])]))
            yield pa.StructArray.from_arrays(fields, names=kind.names)

    return F.arrow_udf(frugal(run), kind)


def band_of(lang, script, vocabulary: str) -> list:
    """The four limits as columns."""
    out = []
    for i, default in enumerate(astuple(DEFAULT_BAND)):
        limit = F.lit(default)
        for name, band in SCRIPT_BANDS.items():
            limit = F.when(script == name, F.lit(astuple(band)[i])).otherwise(limit)
        for name, by in BANDS.items():
            limit = F.when(F.coalesce(lang, F.lit("")) == name, F.lit(astuple(by.get(vocabulary, DEFAULT_BAND))[i])).otherwise(limit)
        out.append(limit)
    return out


def verdict(m, lang, vocabularies: dict[str, str], min_tokens: int):
    """Reasons for which a document is rejected, in order; none if it stays."""
    first = m[next(iter(vocabularies))]["tokens"]
    reasons = [F.when(first == 0, F.lit("empty"))]
    for v in vocabularies:
        x, (least, most, share, entropy) = m[v], band_of(lang, m["script"], v)
        long = x["tokens"] >= min_tokens
        possible = F.log2(F.least(x["tokens"], F.lit(1024)).cast("double"))
        reasons += [
            F.when(long & (x["chars_per_token"] < least), F.lit(f"{v}: few characters a token")),
            F.when(long & (x["chars_per_token"] > most), F.lit(f"{v}: many characters a token")),
            F.when(long & (x["byte_share"] > share), F.lit(f"{v}: bytes")),
            F.when(long & (x["entropy"] < entropy * possible), F.lit(f"{v}: entropy")),
        ]
    return F.array_compact(F.array(*reasons))


def judge(docs: DataFrame, *, vocabularies: dict[str, str] = VOCABULARIES, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """One row a document: doc_id, lang, the measures by vocabulary, keep, reasons."""
    small_batches(docs.sparkSession)
    rows = docs.select(named(docs, "doc_id").alias("doc_id"), named(docs, "lang").cast("string").alias("lang"), named(docs, "text").alias("text"))
    rows = rows.select("doc_id", "lang", measurer(vocabularies)("text", "lang").alias("m"))
    out = rows.withColumn("reasons", verdict(F.col("m"), F.col("lang"), vocabularies, min_tokens))
    flat = [F.col(f"m.{v}.{f}").alias(f"{v}_{f}") for v in vocabularies for f in MEASURES.names]
    return out.select("doc_id", "lang", *flat, (F.size("reasons") == 0).alias("keep"), F.concat_ws("; ", "reasons").alias("reasons"))


def kept(docs: DataFrame, *, vocabularies: dict[str, str] = VOCABULARIES, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """The documents that no rule rejects, with all their columns."""
    small_batches(docs.sparkSession)
    m = fresh(docs, "measures")
    out = docs.withColumn(m, measurer(vocabularies)(named(docs, "text"), named(docs, "lang").cast("string")))
    return out.filter(F.size(verdict(out[m], named(out, "lang").cast("string"), vocabularies, min_tokens)) == 0).select(*(named(out, c) for c in docs.columns))
