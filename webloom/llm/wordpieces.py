"""Words of an Arrow batch as codes of its distinct words, and what vocabularies make of each
distinct word. The tokeniser runs once per distinct word of a batch; documents only add up."""

from __future__ import annotations

import base64
import ctypes
import functools
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TOKENIZERS = "/opt/tokenizers"


@dataclass(frozen=True)
class Words:
    """codes[offsets[d]:offsets[d+1]] are the words of document d, as indices of distinct."""

    codes: np.ndarray
    offsets: np.ndarray
    distinct: list[str]

    @property
    def docs(self) -> int:
        return len(self.offsets) - 1

    def sums(self, per_distinct: np.ndarray) -> np.ndarray:
        """Sum over each document's words of a number given per distinct word."""
        total = np.concatenate([[0], np.cumsum(per_distinct[self.codes], dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


def flat_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array, nulls as empty, without a copy."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = pc.fill_null(text.cast(pa.large_string()), "")
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    raw = text.buffers()[2]
    if not len(text) or raw is None:
        return np.zeros(0, np.uint8), np.zeros(len(text) + 1, np.int64)
    return np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


#: Bytes of text that a worker takes at once: its memory doesn't follow the size of batches.
SLICE_BYTES = 4_000_000


def text_slices(text: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first document, some documents of about ``most`` bytes at most); a longer text is alone."""
    size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    d = 0
    while d < len(text):
        upto = max(d + 1, int(np.searchsorted(size, size[d] + most, "right")) - 1)
        yield d, text.slice(d, upto - d)
        d = upto


def settle() -> None:
    """Give freed memory back to the system: a worker lives on and has neighbours."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def frugal(run):
    """An Arrow iterator function that settles after every batch."""

    def tidy(batches):
        for batch in batches:
            yield batch
            del batch
            settle()

    @functools.wraps(run)
    def wrapped(batches):
        yield from run(tidy(batches))
        settle()

    return wrapped


def spans_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; no run goes on into the next document."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    cut = offsets[1:-1]
    cut = cut[cut < len(inside)]
    starts[cut] |= inside[cut]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cut = cut[cut > 0] - 1
    ends[cut] |= inside[cut]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def words_of(text: pa.Array) -> Words:
    """Words between ASCII white space; a null text has none."""
    raw, offsets = flat_bytes(text)
    inside = ~_SPACE[raw]
    starts, ends = spans_of(inside, offsets)
    encoded = encode_runs(raw[inside], ends - starts)
    return Words(np.asarray(encoded.indices), np.searchsorted(starts, offsets), encoded.dictionary.to_numpy(zero_copy_only=False).tolist())


def encode_runs(data: np.ndarray, lengths: np.ndarray) -> pa.DictionaryArray:
    """Dictionary-encode strings that lie one after another in data."""
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()


@functools.lru_cache(maxsize=4)
def sentencepiece_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.lru_cache(maxsize=4)
def tiktoken_model(path: str, pattern: str | None = None):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern or PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Pre-tokens of the byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encode_words(vocabulary: str, words: list[str]) -> list[list[int]]:
    """Pieces of each word as it stands inside a text, after one space."""
    if vocabulary.endswith(".model"):  # puts the space itself
        return sentencepiece_model(vocabulary).encode(words, num_threads=1)
    model = tiktoken_model(vocabulary)
    return [model.encode_ordinary(" " + w) for w in words]


def piece_csr(vocabulary: str, words: list[str], leading: list[str] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ids): pieces of word w are ids[starts[w]:starts[w+1]]. After the words come those that
    a byte-level text begins with: no space is before them."""
    pieces = encode_words(vocabulary, words) if words else []
    if leading:
        pieces += tiktoken_model(vocabulary).encode_ordinary_batch(list(leading), num_threads=1)
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    starts = np.concatenate([[0], np.cumsum(lengths)])
    return starts, np.fromiter(itertools.chain.from_iterable(pieces), np.int64, int(starts[-1]))


@functools.lru_cache(maxsize=4)
def byte_pieces(vocabulary: str) -> np.ndarray:
    """For each id, whether it stands for bytes that are no whole character."""
    if vocabulary.endswith(".model"):
        model = sentencepiece_model(vocabulary)
        return np.array([model.is_byte(i) for i in range(model.get_piece_size())])
    model = tiktoken_model(vocabulary)
    out = np.zeros(model.n_vocab, dtype=bool)
    for i in range(model.n_vocab):
        try:
            model.decode_single_token_bytes(i).decode()
        except UnicodeDecodeError:
            out[i] = True
        except KeyError:
            pass
    return out


_COUNTS: dict[str, dict[str, int]] = {}
_MOST_REMEMBERED = 150_000


def piece_counts(vocabulary: str, words: list[str]) -> np.ndarray:
    """Number of pieces of each word. A worker remembers what it has counted, up to a bound on
    its memory; a word that was forgotten is counted again."""
    known = _COUNTS.setdefault(vocabulary, {})
    found = [known.get(w) for w in words]
    new = [w for w, n in zip(words, found) if n is None]
    if new:
        counts = [len(p) for p in encode_words(vocabulary, new)]
        if len(known) + len(new) > _MOST_REMEMBERED:
            known.clear()
        known.update(zip(new[:_MOST_REMEMBERED], counts))
        each = iter(counts)
        found = [next(each) if n is None else n for n in found]
    return np.array(found, dtype=np.int64)
