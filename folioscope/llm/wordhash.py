"""Words of whole texts as 64-bit numbers, hashed in numpy straight from Arrow's bytes.

Words are ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased. A word's number is a multilinear hash of its bytes, mixed with its length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .shingles import mix

#: Bytes hashed at a time (some 40 bytes of temporaries each), or one text.
PIECE = 1 << 17


def _letters() -> np.ndarray:
    """White space is 0, every other byte its value and 1, A-Z as a-z."""
    table = np.arange(1, 257, dtype=np.uint16)
    table[65:91] += 32
    table[[9, 10, 11, 12, 13, 32]] = 0
    return table


LETTERS = _letters()
_weights = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _weight(n: int) -> np.ndarray:
    """Odd multipliers of the first n places of a word."""
    global _weights
    if n > len(_weights):
        _weights = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return _weights


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all words, and where those of each text begin and end (one offset more than texts); a null has none."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    values, counts = [], [np.zeros(1, np.int64)]
    first, total = 0, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE, "right")) - 1)
        base = offsets[first]
        letters = LETTERS[data[base : offsets[last]]]
        inner = letters > 0
        start = inner.copy()
        start[1:] &= ~inner[:-1]
        own = offsets[first:last] - base
        own = own[own < len(letters)]
        start[own] = inner[own]  # a text's first byte never continues a word of the text before
        starts = np.nonzero(start)[0]
        if len(starts):
            place = np.nonzero(inner)[0]
            heads = np.nonzero(start[place])[0]
            lengths = np.diff(heads, append=len(place))
            within = place - np.repeat(starts, lengths)
            terms = letters[place].astype(np.uint64) * _weight(int(lengths.max()))[within]
            values.append(mix(np.add.reduceat(terms, heads) + lengths.astype(np.uint64)))
        counts.append(total + np.searchsorted(starts, offsets[first + 1 : last + 1] - base))
        total += len(starts)
        first = last
    return (np.concatenate(values) if values else np.zeros(0, np.uint64)), np.concatenate(counts)
