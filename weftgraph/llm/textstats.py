"""Counts of whole texts, a numpy step at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from weftgraph.llm import textcore
from weftgraph.llm.superkmer import joined_words, same_windows

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_digits", "n_bytes", "n_bars", "n_shouts",
)


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_SYMBOL, _UPPER, _DIGIT = _table(SYMBOLS), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("0123456789")
_MARK = _table("!\"'(),-./:;?@[\\]^_`{}~+=")


def repeated_words(data: np.ndarray, new: np.ndarray, lengths: np.ndarray, at: np.ndarray, width: int = 3) -> np.ndarray:
    """For each text, the words inside windows that it holds twice or more."""
    n = len(lengths)
    covered = np.zeros(n, bool)
    if n >= width:
        text = np.repeat(np.arange(len(at) - 1), np.diff(at))
        first = np.flatnonzero(text[: n - width + 1] == text[width - 1 :])
        low, high = new[first], new[first + width - 1] + lengths[first + width - 1]
        # The text's number goes into the hash, so windows of two texts are never one group.
        hashed = textcore.RangeHash(data)(low, high) ^ textcore.mixed(text[first].astype(np.uint64) + np.uint64(1))
        number = same_windows(data.tobytes(), low, high, hashed)
        shared = number >= 0
        if shared.any():
            twice = np.bincount(number[shared])[number[shared]] > 1
            hit = first[shared][twice]
            for k in range(width):
                covered[hit + k] = True
    return textcore.per_text(covered, at)


def counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS of each text of a step."""
    joined, new, lengths, at = joined_words(data, offsets)
    per = lambda flags: textcore.per_text(flags, offsets)
    out = {
        "n_words": np.diff(at),
        "word_chars": per(~textcore.is_space(data) & ((data & 0xC0) != 0x80)),
        "n_symbols": per(_SYMBOL[data]),
        "n_repeat_words": repeated_words(joined, new, lengths, at),
        "n_upper": per(_UPPER[data]),
        "n_marks": per(_MARK[data]),
        "n_digits": per(_DIGIT[data]),
        "n_bytes": np.diff(offsets),
        "n_bars": per(data == 124),
        "n_shouts": per(data == 33),
    }
    raw = data.tobytes()
    again, lines = np.zeros(len(offsets) - 1, np.int64), np.zeros(len(offsets) - 1, np.int64)
    for k in range(len(offsets) - 1):
        own = [x for x in raw[offsets[k] : offsets[k + 1]].split(b"\n") if x.strip()]
        lines[k], again[k] = len(own), len(own) - len(set(own))
    return out | {"n_lines": lines, "n_dup_lines": again}


def counted(keep: tuple[str, ...]):
    """A mapInArrow function: keep's columns, then COUNTS of column text."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = {k: np.zeros(len(batch), np.int64) for k in COUNTS}
            for first, after, data, offsets in textcore.steps(batch.column("text")):
                for k, v in counts(data, offsets).items():
                    got[k][first:after] = v
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + [pa.array(got[k]) for k in COUNTS], names=[*keep, *COUNTS])

    return of
