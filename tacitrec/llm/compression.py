"""Quality rules by compression bands.

Zstandard tells repetitive text (it shrinks too much) from text without structure (it hardly
shrinks). Both limits depend on the length, as short text always shrinks less. The whole text
and its chunks of `chunk_bytes`, one every `chunk_step` bytes, are compressed; a document fails if
the whole lies outside its band, if more than `bad_share` of its chunks lie outside theirs, or if
`bad_run` such chunks follow each other. Chunks find a repetitive or random passage in an otherwise
ordinary document; they overlap, so that it hardly matters where the passage begins, and are the
same for texts of every length, so a byte more or less changes no rule. The last chunk may be
shorter and is judged by the band of its own length.

A few plain counts come along, and base rules on them come before the bands. All of it is per
document: no shuffle, and a task holds one Arrow batch; a very long text is judged whole, chunk
after chunk. Null text has no words and fails the base rules like an empty one. Repeated rows are
judged each for itself, and an empty table gives no rows. Columns of the input that share a name
with a measure are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tacitrec.llm.common import BLANKS, replaced

# (bytes from, smallest ratio, largest ratio). Prose lies well inside: at 1 kB near 0.5 to 0.6,
# at 100 kB near 0.35 to 0.45. Random base64 words lie above from about 400 bytes on (0.84 at 512,
# 0.74 in the limit). Under 128 bytes the frame itself decides, so there is no band.
BANDS = (
    (0, 0.0, float("inf")),
    (128, 0.30, 1.10),
    (256, 0.30, 0.86),
    (384, 0.30, 0.82),
    (512, 0.30, 0.79),
    (768, 0.30, 0.76),
    (1024, 0.26, 0.72),
    (2048, 0.26, 0.65),
    (4096, 0.22, 0.60),
    (16384, 0.18, 0.54),
    (65536, 0.15, 0.50),
)

MEASURES = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "ratio double, bad_chunk_share double, base_failed boolean, kept boolean"
)


@dataclass(frozen=True)
class BandParams:
    min_words: int = 20
    window: int = 8
    max_repeat_percent: int = 30
    level: int = 3
    chunk_bytes: int = 512
    chunk_step: int = 256
    bad_share: float = 0.1
    bad_run: int = 2
    bands: Sequence[tuple[int, float, float]] = BANDS


def words_in_repeated_windows(words: list[bytes], window: int) -> int:
    """Words that lie in a window of `window` words which the list holds twice or more."""
    n = len(words)
    if n <= window:
        return 0
    numbers: dict[bytes, int] = {}
    codes = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    if len(numbers) == n:
        return 0
    length = 1  # codes[i] numbers the window of `length` words at i, and equal windows alike
    while length < window:
        step = min(length, window - length)
        pairs = codes[: n - length - step + 1] * np.int64(codes.max() + 1) + codes[step : step + n - length - step + 1]
        codes = np.unique(pairs, return_inverse=True)[1]
        length += step
    repeated = np.bincount(codes)[codes] > 1
    edges = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(repeated)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def band_of(n_bytes: int, bands: Sequence[tuple[int, float, float]]) -> tuple[float, float]:
    low, high = 0.0, float("inf")
    for start, smallest, largest in bands:
        if n_bytes >= start:
            low, high = smallest, largest
    return low, high


def chunk_starts(n_bytes: int, p: BandParams) -> range:
    """Where chunks begin; none in a text of one chunk, the last one reaches the end."""
    return range(0, n_bytes - p.chunk_bytes + p.chunk_step, p.chunk_step) if n_bytes > p.chunk_bytes else range(0)


def measure(text: str | None, p: BandParams, compressor: zstandard.ZstdCompressor) -> tuple:
    text = text or ""
    data = text.encode()
    words = data.split()  # bytes.split() parts at exactly the six ASCII blanks
    blanks = sum(data.count(c.encode()) for c in BLANKS)
    symbols = sum(data.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    repeated = words_in_repeated_windows(words, p.window)

    def outside(part: bytes) -> tuple[float, bool]:
        ratio = len(compressor.compress(part)) / len(part)
        low, high = band_of(len(part), p.bands)
        return ratio, not low <= ratio <= high

    ratio, failed = outside(data) if data else (0.0, False)
    n_chunks = bad = run = longest = 0
    for i in chunk_starts(len(data), p):
        failing = outside(data[i : i + p.chunk_bytes])[1]
        run = run + 1 if failing else 0
        n_chunks, bad, longest = n_chunks + 1, bad + failing, max(longest, run)
    bad_share = bad / n_chunks if n_chunks else 0.0
    base_failed = len(words) < p.min_words or 100 * repeated > p.max_repeat_percent * len(words)
    kept = not base_failed and not failed and bad_share <= p.bad_share and longest < p.bad_run
    return (
        len(words), len(text) - blanks, symbols, len(lines) - len(set(lines)), repeated,
        ratio, bad_share, base_failed, kept,
    )


def compression_bands(df: DataFrame, text: str = "text", params: BandParams | None = None) -> DataFrame:
    """`df` with the measures, `base_failed` and `kept`."""
    p = params or BandParams()
    names = [part.split()[0] for part in MEASURES.split(", ")]

    def judge(texts: pd.Series) -> pd.DataFrame:
        compressor = zstandard.ZstdCompressor(level=p.level)
        return pd.DataFrame([measure(t, p, compressor) for t in texts], columns=names)

    judged = df.withColumn("__measures", F.pandas_udf(judge, MEASURES)(F.col(f"`{text}`")))
    return replaced(judged, **{name: F.col(f"__measures.{name}") for name in names}).drop("__measures")
