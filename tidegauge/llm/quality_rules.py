"""Quality rules: compression bands.

A text is compressed whole and in fixed chunks with zstandard. Natural text falls into a band of compression ratios
(compressed bytes / raw bytes) that depends on the length: short texts hardly shrink, long ones do. Below the band a
text is repetitive, above it it is incompressible (random or encoded data).
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Bands:
    """Limits by length. ``points``: byte lengths, in order, each with the ratios that a text of that length must stay
    between; between two points the limits follow the logarithm of the length. A text under the first length has no
    limits, as the frame that zstandard adds outweighs the text; beyond the last its limits stay.

    The points lie 1 to 5 % below the least ratio that documents labelled as good reach at a length (0.554 at 512
    bytes, 0.462 at 2048, 0.438 at 4096, 0.423 at 8192, 0.398 at 32768), and above the largest of all documents,
    manuals and licenses; base64 is over them from 384 bytes on, random words from 512 on, hex digits, which compress
    as well as text does, from 8192 bytes on. ``bands_of`` finds points for other text. Of the chunks of
    ``chunk_bytes`` bytes, at most ``max_bad_chunks`` may leave the band of their own length."""

    points: tuple[tuple[int, float, float], ...] = (
        (64, 0.70, 1.20), (128, 0.66, 1.08), (256, 0.57, 0.88), (384, 0.55, 0.83), (512, 0.535, 0.77), (768, 0.49, 0.73), (1024, 0.472, 0.69), (2048, 0.452, 0.65), (3072, 0.438, 0.58), (4096, 0.430, 0.54),
        (8192, 0.413, 0.50), (16384, 0.401, 0.49), (32768, 0.390, 0.48), (65536, 0.378, 0.48), (1048576, 0.33, 0.48),
    )
    chunk_bytes: int = 4096
    max_bad_chunks: float = 0.5
    level: int = 3

    def limits(self, n: int) -> tuple[float, float] | None:
        k = bisect_right(self.points, n, key=lambda p: p[0])
        if not k:
            return None
        if k == len(self.points):
            return self.points[-1][1:]
        (a, *before), (z, *after) = self.points[k - 1 : k + 1]
        share = math.log(n / a) / math.log(z / a)
        return tuple(x + share * (y - x) for x, y in zip(before, after))

    def verdict(self, n: int, ratio: float) -> int:
        """-1 under the band (repetitive), 1 over it (incompressible), else 0."""
        found = self.limits(n)
        return 0 if found is None or found[0] <= ratio <= found[1] else -1 if ratio < found[0] else 1


def repeated_words(words: list) -> int:
    """Words that lie in a 5-word window found twice or more in the text, its first place included."""
    if len(words) < 6:
        return 0
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    total, end = 0, 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            total += at + 5 - max(at, end)
            end = at + 5
    return total


def text_statistics(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def compression_verdict(raw: bytes, bands: Bands, compressor) -> tuple[float, int, int, bool]:
    """Ratio of the whole text, its verdict, chunks outside their band, and whether the text is accepted."""
    if not raw:
        return 0.0, 0, 0, True
    ratio = len(compressor.compress(raw)) / len(raw)
    whole, bad, n = bands.verdict(len(raw), ratio), 0, 0
    if len(raw) > bands.chunk_bytes:
        for at in range(0, len(raw), bands.chunk_bytes):
            part = raw[at : at + bands.chunk_bytes]
            bad += bands.verdict(len(part), len(compressor.compress(part)) / len(part)) != 0
            n += 1
    return ratio, whole, bad, whole == 0 and bad <= bands.max_bad_chunks * n


RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, band int, bad_chunks long, base_failed boolean, kept boolean"


def rules_column(text: Column, bands: Bands = Bands()) -> Column:
    """A struct of the statistics and verdicts of a text column. Null and empty texts: zeros, and they fail."""

    def apply(texts: pd.Series) -> pd.DataFrame:
        import zstandard

        compressor = zstandard.ZstdCompressor(level=bands.level)
        rows = []
        for text in texts:
            text = text or ""
            stats = text_statistics(text)
            ratio, band, bad, good = compression_verdict(text.encode("utf-8", "surrogatepass"), bands, compressor)
            failed = stats[0] < 10 or 100 * stats[4] > 20 * stats[0]
            rows.append((*stats, ratio, band, bad, failed, good and not failed))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in RESULT.split(", ")])

    return F.pandas_udf(apply, RESULT)(text)


def quality_rules(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", bands: Bands = Bands()) -> DataFrame:
    """One row per input row: the id, the statistics of the text, ``ratio`` and ``band`` of the whole text,
    ``bad_chunks``, ``base_failed`` and ``kept``.

    Defined cases: null text as empty text (no words, so base_failed); repeated rows and ties give a row each; an
    empty table gives an empty table; a null id stays null.
    """
    rated = df.select(F.col(id_col), rules_column(F.col(text_col), bands).alias("r"))
    return rated.select(id_col, "r.*")


def bands_of(df: DataFrame, text_col: str = "text", share: float = 0.001, margin: float = 0.03, least: int = 100, bands: Bands = Bands()) -> Bands:
    """Bands for the texts of ``df``, which should be good ones: by half octaves of the length, the ratios that all but
    ``share`` of the texts at either end stay between, widened by ``margin``. Lengths with fewer than ``least`` texts
    that pass the base rules give no point; without any point the limits of ``bands`` stay. Null texts are left out.
    """
    rated = df.select(F.octet_length(text_col).alias("n"), rules_column(F.col(text_col), bands).alias("r")).filter("n >= 64 AND NOT r.base_failed")
    of = rated.groupBy(F.floor(F.log2("n") * 2).alias("k")).agg(F.count("*").alias("n"), F.percentile_approx("r.ratio", [share, 1 - share], 10_000).alias("q"))
    found = sorted((round(2 ** (r["k"] / 2)), r["q"]) for r in of.filter(F.col("n") >= least).collect())  # two rows an octave
    return replace(bands, points=tuple((n, low * (1 - margin), high * (1 + margin)) for n, (low, high) in found) or bands.points)
