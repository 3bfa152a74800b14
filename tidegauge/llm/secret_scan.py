"""Secret scans by a randomness test battery.

Besides fixed patterns, runs of characters that could encode a key are tested. The encoding is inferred from the
characters that occur. Three tests ask whether the symbols look drawn at random: chi-squared uniformity over the
encoding's alphabet, runs above and below the middle of the alphabet, and serial correlation of neighbours. Their
combination (Fisher) must not reject randomness. Then the run is compared with ordinary text in two ways: by the
chi-squared value that ordinary words of the same length would show, and by the likelihood ratio of random symbols
against letter pairs of words and the few changes between letters, digits and cases that names and numbers have. The
smaller p-value, doubled, falls with the length and is held against a false-discovery limit over all runs of the text
(Benjamini-Hochberg).
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns and least lengths, by kind, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the longest runs [0-9a-f]+ that have 24 characters
KINDS = ("assign", "access", "hex", "random")
KEYWORD = re.compile(r"password|passwd|secret|token|api_?key", re.IGNORECASE | re.ASCII)


@dataclass(frozen=True)
class Battery:
    """``least``: shortest run tested; ``random_level``: level at which the battery rejects randomness;
    ``false_discoveries``: accepted share of ordinary runs among those reported."""

    least: int = 20
    random_level: float = 0.01
    false_discoveries: float = 0.01


LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings from the smallest alphabet to the largest, each with how much the squared frequencies of ordinary text
#: exceed uniformity there (size of the alphabet times the chance that two symbols agree, less one).
ENCODINGS = [
    ("decimal", DIGITS, 0.5), ("hex", DIGITS + "abcdef", 0.6), ("hex_upper", DIGITS + "ABCDEF", 0.6),
    ("lower", LOWER, 0.7), ("upper", UPPER, 0.7), ("base32", UPPER + "234567", 1.1), ("base36", DIGITS + LOWER, 1.35),
    ("base36_upper", DIGITS + UPPER, 1.35), ("letters", UPPER + LOWER, 2.4), ("base62", UPPER + LOWER + DIGITS, 3.0),
    ("base64", UPPER + LOWER + DIGITS + "+/", 3.2), ("base64url", UPPER + LOWER + DIGITS + "-_", 3.2), ("all", UPPER + LOWER + DIGITS + "+/-_", 3.3),
]
_SETS = [(name, frozenset(a), {c: i for i, c in enumerate(a)}, excess) for name, a, excess in ENCODINGS]


#: Ordinary words of four languages, for the letter pairs that ordinary text has.
WORDS = """
the of and to in that is was for with as his they be at one have this from or had by hot but some what there we can out other were all your when up use how said each she which their time will way about many then them
would write like these long make thing see him two has look more day could come did number sound most people over know water than call first who may down side been now find any new work part take get place made live where
after back little only round man year came show every good give our under name very through just form sentence great think help low line differ turn cause much mean before move right boy old too same tell does set three want
configuration government information development management international application description organization understanding responsibility authentication environment directory document standard
der die und das von nicht mit sich auf eine wird sind noch nach einer wie einem kann auch werden durch haben oder zeit schon gegen ganz mehr wenn unter diese sein hatte keine jahre zwischen immer wieder gesellschaft
geschichte entwicklung verwaltung strasse wirtschaft bundesrepublik versicherung arbeit grosse leben welt menschen wasser stadt haus freund schule fenster
les des est que dans pour qui une sur pas plus par avec tout faire son mettre autre mais nous comme ou leur bien ces deux temps meme sans vous encore aussi peut apres jour homme monde toujours gouvernement quelque
maison travail pays femme vie enfant question pendant depuis contre entre politique developpement francais
los del las por con para una como mas pero sus este porque cuando muy sobre tambien hasta hay donde quien desde todo nos durante todos uno contra otros fue ese eso ante ellos tiempo trabajo mundo gobierno casa
ciudad persona historia desarrollo informacion nacional vida tierra agua forma parte lugar siempre mujer hombre
"""
#: Chances in ordinary text that lower case, upper case, digits, marks, the start of a run and upper case after upper
#: case are followed by lower case, upper case, digits and marks.
FOLLOW = ((0.88, 0.03, 0.03, 0.06), (0.40, 0.45, 0.06, 0.09), (0.03, 0.03, 0.86, 0.08), (0.45, 0.20, 0.30, 0.05), (0.50, 0.30, 0.15, 0.05), (0.03, 0.88, 0.03, 0.06))
_SYMBOLS = {c: i for i, c in enumerate(LOWER + UPPER + DIGITS + "+/-_")}


def _ordinary_logs() -> np.ndarray:
    """Natural logarithm of the chance of a symbol (column) after another (row; then a row for the start, and those of
    the upper case after upper case)."""
    pairs, single = np.zeros((26, 26)), np.zeros(26)
    for word in WORDS.split():
        at = [ord(c) - 97 for c in word]
        np.add.at(single, at, 1)
        np.add.at(pairs, (at[:-1], at[1:]), 1)
    single = 0.9 * single / single.sum() + 0.1 / 26
    after = 0.75 * (pairs + 5 * single) / (pairs.sum(axis=1, keepdims=True) + 5) + 0.15 * single + 0.1 / 26
    rows = [(of, x) for of, n in enumerate((26, 26, 10, 4, 1, 26)) for x in range(n)]
    out = np.empty((len(rows), len(_SYMBOLS)))
    for row, (of, x) in enumerate(rows):
        lower = after[x] if of < 2 else single  # a capital begins a word
        upper = after[x] if of in (1, 5) else single
        out[row] = np.repeat(FOLLOW[of], [26, 26, 10, 4]) * np.concatenate((lower / lower.sum(), upper / upper.sum(), np.full(10, 0.1), np.full(4, 0.25)))
    return np.log(out)


_ORDINARY = _ordinary_logs()


def _upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def tests(run: str) -> tuple[str, float, float]:
    """Encoding, p-value of the battery under randomness, p-value under ordinary text."""
    body = run.rstrip("=")
    chars = set(body)
    name, _, index, excess = next(x for x in _SETS if chars <= x[1])
    x = np.fromiter(map(index.__getitem__, body), np.int64, len(body))
    n, k = len(x), len(index)
    counts = np.bincount(x, minlength=k)
    chi = float((counts**2).sum() * k / n - n)
    uniform = _upper_tail((chi - (k - 1)) / math.sqrt(max(1e-9, 2 * (k - 1) * (n - 1) / n)))
    above = x >= k / 2
    n1, n2 = int(above.sum()), int(n - above.sum())
    runs = 1 + int((above[1:] != above[:-1]).sum())
    if n1 and n2 and n > 2:
        mean, var = 1 + 2 * n1 * n2 / n, 2 * n1 * n2 * (2 * n1 * n2 - n) / (n * n * (n - 1))
        of_runs = 2 * _upper_tail(abs(runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        of_runs = 2.0 ** (1 - n)
    sd = x.std()
    r = float(np.mean((x[1:] - x.mean()) * (x[:-1] - x.mean())) / sd**2) if sd > 0 else 1.0
    serial = 2 * _upper_tail(abs(r) * math.sqrt(n - 1))
    fisher = -2 * sum(math.log(max(1e-300, p)) for p in (uniform, of_runs, serial)) / 2
    battery = math.exp(-fisher) * (1 + fisher + fisher**2 / 2)  # chi-squared tail with 6 degrees of freedom
    ordinary = _upper_tail((k - 1 + n * excess - chi) / math.sqrt(2 * (k - 1) + 4 * n * excess))
    if name == "decimal":  # ordinary numbers have no pairs that tell them from random ones
        return name, battery, ordinary
    # a likelihood ratio exceeds t under ordinary text with a chance of at most 1 / t; one of the encodings was chosen
    at = np.fromiter(map(_SYMBOLS.__getitem__, body), np.int64, n)
    big = (at >= 26) & (at < 52)
    after = np.concatenate(([len(_SYMBOLS)], at[:-1]))
    after[2:] += (big[1:-1] & big[:-2]) * (len(_SYMBOLS) + 1 - 26)
    ratio = -n * math.log(k) - float(_ORDINARY[after, at].sum()) - math.log(len(ENCODINGS))
    return name, battery, min(1.0, 2 * min(ordinary, math.exp(min(0.0, -ratio))))


def random_spans(text: str, battery: Battery, candidate: re.Pattern) -> list[tuple[int, int]]:
    """The runs that pass, by place."""
    tested = [(m.start(), m.end(), *tests(m.group())[1:]) for m in candidate.finditer(text) if m.group().strip("=")]
    ranked = sorted(p for _, _, _, p in tested)
    limit = max((p for i, p in enumerate(ranked, 1) if p <= battery.false_discoveries * i / len(ranked)), default=-1.0)
    return [(a, b) for a, b, good, p in tested if p <= limit and good >= battery.random_level]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, place of the kind in KINDS) of the fixed patterns, by start and kind."""
    spans = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6] if KEYWORD.search(text) else []
    if "AKIA" in text:
        spans += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda x: (x[0], x[2]))


def candidate_pattern(battery: Battery) -> re.Pattern:
    return re.compile(rf"[A-Za-z0-9+/_-]{{{battery.least},}}={{0,2}}")


def all_spans(text: str, battery: Battery, candidate: re.Pattern) -> tuple[list, list]:
    """The spans of the fixed patterns, and those with the random runs that lie in none of them."""
    base = base_spans(text)
    starts, ends = [a for a, _, _ in base], list(accumulate((b for _, b, _ in base), max))
    more = []
    for a, b in random_spans(text, battery, candidate):
        before = bisect_right(starts, a)  # of the base spans that start by then, one ends at b or later
        if not before or ends[before - 1] < b:
            more.append((a, b, 3))
    return base, sorted(base + more, key=lambda x: (x[0], x[2]))


def _digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, at = [], 0
    for a, b, _ in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def scan_column(text: Column, battery: Battery = Battery()) -> Column:
    """A struct of the counts by kind, the digest of the fixed patterns' spans, and all spans."""
    fields = "n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"

    def apply(texts: pd.Series) -> pd.DataFrame:
        rows, candidate = [], candidate_pattern(battery)
        for text in texts:
            base, spans = all_spans(text or "", battery, candidate)
            kinds = [k for _, _, k in spans]
            rows.append((*(kinds.count(i) for i in range(4)), hashlib.sha256(_digest(base).encode()).hexdigest(), _digest(spans)))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in fields.split(", ")])

    return F.pandas_udf(apply, fields)(text)


def redact_column(text: Column, battery: Battery = Battery(), mark: str = "[SECRET]") -> Column:
    """The text with each group of overlapping spans replaced by ``mark``; null stays null."""

    def apply(texts: pd.Series) -> pd.Series:
        candidate = candidate_pattern(battery)
        return pd.Series([x and redact(x, all_spans(x, battery, candidate)[1], mark) for x in texts], dtype=object)

    return F.pandas_udf(apply, "string")(text)


def scan_secrets(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", battery: Battery = Battery()) -> DataFrame:
    """One row per input row: the id, counts by kind, ``base_sha256``, ``spans`` (kind:start:end in code points).

    Defined cases: null text as empty text (no spans); repeated rows give a row each; spans with one start come in the
    order of KINDS; an empty table gives an empty table; a null id stays null.
    """
    return df.select(F.col(id_col), scan_column(F.col(text_col), battery).alias("r")).select(id_col, "r.*")
