"""Language identification by cross-parsing entropy.

For each language the suffix automaton of a sample of its labelled text is built. A text is parsed greedily into the
longest phrases that occur in the sample; the fewer phrases it takes, the closer the text is to the language. The
number of phrases times log2 of the sample's size, over the length, estimates the cross entropy in bits a byte; the
language with the least wins.

The automata are small tables over folded bytes (letters in lower case; ASCII bytes that are no letters as one blank;
bytes over 127 as they are). So that many texts advance in step, a text is parsed in blocks from a fresh start each;
then the parse that comes in from the block before goes on until it is in the same state as the block's own, from where
both are one. The number of phrases is that of the parse of the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, learnable

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """``sample_bytes``: the bound on the text learnt for a language (its table takes about 250 times as many bytes in
    every worker); ``sample_texts``: on the texts that it is taken from; ``block``: bytes that are parsed in step."""

    sample_bytes: int = 49_152
    sample_texts: int = 64
    block: int = 512


FOLD = np.arange(256, dtype=np.uint8)
FOLD[:128] = 32
FOLD[97:123] = np.arange(97, 123)


def fold(text: str) -> np.ndarray:
    return FOLD[np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)]


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of the states of the suffix automaton; state 0 is the start."""
    to: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in data:
        new = len(to)
        to.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = new
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(to)
                to.append(dict(to[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return to


class CrossParser:
    """The tables of all languages, one below the other. The entry of a state and a byte class is the next state, or
    -1 where the phrase ends. Class 0 is a byte that no sample has; the last class pads blocks and changes nothing."""

    def __init__(self, samples: dict[str, bytes], settings: Settings = Settings()):
        self.settings, self.langs = settings, sorted(x for x in samples if samples[x])
        seen = sorted(set().union(*(samples[x] for x in self.langs))) if self.langs else []
        self.classes = np.zeros(256, np.uint8)
        self.classes[seen] = np.arange(1, len(seen) + 1)
        self.width = len(seen) + 2
        tables, roots, at = [], [], 0
        for lang in self.langs:
            states = suffix_automaton(samples[lang])
            table = np.full((len(states), self.width), -1, np.int32)
            for s, row in enumerate(states):
                if row:
                    table[s, self.classes[list(row)]] = np.fromiter(row.values(), np.int32, len(row)) + at
            table[:, -1] = np.arange(len(states)) + at
            roots.append(np.where(table[0] < 0, at, table[0]))  # where a new phrase is after its first byte
            tables.append(table)
            at += len(states)
        self.starts = np.cumsum([0, *map(len, tables[:-1])]).astype(np.int32) if tables else np.zeros(0, np.int32)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
        self.roots = np.stack(roots).astype(np.int32) if roots else np.zeros((0, 2), np.int32)
        self.bits = np.array([np.log2(max(2, len(samples[x]))) for x in self.langs])

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Number of phrases by text and language."""
        size, n_langs = self.settings.block, len(self.langs)
        blocks = [-(-len(x) // size) for x in texts]
        out = np.zeros((len(texts), n_langs), np.int64)
        owner = np.repeat(np.arange(len(texts)), blocks)
        if not len(owner) or not n_langs:
            return out
        flat = np.full((len(owner), size), self.width - 1, np.uint8)
        at = 0
        for text, n in zip(texts, blocks):
            if n:
                flat[at : at + n].reshape(-1)[: len(text)] = self.classes[text]
                at += n
        fresh = np.concatenate(([True], owner[1:] != owner[:-1]))  # the first block of a text
        last = np.concatenate((owner[1:] != owner[:-1], [True]))
        carried, step = self.starts, max(64, 8192 // n_langs)
        for a in range(0, len(owner), step):
            count, end = self._blocks(np.ascontiguousarray(flat[a : a + step].T).astype(np.int32), fresh[a : a + step], carried)
            count += (end != self.starts[:, None]) & last[a : a + step]  # the phrase that the text's end cuts off
            np.add.at(out, owner[a : a + step], count.T)
            carried = end[:, -1]
        return out

    def _advance(self, state, c, starts, offset):
        """The states after one byte class each, and the phrases that end: the one before where the byte doesn't go on,
        and a byte that no sample has, as a phrase of its own."""
        new = self.table.take(state * self.width + c)
        ended = new < 0
        after = np.where(ended, self.roots.ravel().take(offset + c), new)
        return after, (ended & (state != starts)).view(np.uint8) + (ended & (after == starts)).view(np.uint8)

    def _blocks(self, part: np.ndarray, fresh: np.ndarray, carried: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that end in each block, and the state at its end, by language and block. ``part``: byte classes by
        place and block; ``fresh``: blocks that begin a text; ``carried``: states at the end of the block before."""
        size, m = part.shape
        starts, offset = self.starts[:, None], np.arange(len(self.langs))[:, None] * self.width
        states, counts = np.empty((size, len(self.langs), m), np.int32), np.empty((size, len(self.langs), m), np.int32)
        state, count = np.repeat(starts, m, axis=1), np.zeros((len(self.langs), m), np.int32)
        for t in range(size):
            state, ended = self._advance(state, part[t], starts, offset)
            count = count + ended
            states[t], counts[t] = state, count
        total, end = counts[-1].astype(np.int64), states[-1].copy()
        lang, block = (x.ravel() for x in np.meshgrid(np.arange(len(self.langs)), np.flatnonzero(~fresh), indexing="ij"))
        while len(block):
            enter = np.where(block > 0, end[lang, block - 1], carried[lang])
            l, b, s, c = lang, block, enter, np.zeros(len(block), np.int64)
            changed = []
            for t in range(size):
                s, ended = self._advance(s, part[t, b], self.starts[l], l * self.width)
                c = c + ended
                met = s == states[t, l, b]
                if met.any():  # from here on the two parses are one
                    x, y = l[met], b[met]
                    total[x, y] = c[met] + counts[-1, x, y] - counts[t, x, y]
                    moved = end[x, y] != states[-1, x, y]
                    end[x, y] = states[-1, x, y]
                    changed.append((x[moved], y[moved]))
                    l, b, s, c = l[~met], b[~met], s[~met], c[~met]
                    if not len(b):
                        break
            total[l, b] = c
            moved = end[l, b] != s
            end[l, b] = s
            changed.append((l[moved], b[moved]))
            lang, block = (np.concatenate(x) for x in zip(*changed))
            go_on = block + 1 < m  # what comes in there has changed
            lang, block = lang[go_on], block[go_on] + 1
            go_on = ~fresh[block]
            lang, block = lang[go_on], block[go_on]
        return total, end

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        import regex

        letter = regex.compile(r"\p{L}")
        known = [i for i, x in enumerate(texts) if x and self.langs and letter.search(x)]
        lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        for a in range(0, len(known), 1024):
            part = known[a : a + 1024]
            folded = [fold(texts[i]) for i in part]
            bits = self.phrases(folded) * self.bits
            best = bits.argmin(axis=1)  # of equals the first by name
            share = 1 / np.exp(np.clip((bits.min(axis=1, keepdims=True) - bits) / 8, -60, 0)).sum(axis=1)
            for i, k, s in zip(part, best, share):
                lang[i], score[i] = self.langs[k], float(s)
        return lang, score


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", settings: Settings = Settings()) -> CrossParser:
    """Learns from at most ``settings.sample_bytes`` of text a language, of rows that are not held out: whole texts by
    the order of a hash of the id, until the bound is reached. Rows with a null language, text or id are not learnt
    from; an empty language is one like others."""
    rows = df.filter(learnable(F.col(id_col)) & F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    # texts that would be most of a sample by themselves come last; none gives more than the sample's bound
    large = F.octet_length(text_col) > settings.sample_bytes // 4
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), large.alias("large"), F.xxhash64(id_col).alias("h"), F.col(id_col).alias("id"), F.left(F.col(text_col), F.lit(settings.sample_bytes)).alias("text"))
    # the rank keeps a few rows a task and language before anything is shuffled
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("large", "h", "id", "text"))
    found = rows.withColumn("nth", nth).filter(F.col("nth") <= settings.sample_texts).orderBy("lang", "nth").toPandas()
    samples: dict[str, bytes] = {}
    for lang, text in zip(found["lang"], found["text"]):
        sample = samples.get(lang, b"")
        if len(sample) < settings.sample_bytes:
            samples[lang] = (sample + fold(text).tobytes() + b" ")[: settings.sample_bytes]
    return CrossParser(samples, settings)


def language_column(text: Column, parser: CrossParser, spark) -> Column:
    """A struct of ``lang_pred`` and ``score`` of a text column."""
    shared = spark.sparkContext.broadcast(parser)  # bounded by settings.sample_bytes a language

    def apply(texts: pd.Series) -> pd.DataFrame:
        lang, score = shared.value.predict(texts.tolist())
        return pd.DataFrame({"lang_pred": lang, "score": score})

    return F.pandas_udf(apply, "lang_pred string, score double")(text)


def identify_languages(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", settings: Settings = Settings()) -> DataFrame:
    """One row per input row: the id, ``held_out``, ``lang_pred``, ``score`` (the winner's share of the likelihoods).

    Defined cases: null texts and texts without a letter are ``und`` with score 0, as is everything if there is
    nothing to learn from; of languages with equal entropy the first by name wins; repeated rows give a row each; an
    empty table gives an empty table. Null ids are not held out and never learnt from.
    """
    parser = learn(df, text_col, lang_col, id_col, settings)
    out = df.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), language_column(F.col(text_col), parser, df.sparkSession).alias("r"))
    return out.select(id_col, "held_out", "r.*")
