"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints are sorted, which makes an implicit binary trie: a node is a run of fingerprints with a common prefix.
The join walks pairs of nodes downwards together, adds up the bits in which their prefixes differ and drops a pair as
soon as that exceeds the error budget.

To spread the walk, budget + 1 tries are built, each with another block of bits put first. Two fingerprints within the
budget agree in at least one block, so in one of the tries they lie below the same node at the end of the first block,
and the subtrees below those nodes are joined independently of each other. A subtree that is too large for a task is
cut by the same rule over its remaining bits; what is still too large is cut into chunks, and each pair of chunks is
joined. No pair is lost. Each task returns a spanning forest of its links, never all pairs.

``near_duplicates`` takes 64 bits and a budget of differing bits, and is exact. ``similar_documents`` takes a similarity
of shingle sets: at 0.8 about 15 % of the bits differ, so it reads longer fingerprints, over which that share is
estimated well, and more tries, each with another choice of bits first, until a pair at the similarity shares a node
with the stated probability. These links only propose: within the components that they make, pairs within the budget
are compared by their sets, and only those that reach the similarity are links of the result.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SharedTable, shared_checkpoint, shuffle_partitions

SHINGLE_WORDS = 4
BUDGET = 4
SEED = 42
#: Most fingerprints below one node that a task joins at once; larger nodes are cut (exactly).
MOST_IN_TASK = 4096
#: A list of at most so many oversized nodes is broadcast; a longer one is joined by a shuffle.
MOST_BROADCAST = 10_000
#: Fingerprints below a trie's node that agree by chance.
BY_CHANCE = 512
#: Rows that a partition of fingerprints aims at; a task holds one in memory.
ROWS_IN_PARTITION = 400_000
#: Names of at most so many components are broadcast; more are joined by a shuffle, dealt over so many salts.
NAMES_BROADCAST, SALTS = 200_000, 32
#: Characters of texts whose sets a task compares at once; larger groups are cut into pairs of chunks.
CHARACTERS_IN_TASK = 1 << 24


@dataclass(frozen=True)
class Similarity:
    """``least``: similarity (Jaccard) of sets of ``shingle_words`` words; ``bits``: length of the fingerprint, a
    multiple of 64; ``deviations``: how many standard deviations more than expected at ``least`` may differ;
    ``recall``: probability that a pair at ``least`` shares a trie node."""

    least: float = 0.8
    shingle_words: int = 5
    bits: int = 512
    deviations: float = 2.0
    recall: float = 0.99

    @property
    def share(self) -> float:
        """Bits expected to differ at ``least``: the angle between two such sets."""
        return math.acos(2 * self.least / (1 + self.least)) / math.pi

    @property
    def budget(self) -> int:
        return round(self.bits * self.share + self.deviations * math.sqrt(self.bits * self.share * (1 - self.share)))

    def tries(self, n: int) -> list[np.ndarray]:
        """The bits that come first in each trie, log2(n / BY_CHANCE) of them, so that a node has about as many
        fingerprints by chance. The number of tries grows as n ** 0.23 at a similarity of 0.8."""
        width = min(40, self.bits, max(8, math.ceil(math.log2(max(n, 1) / BY_CHANCE))))
        want = math.ceil(math.log(1 - self.recall) / math.log1p(-((1 - self.share) ** width)))
        rng, out = np.random.default_rng(SEED), []
        while len(out) < want:
            order = rng.permutation(self.bits)
            out += [order[a : a + width] for a in range(0, self.bits - width + 1, width)]
        return out[:want]


def shingle_hashes(text: str | None, shingle_words: int) -> np.ndarray:
    """XXH64 of the shingles, repeats included; the whole sequence if there are fewer words, nothing without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower() changes A-Z only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle_words + 1
    return np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[shingle_words - 1 :].tolist())), np.uint64, n)


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The fingerprint as an unsigned integer. Null and word-less texts: 0."""
    hashes = shingle_hashes(text, shingle_words)
    n = len(hashes)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def long_fingerprint(text: str | None, similarity: Similarity) -> bytes:
    """A fingerprint of ``similarity.bits`` bits, 64 for each of several mixtures of the shingles' hashes, repeats
    included. Null and word-less texts: zeros."""
    return _votes(shingle_hashes(text, similarity.shingle_words), similarity)


def set_fingerprint(text: str | None, similarity: Similarity) -> tuple[bytes, bytes]:
    """The same over the set of shingles, each with one vote, and the set's digest."""
    hashes = np.unique(shingle_hashes(text, similarity.shingle_words))
    return _votes(hashes, similarity), hashlib.md5(hashes.tobytes()).digest()


def _votes(hashes: np.ndarray, similarity: Similarity) -> bytes:
    n, words = len(hashes), similarity.bits // 64
    step = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ones = np.zeros(similarity.bits, np.int64)
    for at in range(0, n, 4080):
        x = hashes[at : at + 4080, None] + step
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        bits = np.unpackbits((x ^ (x >> np.uint64(31))).view(np.uint8), axis=1, bitorder="little")
        for a in range(0, len(bits), 255):  # 255 ones fit a byte
            ones += np.add.reduce(bits[a : a + 255], axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > n, bitorder="little").tobytes()


def set_fingerprint_column(text: Column, similarity: Similarity) -> Column:
    def apply(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([set_fingerprint(x, similarity) for x in texts], columns=["long_fp", "digest"], dtype=object)

    return F.pandas_udf(apply, "long_fp binary, digest binary")(text)


def fingerprint_column(text: Column, shingle_words: int = SHINGLE_WORDS) -> Column:
    """The fingerprint as a signed long (the same 64 bits)."""

    def apply(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((fingerprint(x, shingle_words) for x in texts), np.uint64, len(texts)).view(np.int64))

    return F.pandas_udf(apply, "long")(text)


def merge_labels(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Connected components: label[i] becomes the smallest index that i reaches, over earlier and new links."""
    while len(u):
        a, b = label[u], label[v]
        open_ = a != b
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        if not len(u):
            break
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while not np.array_equal(up := label[label], label):
            label = up
    return label


def _near(key: np.ndarray, i: np.ndarray, j: np.ndarray, budget: int) -> np.ndarray:
    """Places of the pairs within the budget; the bits of a long fingerprint's second half are read only for pairs that
    keep to it over the first."""
    half = (key.shape[1] + 1) // 2
    first, second = key[:, :half], key[:, half:]
    count = np.bitwise_count(first[i] ^ first[j]).sum(axis=1, dtype=np.int64)
    at = np.flatnonzero(count <= budget)
    return at[count[at] + np.bitwise_count(second[i[at]] ^ second[j[at]]).sum(axis=1, dtype=np.int64) <= budget]


def trie_self_join(task: np.ndarray, key: np.ndarray, budget: int, chunk: int = 1 << 18) -> np.ndarray:
    """Labels of the components of links within each task.

    task, key: sorted by (task, key), without repeats; key: fingerprints as unsigned 64-bit words, one a column, the
    first bit on top of the first. Returns for each position the smallest position in its component.
    """
    key = key.reshape(len(key), -1) if len(key) else key.reshape(0, 1)
    n, words = key.shape
    label = np.arange(n)
    heads = np.flatnonzero(np.concatenate(([True], task[1:] != task[:-1]))) if n else np.array([], np.int64)
    tails = np.concatenate((heads[1:], [n])) if n else heads
    some = tails - heads > 1
    # links to a task's first and to the one before join large groups of near copies, whose pairs are then passed over
    mates = np.arange(n)
    for other in (np.repeat(heads, tails - heads), np.maximum(mates - 1, np.repeat(heads, tails - heads))):
        for at in range(0, n, 1 << 16):
            i, j = other[at : at + (1 << 16)], mates[at : at + (1 << 16)]
            i, j = i[i < j], j[i < j]
            ok = _near(key, i, j, budget)
            label = merge_labels(label, i[ok], j[ok])
    lo, hi = heads[some].astype(np.int64), tails[some].astype(np.int64)
    ones: dict[int, np.ndarray] = {}
    stack = [(0, lo, hi, lo, hi, np.zeros(len(lo), np.int64))]
    while stack:
        depth, alo, ahi, blo, bhi, acc = stack.pop()
        if len(alo) > chunk:
            for at in range(0, len(alo), chunk):
                stack.append((depth, *(x[at : at + chunk] for x in (alo, ahi, blo, bhi, acc))))
            continue
        if not len(alo):
            continue
        # few leaves below both nodes: compare them at once
        size = (ahi - alo) * (bhi - blo)
        near = (size <= 16) | (depth >= 64 * words)
        if near.any():
            leaves, step = np.flatnonzero(near), (1 << 16) // words
            for at in range(0, len(leaves), step):
                which = leaves[at : at + step]
                count = size[which]
                pair = np.repeat(which, count)
                within = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
                width = (bhi - blo)[pair]
                i, j = alo[pair] + within // width, blo[pair] + within % width
                ok = (i < j) & (label[i] != label[j])
                i, j = i[ok], j[ok]
                ok = _near(key, i, j, budget)
                label = merge_labels(label, i[ok], j[ok])
            far = ~near
            alo, ahi, blo, bhi, acc = alo[far], ahi[far], blo[far], bhi[far], acc[far]
            if not len(alo):
                continue
        if depth not in ones:
            ones[depth] = np.concatenate(([0], np.cumsum((key[:, depth // 64] >> np.uint64(63 - depth % 64)) & np.uint64(1)).astype(np.int64)))
        c = ones[depth]
        amid, bmid, same = ahi - (c[ahi] - c[alo]), bhi - (c[bhi] - c[blo]), (alo == blo) & (ahi == bhi)
        parts = [
            (alo, amid, blo, bmid, acc, np.ones(len(acc), bool)),
            (amid, ahi, bmid, bhi, acc, np.ones(len(acc), bool)),
            (alo, amid, bmid, bhi, acc + 1, acc < budget),
            (amid, ahi, blo, bmid, acc + 1, (acc < budget) & ~same),
        ]
        kept = []
        for a0, a1, b0, b1, d, alive in parts:
            ok = alive & (a1 > a0) & (b1 > b0) & ~((a0 == b0) & (a1 - a0 == 1) & (b1 - b0 == 1))
            kept.append((a0[ok], a1[ok], b0[ok], b1[ok], d[ok]))
        stack.append((depth + 1, *(np.concatenate(x) for x in zip(*kept))))
    return label


def _blocks(width: int, n: int) -> list[tuple[int, int]]:
    """n blocks of nearly equal size of bits 0..width-1: (first bit, bits)."""
    cuts = [width * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _field(fp: str, shift: int, bits: int) -> str:
    return f"(shiftrightunsigned({fp}, {shift}) & {(1 << bits) - 1}L)"


def _below_blocks(df: DataFrame, budget: int) -> DataFrame:
    """A row for each block of the fingerprint: ``node`` identifies the trie node that is reached when the block comes
    first, ``rest`` holds the other bits."""
    of = [(i, a, n) for i, (a, n) in enumerate(_blocks(64, budget + 1))]
    nodes = ", ".join(f"struct(xxhash64({i}, {_field('fp', a, n)}) AS node, (shiftrightunsigned(fp, {a + n}) | shiftleft(fp, {64 - a - n})) & {(1 << 64 - n) - 1}L AS rest)" for i, a, n in of)
    return df.select("fp", F.explode(F.expr(f"array({nodes})")).alias("x")).select("fp", "x.node", "x.rest")


def _below_sub_blocks(df: DataFrame, budget: int) -> DataFrame:
    """The same once more within each node, over the bits that are left."""
    of = [(i, a, n) for i, (a, n) in enumerate(_blocks(64 - 64 // (budget + 1), budget + 1))]
    return df.withColumn("sub", F.explode(F.expr("array(" + ", ".join(f"xxhash64(node, {i}, {_field('rest', a, n)})" for i, a, n in of) + ")")))


def _oversized(df: DataFrame, node: str, most: int) -> DataFrame:
    """The nodes with more than ``most`` fingerprints, with their counts; broadcast if that list is short."""
    large = shared_checkpoint(df.groupBy(node).agg(F.count("*").alias("members")).filter(F.col("members") > most))
    return F.broadcast(large) if large.count() <= MOST_BROADCAST else large


def forest(fps: DataFrame, budget: int = BUDGET, most: int = MOST_IN_TASK) -> DataFrame:
    """Spanning forests (fp, root) with root < fp, one per task, that together link all fingerprints within the
    budget. ``fps`` has one column ``fp`` of distinct longs."""
    spark = fps.sparkSession
    first = _below_blocks(fps, budget)
    large = _oversized(first, "node", most)
    fitting = first.join(large, "node", "left_anti").select(F.col("node").alias("task"), "fp")
    # below an oversized node all agree in the first block, so the budget is spent on the other bits, over which the
    # same argument holds again
    finer = _below_sub_blocks(first.join(large.select("node"), "node", "left_semi"), budget)
    large2 = _oversized(finer, "sub", most)
    fitting2 = finer.join(large2, "sub", "left_anti").select(F.col("sub").alias("task"), "fp")
    cut = finer.join(large2, "sub").withColumn("chunks", F.ceil(2 * F.col("members") / most).cast("int"))
    cut = cut.withColumn("mine", F.expr("pmod(xxhash64(fp, 7), chunks)")).withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
    chunked = cut.select(F.expr("xxhash64(sub, least(mine, other), greatest(mine, other), 1)").alias("task"), "fp")

    def join(batches):
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not parts:
            return
        task, fp = (np.concatenate(x) for x in zip(*parts))
        key = fp.view(np.uint64)
        order = np.lexsort((key, task))
        task, key = task[order], key[order]
        fresh = np.concatenate(([True], (task[1:] != task[:-1]) | (key[1:] != key[:-1])))
        task, key = task[fresh], key[fresh]
        label = trie_self_join(task, key, budget)
        ids = key.view(np.int64)
        root = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(root, label, ids)
        root = root[label]
        out = ids != root
        yield pa.RecordBatch.from_arrays([pa.array(ids[out]), pa.array(root[out])], names=["fp", "root"])

    tasks = fitting.unionByName(fitting2).unionByName(chunked)
    parts = max(shuffle_partitions(spark), -(-fps.count() * (budget + 1) // ROWS_IN_PARTITION))
    return tasks.repartition(parts, "task").mapInArrow(join, "fp long, root long")


def similar_forest(fps: DataFrame, n: int, similarity: Similarity, most: int = MOST_IN_TASK) -> DataFrame:
    """Spanning forests (fp, root), one per task, of the links among ``fps``: ``fp``, a long for each of the ``n``
    different fingerprints ``long_fp``."""
    spark, budget = fps.sparkSession, similarity.budget
    tries = similarity.tries(n)

    def below(batches):
        places = 1 << np.arange(len(tries[0]), dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                fp = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(part.num_rows, -1)
                bits = np.unpackbits(fp, axis=1, bitorder="little")
                for i, first in enumerate(tries):
                    node = (bits[:, first] @ places) + (i << 40)
                    yield pa.RecordBatch.from_arrays([pa.array(node), part.column(0), part.column(1)], names=["node", "fp", "long_fp"])

    def join(batches):
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy(), np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint64).reshape(b.num_rows, -1)) for b in batches]
        if not parts:
            return
        task, ids, key = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((ids, *key.T[::-1], task))
        task, ids, key = task[order], ids[order], key[order]
        label = trie_self_join(task, key, budget)
        root = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(root, label, ids)
        root = root[label]
        out = ids != root
        yield pa.RecordBatch.from_arrays([pa.array(ids[out]), pa.array(root[out])], names=["fp", "root"])

    nodes = fps.select("fp", "long_fp").mapInArrow(below, "node long, fp long, long_fp binary")
    large = _oversized(nodes, "node", most)
    dealt = nodes.join(large, "node", "left").withColumn("chunks", F.coalesce(F.ceil(2 * F.col("members") / most), F.lit(1)).cast("int"))
    dealt = dealt.withColumn("mine", F.expr("pmod(xxhash64(fp, 7), chunks)")).withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
    tasks = dealt.select(F.expr("xxhash64(node, least(mine, other), greatest(mine, other))").alias("task"), "fp", "long_fp")
    parts = max(shuffle_partitions(spark), -(-n * len(tries) // ROWS_IN_PARTITION))
    return tasks.repartition(parts, "task").mapInArrow(join, "fp long, root long")


def connected_components(edges: DataFrame) -> DataFrame:
    """(fp, root): every node that has an edge and is not its component's smallest, with that smallest node.

    Alternates large-star and small-star rounds until nothing changes. Each round joins on keys, so it runs on any
    number of machines; a node with very many edges is dealt anew by the adaptive skew join.
    """
    now = SharedTable(edges.filter("fp <> root").distinct())
    sign = F.expr("struct(count(*) AS n, bit_xor(xxhash64(fp, root)) AS h)")
    before = now.df.agg(sign.alias("s")).first()["s"]
    while before["n"]:
        both = now.df.unionByName(now.df.select(F.col("root").alias("fp"), F.col("fp").alias("root")))
        low = both.groupBy("fp").agg(F.min("root").alias("low")).withColumn("low", F.least("fp", "low"))
        large = both.join(low, "fp").filter("root > fp").select(F.col("root").alias("fp"), F.col("low").alias("root")).filter("fp <> root").distinct()
        low = large.groupBy("fp").agg(F.min("root").alias("low"))
        small = large.join(low, "fp")
        small = small.select(F.col("root").alias("fp"), F.col("low").alias("root")).unionByName(low.select("fp", F.col("low").alias("root")))
        old, now = now, SharedTable(small.filter("fp <> root").distinct())
        old.delete()
        after = now.df.agg(sign.alias("s")).first()["s"]
        if after == before:
            break
        before = after
    return now.df


def near_duplicates(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle_words: int = SHINGLE_WORDS, budget: int = BUDGET) -> DataFrame:
    """One row per input row: the id, ``fp`` (signed long) and ``component_id``, the smallest id among all rows
    reachable over links of at most ``budget`` differing bits.

    Defined cases: null and word-less texts have fingerprint zero and link with each other; repeated rows and ids
    give a row each; a null id takes part but never names a component unless it has no other id (then null); an empty
    table gives an empty table.
    """
    docs = shared_checkpoint(df.select(F.col(id_col), fingerprint_column(F.col(text_col), shingle_words).alias("fp")))
    fps = shared_checkpoint(docs.groupBy("fp").agg(F.min(id_col).alias("low")))
    named = _named(fps, forest(fps.select("fp"), budget))
    return docs.join(named, "fp").select(id_col, "fp", "component_id")


def verified_pairs(key: np.ndarray, sets: list[np.ndarray], similarity: Similarity) -> np.ndarray:
    """Labels of the components of links: pairs of ``key`` (fingerprints, 64-bit words as columns) within the budget
    whose sorted ``sets`` reach the similarity. Pairs that earlier links join are passed over."""
    label, size = np.arange(len(sets)), np.array([len(x) for x in sets])
    for i in range(len(sets) - 1):
        j = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        j = j[np.minimum(size[j], size[i]) >= similarity.least * np.maximum(size[j], size[i])]
        for at in j[np.bitwise_count(key[j] ^ key[i]).sum(axis=1, dtype=np.int64) <= similarity.budget].tolist():
            if label[at] == label[i]:
                continue
            both = np.sort(np.concatenate((sets[i], sets[at])), kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            if common >= similarity.least * (len(both) - common):
                label = merge_labels(label, np.array([i]), np.array([at]))
    return label


def verified_forest(groups: DataFrame, total: int, similarity: Similarity, most: int = MOST_IN_TASK) -> DataFrame:
    """Spanning forests (fp, root), one per task, of the links that hold by exact similarity. ``groups``: ``fp``, a long
    for each different set; its ``long_fp`` and ``text``; its ``group`` with ``members`` sets of ``characters``
    together. ``total``: all characters."""
    spark = groups.sparkSession
    dealt = groups.withColumn("chunks", F.expr(f"CAST(CASE WHEN members <= {most} AND characters <= {CHARACTERS_IN_TASK}L THEN 1 ELSE least(members, ceil(2 * greatest(members / {most}, characters / {CHARACTERS_IN_TASK}))) END AS INT)"))
    dealt = dealt.withColumn("mine", F.expr("CAST(pmod(xxhash64(fp, 7), chunks) AS INT)")).withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
    tasks = dealt.select(F.expr("xxhash64(group, least(mine, other), greatest(mine, other))").alias("task"), "fp", "long_fp", "text")

    def join(batches):
        rows: dict[int, list] = {}
        for batch in batches:
            for task, fp, long_fp, text in zip(*(c.to_pylist() for c in batch.columns)):
                rows.setdefault(task, []).append((fp, long_fp, np.unique(shingle_hashes(text, similarity.shingle_words))))
        for members in rows.values():
            ids = np.array([x[0] for x in members], np.int64)
            key = np.frombuffer(b"".join(x[1] for x in members), np.uint64).reshape(len(members), -1)
            label = verified_pairs(key, [x[2] for x in members], similarity)
            root = np.full(len(ids), np.iinfo(np.int64).max)
            np.minimum.at(root, label, ids)
            root = root[label]
            out = ids != root
            yield pa.RecordBatch.from_arrays([pa.array(ids[out]), pa.array(root[out])], names=["fp", "root"])

    parts = max(shuffle_partitions(spark), -(-total // CHARACTERS_IN_TASK))
    return tasks.repartition(parts, "task").mapInArrow(join, "fp long, root long")


def similar_documents(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", similarity: Similarity = Similarity(), most: int = MOST_IN_TASK) -> DataFrame:
    """One row per input row: the id, ``long_fp`` (binary) and ``component_id``, the smallest id among all rows
    reachable over links: two texts whose sets of shingles have the least similarity, and whose fingerprints, within
    the budget, a trie's node shows. Equal sets always link; a pair at the least similarity is proposed with a
    probability of about ``similarity.recall`` if within the budget, more similar ones with a higher one. No link is
    below the least similarity.

    Defined cases: as for ``near_duplicates``.
    """
    text = F.col(text_col)
    # the numbers are fixed by the checkpoints
    docs = df.select(F.col(id_col), text.alias("__text"), set_fingerprint_column(text, similarity).alias("f"))
    docs = shared_checkpoint(docs.select(id_col, "__text", "f.*", F.monotonically_increasing_id().alias("__row")))
    sets = docs.groupBy("long_fp", "digest").agg(F.min(id_col).alias("low"), F.min("__row").alias("__row"), F.min(F.length("__text")).alias("n"))
    sets = shared_checkpoint(sets.withColumn("fp", F.monotonically_increasing_id()))
    fps = shared_checkpoint(sets.groupBy("long_fp").agg(F.min("fp").alias("fp")))
    roots = connected_components(similar_forest(fps, fps.count(), similarity, most))
    first = sets.join(fps.select("long_fp", F.col("fp").alias("lead")), "long_fp").join(roots.select(F.col("fp").alias("lead"), "root"), "lead", "left")
    grouped = shared_checkpoint(first.select("fp", "long_fp", "__row", "n", F.coalesce("root", "lead").alias("group")))
    large = grouped.groupBy("group").agg(F.count("*").alias("members"), F.sum(F.coalesce("n", F.lit(0))).alias("characters")).filter("members > 1")
    wanted = shared_checkpoint(_with_group(grouped, shared_checkpoint(large), "group"))
    total = wanted.agg(F.sum("n").alias("n")).first()["n"] or 0
    texts = wanted.join(docs.select("__row", F.col("__text").alias("text")), "__row")
    named = _named(sets.select("fp", "low"), verified_forest(texts, total, similarity, most))
    return docs.join(sets.select("long_fp", "digest", "fp").join(named, "fp"), ["long_fp", "digest"]).select(id_col, "long_fp", "component_id")


def _with_group(members: DataFrame, groups: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Members (with ``fp``) joined with what is known of their groups, of which any may have any number of members: by
    a broadcast of a counted table, or over many salts. ``groups`` is checkpointed."""
    if groups.count() <= NAMES_BROADCAST:
        return members.join(F.broadcast(groups), key, how)
    salted = groups.withColumn("salt", F.explode(F.expr(f"sequence(0, {SALTS - 1})")))
    return members.withColumn("salt", F.expr(f"CAST(pmod(xxhash64(fp), {SALTS}) AS INT)")).join(salted, [key, "salt"], how).drop("salt")


def _named(fps: DataFrame, links: DataFrame) -> DataFrame:
    """(fp, component_id) from (fp, low) and forests of links. A component may have any number of members: its name is
    aggregated before it is shuffled, and members get it by a broadcast of a counted table or over many salts."""
    roots = connected_components(links)
    member = shared_checkpoint(fps.join(roots, "fp", "left").select("fp", "low", "root"))
    # a component's smallest fp has no root of its own
    names = member.filter("root IS NOT NULL").groupBy("root").agg(F.min("low").alias("least"))
    names = shared_checkpoint(names.join(member.filter("root IS NULL").select(F.col("fp").alias("root"), "low"), "root").select("root", F.least("least", "low").alias("component_id")))
    keyed = member.select("fp", "low", F.coalesce("root", "fp").alias("root"))
    joined = _with_group(keyed, names, "root", "left")
    return joined.select("fp", F.coalesce("component_id", "low").alias("component_id"))


def keep_one_of_each(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", find=near_duplicates, **options) -> DataFrame:
    """The rows of ``df`` whose id names their component under ``find``; of rows with the same id one, the first by all columns.
    Rows with a null id stay only where their component has no id at all, one for each different text. Columns of
    ``df`` may have any names."""
    found = find(df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), "text", "id", **options)
    # rows are dealt once, by a key that is never null and that the window keeps to
    key = lambda c: F.when(c.isNull(), "").otherwise(F.concat(F.lit("="), c.cast("string")))
    names = found.filter(F.col("id").eqNullSafe(F.col("component_id"))).select(key(F.col("id")).alias("key")).distinct()
    id_ = F.col(f"`{id_col}`")
    rows = df.select(F.struct(*[f"`{c}`" for c in df.columns]).alias("row"), key(id_).alias("key"), F.when(id_.isNull(), F.xxhash64(F.col(f"`{text_col}`"))).alias("text"))
    sortable = [c for c, kind in df.dtypes if "map<" not in kind and kind != "variant"]
    order = [F.col("row")] if len(sortable) == len(df.columns) else [F.col("row").getField(c) for c in sortable]
    kept = rows.join(names, "key", "left_semi").withColumn("nth", F.row_number().over(Window.partitionBy("key", "text").orderBy(*order))).filter("nth = 1")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in df.columns])
