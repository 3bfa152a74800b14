"""The queries of the text operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_extraction, language_id, merkle, packing, quality_classifier, quality_rules, secret_scan, sharding, simhash_dedup, source_mixing
from .common import held_out, table

SHARDS = 8


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "band", "bad_chunks")


def op2_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(table(spark, sf_dir, "documents"))


def op4_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")


def op5_ftrl_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of ``documents`` in which no source is passed over more than twice as often as another."""
    mixed = source_mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "source", "mix_pass", "mix_block", "mix_rank", "mix_tokens", F.round("mix_weight", 6).alias("mix_weight"), F.round("mix_exponent", 6).alias("mix_exponent"))


def op7_tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extraction.extract_main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard_records(table(spark, sf_dir, "documents"), [1.0] * SHARDS, grown=[1.0] * (SHARDS + 1))
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op9_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_with_next(table(spark, sf_dir, "documents"))


def op10_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.Settings(tokenizer_path()))


QUERIES = {f.__name__: f for f in (op1_compression_bands, op2_simhash_trie, op3_cross_parsing, op4_randomness_battery, op5_ftrl_classifier, op6_temperature_mixing, op7_tag_path_ratios, op8_rendezvous, op9_merkle, op10_harmonic_packing)}


def _merkle_sql() -> str:
    """The trees by nested lists; the likeness by a row for each leaf, with and without the one before it."""
    power, half = (lambda n, k: f"({n}::BIGINT << ({k})::INT)"), (lambda x: f"({x} // {merkle.EACH})")
    start = lambda i: merkle.piece_start(i, power, half)
    size = power(merkle.PIECE, half("i"))

    def tree(text: str) -> str:
        leaves = f"list_transform(CASE WHEN p = '' THEN []::BIGINT[] ELSE range({merkle.piece_count('length(p)', power, '//')}) END, lambda i: md5(substring(p, {start('i')} + 1, {size})))"
        return f"list_transform(string_split({text}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: {{'n': length(p), 'x': {leaves}}}))"

    def mark(tree: str) -> str:
        of = "md5(p.n || ':' || array_to_string(p.x, ''))"
        section = f"md5(array_to_string(list_transform(s, lambda p: {of}), ''))"
        paragraph = f"left({of}, 8) || ',' || p.n || ',' || array_to_string(list_transform(p.x, lambda y: left(y, 8)), '.')"
        return f"left(sha256(array_to_string(list_transform({tree}, lambda s: {section}), '')), 32) || ':' || array_to_string(list_transform({tree}, lambda s: left({section}, 8) || '=' || array_to_string(list_transform(s, lambda p: {paragraph}), ';')), '/')"

    def leaves(c: str) -> str:
        pieces = f"list_transform(list_filter(string_split(string_split(p, ',')[3], '.'), lambda y: y <> ''), lambda y, j: {{'t': y, 'w': least({power(merkle.PIECE, half('(j - 1)'))}, string_split(p, ',')[2]::BIGINT - {start('(j - 1)')})}})"
        sep = lambda name, width, at: f"CASE WHEN {at} > 1 THEN [{{'t': '{name}', 'w': {width}::BIGINT}}] ELSE [] END"
        paragraphs = f"flatten(list_transform(string_split(substring(s, 10), ';'), lambda p, b: list_concat({sep('paragraph', 1, 'b')}, {pieces})))"
        return f"flatten(list_transform(string_split(substring({c}, 34), '/'), lambda s, a: list_concat({sep('section', 2, 'a')}, {paragraphs})))"

    def near(name: str, other: str) -> str:
        rows = " UNION ALL ".join(f"SELECT nth, {side} AS side, unnest(list_transform(l, lambda z, j: {{'t': CASE WHEN j = 1 THEN '' ELSE l[j - 1].t END || '>' || z.t, 'u': z.t, 'w': z.w}})) AS z FROM (SELECT nth, {leaves(c)} AS l FROM ef)" for side, c in ((0, "fingerprint"), (1, other)))
        return f"""{name}_leaves AS ({rows}), {name}_rows AS (SELECT nth, side, z.u AS t, z.w AS w FROM {name}_leaves UNION ALL SELECT nth, side, z.t, z.w FROM {name}_leaves),
    {name}_counts AS (SELECT nth, t, w, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM {name}_rows GROUP BY ALL), {name} AS (SELECT nth, sum(least(a, b) * w) AS common, sum((a + b) * w) AS total FROM {name}_counts GROUP BY 1)"""

    value = lambda name, other: f"CASE WHEN left(fingerprint, 32) = left({other}, 32) THEN 1.0::DOUBLE ELSE least((2 * {name}.common)::DOUBLE / {name}.total::DOUBLE, 1.0::DOUBLE - 1.0::DOUBLE / {name}.total::DOUBLE) END AS {name}"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    t AS (SELECT *, {tree('text')} AS tree FROM d),
    f AS (SELECT doc_id, text, {mark('tree')} AS fingerprint FROM t),
    o AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, md5(text), text) AS nth FROM f),
    n AS (SELECT o.*, p.text AS next_text, p.fingerprint AS next_fingerprint FROM o JOIN o p ON p.nth = CASE WHEN o.nth = (SELECT count(*) FROM f) THEN 1 ELSE o.nth + 1 END),
    e AS (SELECT *, substring(text, 1, length(text) - length(text) // 4) || substring(next_text, 1, length(text) // 4) AS edited FROM n),
    et AS (SELECT *, {tree('edited')} AS etree FROM e),
    ef AS (SELECT *, {mark('etree')} AS edited_fingerprint FROM et),
    {near('near_edited', 'edited_fingerprint')}, {near('near_next', 'next_fingerprint')}
    SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, fingerprint, edited_fingerprint, {value('near_edited', 'edited_fingerprint')}, {value('near_next', 'next_fingerprint')}
    FROM ef LEFT JOIN near_edited USING (nth) LEFT JOIN near_next USING (nth)"""


def _sharding_sql() -> str:
    """CRC-32 is not a function there; it is folded over the bytes with a table made by rule."""
    entries = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        entries.append(n)
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c >> 8, {entries}[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"

    def best(n: int) -> str:
        costs = ", ".join(f"{{'cost': -ln((('0x' || substring(md5(name || ':{i}'), 1, 13))::BIGINT + 0.5::DOUBLE) / {1 << 52}::DOUBLE), 'shard': {i}}}" for i in range(n))
        return f"list_min([{costs}]).shard"

    return f"""
    WITH d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS name, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
    s AS (SELECT doc_id, octet_length(encode(text)) + 1 AS size, {crc} AS text_crc32, {best(SHARDS)} AS shard, {best(SHARDS + 1)} AS grown_shard,
      ('0x' || substring(md5(name), 1, 6))::BIGINT % {sharding.BUCKETS} AS bucket FROM d)
    SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM s"""


def _mixing_sql() -> str:
    """The exponent that just keeps to the limit has a closed form, which stands in for the bisection."""
    limit, least = source_mixing.Target().repetition_limit, source_mixing.Target().blocks
    n = f"(SELECT {least} * (1 << least(15, greatest(0, ceil(log2(greatest(1, count(*)) / {least * source_mixing.BLOCK_ROWS}::DOUBLE))))::INT) FROM documents)"
    return f"""
    WITH d AS (SELECT doc_id, source, coalesce('+' || source, '-') AS src, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) + 1 AS tokens, md5(coalesce(doc_id::VARCHAR, '') || chr(10) || coalesce(text, '')) AS h FROM documents),
    k AS (SELECT *, ('0x' || substring(h, 1, 6))::BIGINT % {n} AS block FROM d),
    blocks AS (SELECT src, block, sum(tokens)::BIGINT AS size FROM k GROUP BY 1, 2), totals AS (SELECT src, sum(size)::BIGINT AS total FROM blocks GROUP BY 1),
    e AS (SELECT CASE WHEN max(total) <= {limit} * min(total) THEN 0.0::DOUBLE ELSE 1 - ln({limit}) / ln(max(total)::DOUBLE / min(total)) END AS e, max(total)::DOUBLE AS largest FROM totals),
    s AS (SELECT e, sum(pow(total::DOUBLE, e)) AS s, floor(sum(pow(total::DOUBLE, e)) * pow(any_value(largest), 1 - e) + 0.5) AS budget FROM totals, e GROUP BY e),
    p AS (SELECT src, total, e, pow(total::DOUBLE, e) / s AS weight, floor(pow(total::DOUBLE, e) / s * budget + 0.5)::BIGINT AS share FROM totals, s),
    r AS (SELECT b.src, block, size, weight, e, share // total AS whole, share % total AS part, sum(size) OVER (PARTITION BY b.src ORDER BY md5(b.src || ':' || (share // total + 1) || ':' || block)) AS upto FROM blocks b JOIN p USING (src)),
    t AS (SELECT *, part - upto + size AS room FROM r),
    c AS (SELECT k.src, k.block, k.h, room, sum(tokens) OVER (PARTITION BY k.src, k.block ORDER BY h) AS upto FROM k JOIN t ON t.src = k.src AND t.block = k.block WHERE room > 0 AND room < size),
    l AS (SELECT src, block, max(h) AS last FROM c WHERE upto <= room GROUP BY 1, 2),
    f AS (SELECT t.src, t.block, weight, e, whole, CASE WHEN room >= size THEN 'g' WHEN room > 0 THEN coalesce(l.last, '') ELSE '' END AS last FROM t LEFT JOIN l ON l.src = t.src AND l.block = t.block),
    g AS (SELECT *, unnest(range(1, whole + 2)) AS pass FROM f), o AS (SELECT *, row_number() OVER (PARTITION BY src, pass ORDER BY md5(src || ':' || pass || ':' || block)) AS rank FROM g)
    SELECT doc_id, source, pass AS mix_pass, k.block AS mix_block, rank AS mix_rank, tokens AS mix_tokens, round(weight, 6) AS mix_weight, round(e, 6) AS mix_exponent FROM k JOIN o ON o.src = k.src AND o.block = k.block WHERE pass <= whole OR h <= last"""


ORACLE_SQL = {"op6_temperature_mixing": _mixing_sql(), "op8_rendezvous": _sharding_sql(), "op9_merkle": _merkle_sql()}

__all__ = ["ORACLE_SQL", "QUERIES", "held_out", "tokenizer_path"]
