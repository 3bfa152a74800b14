"""Document fingerprints: Merkle trees over sections, paragraphs and pieces of paragraphs.

A text's sections are parted by empty lines (two line feeds), their paragraphs by line feeds. A paragraph's leaves are
pieces whose lengths double every few pieces, so a long paragraph has few leaves and a change at one place leaves the
others alone. Digests of leaves make that of a paragraph, those that of a section, those the root. A fingerprint holds
the whole tree with shortened digests, ``root:section/section``, each section as ``digest=paragraph;paragraph``, each
paragraph as ``digest,length,leaf.leaf``. Equal roots mean equal texts; ``differing`` walks two trees down the branches
that differ, to the pieces where the texts do; ``likeness`` is the share of text that two trees have in common, in the
same order. All of it is built-in functions; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: First piece of a paragraph in code points, and pieces of each length.
PIECE, EACH = 32, 4
#: Rows that a bucket of the order of ids aims at; buckets of the first and of the second level at most.
BUCKET_ROWS, COARSE, FINE = 2000, 256, 1024
#: The line feeds between sections and paragraphs, as leaves of a sequence.
SECTION, PARAGRAPH = "section:2", "paragraph:1"


def piece_start(i: str, power=lambda n, k: f"shiftleft({n}, {k})", half=lambda x: f"CAST({x} DIV {EACH} AS INT)") -> str:
    """SQL for where a paragraph's piece number ``i`` (from 0) starts, from 0. ``power`` and ``half`` say how the dialect
    doubles and divides."""
    k = half(i)
    return f"({PIECE * EACH} * ({power(1, k)} - 1) + ({i} % {EACH}) * {power(PIECE, k)})"


def piece_count(n: str, power=lambda n, k: f"shiftleft({n}, {k})", div="DIV") -> str:
    """SQL for the number of pieces of a paragraph of ``n`` code points (positive)."""
    k = f"(length(bin(({n} - 1) {div} {PIECE * EACH} + 1)) - 1)"
    return f"({EACH} * {k} + ({n} - {PIECE * EACH} * ({power(1, k)} - 1) - 1) {div} {power(PIECE, k)} + 1)"


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the fingerprint of a text column (named; null as empty). Each level of the tree is a step of its own, so no
    digest is made twice."""
    t = f"__tree_{name}"
    leaf = f"md5(substring(p, {piece_start('i')} + 1, shiftleft({PIECE}, CAST(i DIV {EACH} AS INT))))"
    leaves = f"CASE WHEN p = '' THEN CAST(array() AS ARRAY<STRING>) ELSE transform(sequence(0, CAST({piece_count('char_length(p)')} AS INT) - 1), i -> {leaf}) END"
    out = df.withColumn(t, F.expr(f"transform(split(coalesce({text}, ''), '\\n\\n'), s -> transform(split(s, '\\n'), p -> struct(char_length(p) AS n, {leaves} AS x)))"))
    out = out.withColumn(t, F.expr(f"transform({t}, s -> transform(s, p -> struct(md5(concat(p.n, ':', array_join(p.x, ''))) AS d, concat(p.n, ',', array_join(transform(p.x, y -> left(y, 8)), '.')) AS s)))"))
    out = out.withColumn(t, F.expr(f"transform({t}, s -> struct(md5(array_join(transform(s, p -> p.d), '')) AS d, array_join(transform(s, p -> concat(left(p.d, 8), ',', p.s)), ';') AS s))"))
    return out.withColumn(name, F.expr(f"concat(left(sha2(array_join(transform({t}, s -> s.d), ''), 256), 32), ':', array_join(transform({t}, s -> concat(left(s.d, 8), '=', s.s)), '/'))")).drop(t)


def _pieces(paragraph: str, each: str) -> str:
    """SQL for ``each`` of a paragraph of a fingerprint's leaves: of digest ``y``, number ``i`` and length ``{w}``."""
    width = f"CAST(least(shiftleft({PIECE}, CAST(i DIV {EACH} AS INT)), v.n - {piece_start('i')}) AS INT)"
    parsed = f"array(struct(CAST(element_at(split({paragraph}, ','), 2) AS INT) AS n, split(element_at(split({paragraph}, ','), 3), '[.]') AS x))"
    return f"flatten(transform({parsed}, v -> transform(filter(v.x, y -> v.n > 0), (y, i) -> {each.format(w=width)})))"


def _sequence(fingerprint: str) -> str:
    """SQL for the leaves in order, ``digest:length``, with the line feeds between them as leaves of their own."""
    mark = lambda leaf, at: f"filter(array('{leaf}'), z -> {at} > 0)"
    paragraphs = f"flatten(transform(split(substring(s, 10), ';'), (p, b) -> concat({mark(PARAGRAPH, 'b')}, {_pieces('p', "concat(y, ':', {w})")})))"
    return f"flatten(transform(split(substring({fingerprint}, 34), '/'), (s, a) -> concat({mark(SECTION, 'a')}, {paragraphs})))"


def with_likeness(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Adds the likeness of two fingerprint columns (named), from 0 to 1, and 1 only if the roots are equal.

    Every leaf counts once by itself and once together with the leaf before it, so half of the likeness is what the
    texts hold and half the order they hold it in; each counts as often as it occurs, by its length."""
    x, y, u, v, total, marks = (f"__{k}_{name}" for k in ("x", "y", "u", "v", "total", "marks"))
    width = lambda z: f"CAST(substring_index({z}, ':', -1) AS BIGINT)"
    number = lambda c, leaf: f"size(filter({c}, z -> z = '{leaf}'))"
    own = lambda c: f"concat(filter({c}, z -> z NOT IN ('{SECTION}', '{PARAGRAPH}')), transform({c}, (z, i) -> concat(CASE WHEN i = 0 THEN '' ELSE {c}[i - 1] END, '>', z)))"
    once = lambda c: f"size(array_distinct({c})) = size({c})"
    out = df.withColumn(x, F.expr(_sequence(a))).withColumn(y, F.expr(_sequence(b)))
    out = out.withColumn(total, F.expr(f"2 * (aggregate({x}, 0L, (s, z) -> s + {width('z')}) + aggregate({y}, 0L, (s, z) -> s + {width('z')}))"))
    out = out.withColumn(marks, F.expr(f"2 * least({number(x, SECTION)}, {number(y, SECTION)}) + least({number(x, PARAGRAPH)}, {number(y, PARAGRAPH)})"))
    out = out.withColumn(u, F.expr(own(x))).withColumn(v, F.expr(own(y)))
    # where nothing occurs twice, what both have is a set; else all is counted in sorted order
    tagged = f"array_sort(concat(transform({u}, z -> struct(z AS t, 0 AS side)), transform({v}, z -> struct(z AS t, 1 AS side))))"
    start = "named_struct('t', '', 'a', 0, 'b', 0, 'common', 0L)"
    closed = f"s.common + CASE WHEN s.a > 0 AND s.b > 0 THEN least(s.a, s.b) * {width('s.t')} ELSE 0L END"
    step = f"CASE WHEN s.t = z.t THEN named_struct('t', s.t, 'a', s.a + 1 - z.side, 'b', s.b + z.side, 'common', s.common) ELSE named_struct('t', z.t, 'a', 1 - z.side, 'b', z.side, 'common', {closed}) END"
    common = f"CASE WHEN {once(u)} AND {once(v)} THEN aggregate(array_intersect({u}, {v}), 0L, (s, z) -> s + {width('z')}) ELSE aggregate({tagged}, {start}, (s, z) -> {step}, s -> {closed}) END"
    value = f"CASE WHEN left({a}, 32) = left({b}, 32) THEN 1.0D ELSE least(CAST(2 * ({marks} + {common}) AS DOUBLE) / {total}, 1.0D - 1.0D / {total}) END"
    return out.withColumn(name, F.expr(value)).drop(x, y, u, v, total, marks)


def differing(a: str, b: str) -> Column:
    """The places in the text of fingerprint column ``a`` (named) that the text of ``b`` lacks: an array of ``section``,
    ``paragraph`` (within the section) and ``start`` and ``length`` (code points within the paragraph), by place.

    Only sections whose digest ``b`` lacks are entered, only paragraphs of those whose digest is in none of the
    sections of ``b`` that ``a`` lacks, and so with pieces. What ``b`` has and ``a`` lacks is ``differing(b, a)``; what
    has only moved is in neither."""
    sections = lambda c: f"split(substring({c}, 34), '/')"
    lacking = lambda c, o: f"filter({sections(c)}, s -> NOT array_contains(transform({sections(o)}, z -> left(z, 8)), left(s, 8)))"
    paragraphs = f"flatten(transform({lacking(b, a)}, s -> split(substring(s, 10), ';')))"
    own = f"flatten(transform({lacking(a, b)}, s -> transform(split(substring(s, 10), ';'), p -> left(p, 8))))"
    leaves = f"flatten(transform(filter({paragraphs}, p -> NOT array_contains({own}, left(p, 8))), p -> {_pieces('p', 'y')}))"
    entered = f"filter(transform({sections(a)}, (s, k) -> struct(k AS k, s AS s)), x -> NOT array_contains(transform({sections(b)}, z -> left(z, 8)), left(x.s, 8)))"
    below = f"filter(transform(split(substring(x.s, 10), ';'), (p, m) -> struct(m AS m, p AS p)), q -> NOT array_contains(transform({paragraphs}, z -> left(z, 8)), left(q.p, 8)))"
    pieces = _pieces("q.p", f"struct(y AS t, struct(x.k AS section, q.m AS paragraph, CAST({piece_start('i')} AS INT) AS start, {{w}} AS length) AS place)")
    empty = "CASE WHEN split(q.p, ',')[1] = '0' THEN array(struct(x.k AS section, q.m AS paragraph, 0 AS start, 0 AS length)) END"
    found = f"coalesce({empty}, transform(filter({pieces}, z -> NOT array_contains({leaves}, z.t)), z -> z.place))"
    return F.expr(f"flatten(transform({entered}, x -> flatten(transform({below}, q -> {found}))))")


def with_next(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Adds ``next_<value>``: the value in the row with the next key (after the last row, of the first); nulls first,
    rows with the same key by the MD5 of the first value and then by the values. Keys are integers or strings (by
    their bytes); others raise TypeError.

    The order is cut into buckets: at quantiles of the keys, evenly between these, and rows whose key is a quantile,
    as every key is that many rows share, apart from these by their MD5. The first row of each bucket is copied to the
    end of the one before it, so that each bucket finds all its successors by itself.
    """
    kind = dict(df.dtypes)[key]
    if kind not in ("tinyint", "smallint", "int", "bigint", "string"):
        raise TypeError(f"keys of type {kind} have no buckets")
    pos = f"CAST({key} AS BIGINT)" if kind != "string" else f"CAST(conv(rpad(left(hex(encode({key}, 'UTF-8')), 12), 12, '0'), 16, 10) AS BIGINT)"
    keyed = df.withColumn("__pos", F.expr(pos)).withColumn("__h", F.md5(F.coalesce(F.col(values[0]).cast("string"), F.lit(""))))
    found = keyed.agg(F.count("*").alias("n"), F.min("__pos").alias("a"), F.max("__pos").alias("z"), F.percentile_approx("__pos", [i / COARSE for i in range(1, COARSE)], 10_000).alias("q")).first()
    n, low, high = found["n"], found["a"] or 0, found["z"] or 0
    coarse = max(1, min(COARSE, -(-n // BUCKET_ROWS)))
    fine = max(1, min(FINE, -(-n // (coarse * BUCKET_ROWS))))
    bounds = [low, *sorted({q for q in (found["q"] or [])[COARSE // coarse - 1 :: COARSE // coarse] if q > low})]
    number = lambda b: f"{b}L" if b > -(2**63) else f"(-{2**63 - 1}L - 1L)"
    lows = "array(" + ", ".join(map(number, bounds)) + ")"
    spans = "array(" + ", ".join(f"{float(max(1, b - a))!r}D" for a, b in zip(bounds, [*bounds[1:], high + 1])) + ")"
    keyed = keyed.withColumn("__c", F.expr(f"CASE WHEN __pos IS NULL THEN 0 ELSE size(filter({lows}, b -> b <= __pos)) END"))
    keyed = keyed.withColumn("__b", F.expr(f"CASE WHEN __c = 0 OR __pos = element_at({lows}, greatest(__c, 1)) THEN 0 ELSE 1 END"))
    parts = {}
    if n > BUCKET_ROWS and kind != "string":  # rows with one key, of which a bucket has many: at most COARSE counts
        parts = {r["__c"]: min(FINE, -(-r["n"] // BUCKET_ROWS)) for r in keyed.filter("__b = 0").groupBy("__c").agg(F.count("*").alias("n")).collect()}
    of = "array(" + ", ".join(str(parts.get(c, 1)) for c in range(len(bounds) + 1)) + ")"
    share = "CAST(conv(left(__h, 8), 16, 10) AS BIGINT) / 4294967296.0D"
    between = f"(CAST(__pos AS DOUBLE) - CAST(element_at({lows}, greatest(__c, 1)) AS DOUBLE)) / element_at({spans}, greatest(__c, 1))"
    keyed = keyed.withColumn("__f", F.expr(f"CAST(CASE WHEN __b = 0 THEN floor({share} * {of}[__c]) ELSE least({fine - 1}, floor({between} * {fine})) END AS INT)"))
    heads = keyed.groupBy("__c", "__b", "__f").agg(F.min(F.struct(key, "__h")).alias("head"))  # at most 2 * COARSE * FINE rows
    order, back = Window.orderBy("__c", "__b", "__f"), Window.orderBy(F.desc("__c"), F.desc("__b"), F.desc("__f"))
    place = F.struct(F.col("__c").alias("c"), F.col("__b").alias("b"), F.col("__f").alias("f"))
    heads = heads.select(place.alias("__at"), F.col("head").getField(key).alias("__hk"), F.col("head.__h").alias("__hh"), F.coalesce(F.lag(place).over(order), F.first(place).over(back)).alias("__before"))
    rows = keyed.withColumn("__at", place).drop("__pos", "__c", "__b", "__f")
    rows = rows.withColumnRenamed("__at", "__own").join(F.broadcast(heads), F.expr(f"__own = __at AND {key} <=> __hk AND __h = __hh"), "left")
    spread = rows.withColumn("__to", F.explode(F.expr("filter(array(struct(__own AS at, 0 AS copy), struct(__before AS at, 1 AS copy)), x -> x.at IS NOT NULL)")))
    names = [f"`{c}`" for c in df.columns]
    spread = spread.select(*names, "__h", F.col("__to.at.c").alias("__c"), F.col("__to.at.b").alias("__b"), F.col("__to.at.f").alias("__f"), F.col("__to.copy").alias("__copy"))
    w = Window.partitionBy("__c", "__b", "__f").orderBy("__copy", F.col(key).asc_nulls_first(), "__h", *[F.col(v).asc_nulls_first() for v in values])
    nexts = spread.select(*names, "__copy", *[F.lead(v).over(w).alias(f"next_{v}") for v in values])
    return nexts.filter("__copy = 0").drop("__copy")


def fingerprint_documents(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per input row: the id and ``fingerprint``.

    Defined cases: null text as empty text (its tree has one empty paragraph and no leaves); a line feed more or less
    changes the root; repeated rows give a row each; an empty table gives an empty table; a null id stays null.
    """
    return with_fingerprint(df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "text", "fingerprint").drop("text")


def compare_with_next(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per input row: the id, ``n_chars``, the fingerprints of its text and of its edited text (the last quarter
    of its code points replaced by the first as many of the next row's text), the SHA-256 of the edited text, and
    the likeness of its fingerprint to the edited text's and to the next row's.

    Defined cases: as for ``with_next`` and ``fingerprint_documents``; the only row of a table is its own next.
    """
    docs = with_fingerprint(df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "text", "fingerprint")
    pairs = with_next(docs, id_col, ["text", "fingerprint"])
    edited = F.expr("concat(left(text, char_length(text) - char_length(text) div 4), left(next_text, char_length(text) div 4))")
    both = with_fingerprint(pairs.withColumn("edited", edited), "edited", "edited_fingerprint")
    out = both.select(id_col, F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "next_fingerprint")
    out = with_likeness(with_likeness(out, "fingerprint", "edited_fingerprint", "near_edited"), "fingerprint", "next_fingerprint", "near_next")
    return out.drop("next_fingerprint")
