"""Document fingerprints: a homomorphic multiset hash of paragraphs, in built-in functions only.

Every paragraph hashes (MD5) to a wide vector: four numbers of 32 bits and 120 of their bits. A fingerprint is the number of
paragraphs and the sum of their vectors, numbers modulo ``2**60`` and bits modulo ``2**20``. Sums commute, so the order of
paragraphs does not matter; paragraphs are inserted or deleted by adding or subtracting their vectors (``insert``,
``delete``) without the rest of the text. The sums of numbers tell multisets apart, equal paragraphs in any number included.
With bits read as signs, the squared distance of two fingerprints estimates how many paragraphs they do not share, which
gives the likeness.

Paragraphs are the non-empty lines of a text; lines are divided after sentence ends, so that one-line texts still compare.
Null texts count as empty; an empty text has no paragraph and the zero fingerprint. Equal fingerprints have likeness 1, an
empty and another text have 0. Repeated rows get equal fingerprints; an empty table gives an empty result. Very long texts
cost time in proportion. Sums of numbers lose nothing below ``2**28`` paragraphs, sums of bits wrap where over a million
paragraphs are equal: equality, insertion and deletion stay right there, only the likeness is blurred.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from sieveline.llm.common import range_of, range_starts

#: numbers of a paragraph and the modulus of their sums
NUMBERS, WIDE = 4, 1 << 60
#: bits of a paragraph, the modulus of their sums, and how these are packed: three fields of 21 bits a number, the upper bit
#: of each a guard
WIDTH, MODULUS, FIELD, PACKED = 120, 1 << 20, 21, 3
_SPREAD = sum(1 << (FIELD - 1) * i for i in range(PACKED))
_ONES = sum(1 << FIELD * i for i in range(PACKED))
_FIELDS = sum(MODULUS - 1 << FIELD * i for i in range(PACKED))
_GUARDS = sum(MODULUS << FIELD * i for i in range(PACKED))
_PARTS = WIDTH // PACKED
#: packed sums that take their bits from the same number
_EACH = _PARTS // NUMBERS
#: hex digits of a sum of numbers and of packed sums of bits
_WIDE_DIGITS, _DIGITS = (WIDE.bit_length() + 2) // 4, (PACKED * FIELD + 3) // 4
#: characters of text in one range of neighbouring documents
RANGE_CHARS = 16_000_000


def paragraphs(text: str) -> str:
    """SQL: the paragraphs of a text."""
    return (f"filter(split(regexp_replace(coalesce({text}, ''), '([.!?])\\\\x20+', '$1\\n'), '\\n'), p -> p <> '')")


def fingerprint(text: str) -> Column:
    """The fingerprint of a text expression: a struct of n and the packed components."""
    words = ", ".join(f"CAST(conv(substring(d, {1 + 8 * k}, 8), 16, 10) AS BIGINT)" for k in range(NUMBERS))
    hashes = f"transform({paragraphs(text)}, p -> transform(array(md5(CAST(p AS BINARY))), d -> array({words}))[0])"
    bits = f"shiftright(h[CAST(k DIV {_EACH} AS INT)], CAST({PACKED} * (k % {_EACH}) AS INT)) & {(1 << PACKED) - 1}L"
    sums = f"transform(sequence(0, {NUMBERS - 1}), k -> aggregate(hs, 0L, (s, h) -> (s + h[k]) & {WIDE - 1}L))"
    parts = (f"transform(sequence(0, {_PARTS - 1}), k -> aggregate(hs, 0L, "
             f"(s, h) -> (s + (({bits}) * {_SPREAD}L & {_ONES}L)) & {_FIELDS}L))")
    return F.expr(f"transform(array({hashes}), hs -> named_struct('n', CAST(size(hs) AS BIGINT), 'sums', {sums}, "
                  f"'parts', {parts}))[0]")


def insert(a: Column, b: Column) -> Column:
    """The fingerprint of both multisets together."""
    return F.struct((a["n"] + b["n"]).alias("n"), F.zip_with(
        a["sums"], b["sums"], lambda x, y: (x + y).bitwiseAND(F.lit(WIDE - 1))).alias("sums"), F.zip_with(
        a["parts"], b["parts"], lambda x, y: (x + y).bitwiseAND(F.lit(_FIELDS))).alias("parts"))


def delete(a: Column, b: Column) -> Column:
    """The fingerprint of ``a`` without the paragraphs of ``b``."""
    return F.struct((a["n"] - b["n"]).alias("n"), F.zip_with(
        a["sums"], b["sums"], lambda x, y: (x - y).bitwiseAND(F.lit(WIDE - 1))).alias("sums"), F.zip_with(
        a["parts"], b["parts"],
        lambda x, y: (x.bitwiseOR(F.lit(_GUARDS)) - y).bitwiseAND(F.lit(_FIELDS))).alias("parts"))


def text_of(fp: str) -> Column:
    """A fingerprint as hex digits."""
    return F.expr(f"concat(lpad(lower(hex({fp}.n)), 8, '0'), "
                  f"array_join(transform({fp}.sums, x -> lpad(lower(hex(x)), {_WIDE_DIGITS}, '0')), ''), "
                  f"array_join(transform({fp}.parts, x -> lpad(lower(hex(x)), {_DIGITS}, '0')), ''))")


def likeness(a: str, b: str) -> Column:
    """From 0 to 1: twice the shared paragraphs over all paragraphs, as far as the vectors tell."""
    def signed(fp):
        # 2c - n, lifted to the value nearest zero
        return (f"transform(sequence(0, {WIDTH - 1}), j -> pmod(2 * (shiftright({fp}.parts[CAST(j DIV {PACKED} AS INT)], "
                f"CAST({FIELD} * (j % {PACKED}) AS INT)) & {MODULUS - 1}L) - {fp}.n + {MODULUS}L, {2 * MODULUS}L) - {MODULUS}L)")
    total = "aggregate({0}, 0L, (s, x) -> s + x)".format
    shared = total("zip_with(x, y, (v, w) -> v * w)")
    sizes = total("transform(x, v -> v * v)") + " + " + total("transform(y, v -> v * v)")
    return F.expr(
        f"CASE WHEN {a} = {b} THEN 1.0D WHEN {a}.n = 0 OR {b}.n = 0 THEN 0.0D ELSE "
        f"transform(array(named_struct('x', {signed(a)}, 'y', {signed(b)})), z -> transform(array(z.x), x -> "
        f"transform(array(z.y), y -> greatest(0.0D, least(1.0D, CAST(2 * {shared} AS DOUBLE) / "
        f"CAST(greatest(1L, {sizes}) AS DOUBLE))))[0])[0])[0] END")


def with_next(docs: DataFrame, key: str, text: str, range_chars: int = RANGE_CHARS) -> tuple:
    """Key k, text t and the text f of the next row in ascending order of the key (null first, ties by text).

    The row after the last is the first. Rows are dealt out by ranges of the key, the first rows of every range once more
    to the range before it (``copy`` over 0); no range grows with the table. Also returns the window of that order.
    """
    base = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    starts, nulls, _ = range_starts(base, range_chars)
    own, last = range_of(starts), max(0, len(starts) - 1)
    start = F.array(*(F.lit(s) for s in starts)) if starts else F.array(F.lit(None).cast("long"))
    before = F.when((F.element_at(start, own + 1) == F.col("k")) & (own > 0), own - 1)
    first = F.col("k").isNull() if nulls or not starts else F.col("k") == F.lit(starts[0])
    places = F.array_compact(F.array(
        F.struct(own.alias("range"), F.lit(0).alias("copy")),
        F.when(before.isNotNull(), F.struct(before.alias("range"), F.lit(1).alias("copy"))),
        F.when(first, F.struct(F.lit(last).alias("range"), F.lit(2).alias("copy")))))
    placed = base.select("k", "t", F.inline(places))
    order = Window.partitionBy("range").orderBy("copy", F.col("k").asc_nulls_first(), "t")
    return placed.withColumn("f", F.lead("t").over(order)), order


def edited_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", range_chars: int = RANGE_CHARS) -> DataFrame:
    """Fingerprints of every text, of its edited form and the likeness to that and to the next text.

    The edited form has the last quarter of the characters replaced by as many from the start of the next text.
    """
    placed, order = with_next(docs, key, text, range_chars)
    n = "length(t)"
    edited = F.expr(f"concat(substring(t, 1, {n} - {n} DIV 4), substring(coalesce(f, t), 1, CAST({n} DIV 4 AS INT)))")
    prints = placed.select("range", "copy", "k", "t", edited.alias("e")).select(
        "range", "copy", "k", "t", F.length("t").cast("long").alias("n_chars"), F.sha2(F.col("e").cast("binary"), 256).alias(
            "edited_sha256"), fingerprint("t").alias("a"), F.when(F.col("copy") == 0, fingerprint("e")).alias("b"))
    following = prints.withColumn("c", F.lead("a").over(order)).filter("copy = 0")
    return following.select(
        F.col("k").alias(key), "n_chars", "edited_sha256", text_of("a").alias("fingerprint"),
        text_of("b").alias("edited_fingerprint"), likeness("a", "b").alias("near_edited"),
        likeness("a", "c").alias("near_next"))


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
o AS (SELECT *, coalesce(lead(t) OVER w, first_value(t) OVER w) AS f FROM d
      WINDOW w AS (ORDER BY doc_id NULLS FIRST, t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT row_number() OVER () AS id, doc_id, t,
      substr(t, 1, length(t) - length(t) // 4) || substr(f, 1, length(t) // 4) AS e FROM o),
nx AS (SELECT id, coalesce(lead(id) OVER w, first_value(id) OVER w) AS nid FROM e
       WINDOW w AS (ORDER BY doc_id NULLS FIRST, t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
x AS (SELECT id, 'a' AS kind, t AS x FROM e UNION ALL SELECT id, 'b', e FROM e),
p AS (SELECT id, kind, md5(p) AS m FROM (SELECT id, kind,
      unnest(string_split(regexp_replace(x, '([.!?])\\x20+', '\\1' || chr(10), 'g'), chr(10))) AS p FROM x) WHERE p <> ''),
w AS (SELECT id, kind, [('0x' || substr(m, 1, 8))::BIGINT, ('0x' || substr(m, 9, 8))::BIGINT,
      ('0x' || substr(m, 17, 8))::BIGINT, ('0x' || substr(m, 25, 8))::BIGINT] AS h FROM p),
q AS (SELECT id, kind, [sum(h[1]) % {WIDE}, sum(h[2]) % {WIDE}, sum(h[3]) % {WIDE}, sum(h[4]) % {WIDE}]::BIGINT[] AS q
      FROM w GROUP BY id, kind),
c AS (SELECT id, kind, j, count(*) AS n, sum((h[1 + j // {PACKED * _EACH}] >> (j % {PACKED * _EACH})) & 1)::BIGINT % {MODULUS} AS c
      FROM w, range({WIDTH}) AS r(j) GROUP BY id, kind, j),
v AS (SELECT id, kind, any_value(n) AS n, list(c ORDER BY j) AS c,
      list(((2 * c - n + {MODULUS}) % {2 * MODULUS} + {2 * MODULUS}) % {2 * MODULUS} - {MODULUS} ORDER BY j) AS s
      FROM c GROUP BY id, kind),
z AS (SELECT x.id, x.kind, coalesce(n, 0) AS n, coalesce(c, list_transform(range({WIDTH}), lambda i: 0::BIGINT)) AS c,
      coalesce(s, list_transform(range({WIDTH}), lambda i: 0::BIGINT)) AS s,
      coalesce(q, [0, 0, 0, 0]::BIGINT[]) AS q FROM x LEFT JOIN v USING (id, kind) LEFT JOIN q USING (id, kind)),
t AS (SELECT id, kind, n, c, s, printf('%08x', n) || array_to_string(list_transform(q, lambda y: printf('%0{_WIDE_DIGITS}x', y)), '')
      || array_to_string(list_transform(range({_PARTS}), lambda k: printf('%0{_DIGITS}x',
      c[3 * k + 1] + (c[3 * k + 2] << {FIELD}) + (c[3 * k + 3] << {2 * FIELD}))), '') AS fp FROM z),
l AS (SELECT a.id, a.fp AS fingerprint, b.fp AS edited_fingerprint,
      CASE WHEN a.fp = b.fp THEN 1.0 WHEN a.n = 0 OR b.n = 0 THEN 0.0 ELSE greatest(0.0, least(1.0,
        (2 * list_dot_product(a.s::DOUBLE[], b.s::DOUBLE[])) / greatest(1.0, list_dot_product(a.s::DOUBLE[], a.s::DOUBLE[])
        + list_dot_product(b.s::DOUBLE[], b.s::DOUBLE[])))) END::DOUBLE AS near_edited,
      CASE WHEN a.fp = n.fp THEN 1.0 WHEN a.n = 0 OR n.n = 0 THEN 0.0 ELSE greatest(0.0, least(1.0,
        (2 * list_dot_product(a.s::DOUBLE[], n.s::DOUBLE[])) / greatest(1.0, list_dot_product(a.s::DOUBLE[], a.s::DOUBLE[])
        + list_dot_product(n.s::DOUBLE[], n.s::DOUBLE[])))) END::DOUBLE AS near_next
      FROM t AS a JOIN t AS b ON a.id = b.id AND a.kind = 'a' AND b.kind = 'b' JOIN nx ON nx.id = a.id
      JOIN t AS n ON n.id = nx.nid AND n.kind = 'a')
SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(e) AS edited_sha256, fingerprint, edited_fingerprint, near_edited,
       near_next FROM e JOIN l USING (id)
"""
