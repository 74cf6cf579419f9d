"""One registered query per training-data operator, with its DuckDB twin.

Every query applies its operator, with its production parameters, to the whole
table. ``ORACLE`` lacks the operators that SQL cannot express (models, BPE).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, conversations, fingerprint as fp, langid, minhash, mixing, padded_bpe, pii, quality, suffix_dedup, toxicity, vafile, variants
from .common import LOWER, UPPER, documents, fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql.strip()
        return fn
    return deco


WORDS_SQL = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"


def _near_sql(a: str, b: str) -> str:
    return (f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0::DOUBLE ELSE "
            f"len(list_intersect(list_sort(list_distinct(list_concat({a}, {b})))[1:{fp.K}], list_intersect({a}, {b})))::DOUBLE "
            f"/ len(list_sort(list_distinct(list_concat({a}, {b})))[1:{fp.K}]) END")


@register("op1_fingerprints", f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, row_number() OVER o AS r,
    coalesce(lead(text) OVER o, '') AS nt, row_number() OVER o = count(*) OVER () AS is_last,
    first_value(coalesce(text, '')) OVER o AS ft FROM documents WINDOW o AS (ORDER BY doc_id NULLS FIRST, text NULLS FIRST)),
e AS (SELECT doc_id, r, n, t, substr(t, 1, n - n // 2) || substr(CASE WHEN is_last THEN ft ELSE nt END, 1, n // 2) AS ed FROM d),
w AS (SELECT r, 'a' AS side, {WORDS_SQL.format('t')} AS w FROM e UNION ALL SELECT r, 'b', {WORDS_SQL.format('ed')} FROM e),
u AS (SELECT r, side, len(w) AS n, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT r, side, n, i, concat_ws(' ', x, {', '.join(f'lead(x, {j}) OVER z' for j in range(1, fp.SHINGLE))}) AS g
    FROM u WINDOW z AS (PARTITION BY r, side ORDER BY i)),
h AS (SELECT DISTINCT r, side, substr(md5(g), 1, 16) AS h FROM g WHERE i <= greatest(n - {fp.SHINGLE - 1}, 1)),
l AS (SELECT r, side, list(h ORDER BY h)[1:{fp.K}] AS l FROM h GROUP BY r, side),
s AS (SELECT doc_id, n, ed, e.r, coalesce(x.l, []) AS a, coalesce(y.l, []) AS b FROM e
    LEFT JOIN l x ON x.r = e.r AND x.side = 'a' LEFT JOIN l y ON y.r = e.r AND y.side = 'b'),
c AS (SELECT *, coalesce(lead(a) OVER (ORDER BY r), first_value(a) OVER (ORDER BY r)) AS c FROM s)
SELECT doc_id, n::BIGINT AS n_chars, sha256(ed) AS edited_sha256, array_to_string(a, ',') AS fingerprint,
  array_to_string(b, ',') AS edited_fingerprint, {_near_sql('a', 'b')} AS near_edited, {_near_sql('a', 'c')} AS near_next,
  CASE WHEN len(a) < {fp.K} THEN len(a)::DOUBLE
    ELSE {float(fp.K - 1)} / (('0x' || substr(a[{fp.K}], 1, 13))::BIGINT::DOUBLE / {float(1 << 52)}) END AS n_shingles_est
FROM c""")
def op1_fingerprints(spark, sf_dir):
    d = fp.fingerprint_edits(documents(spark, sf_dir))
    return d.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                    F.array_join("sketch", ",").alias("fingerprint"),
                    F.array_join("edited_sketch", ",").alias("edited_fingerprint"), "near_edited", "near_next",
                    fp.distinct_shingles(F.col("sketch")).alias("n_shingles_est"))


# ---------------------------------------------------------------- 9: personal data

_DIG = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN_SQL = (f"list_sum(list_transform(range(1, length({_DIG}) + 1), lambda j: CASE WHEN j % 2 = 1 THEN substr(reverse({_DIG}), j, 1)::INT "
             f"WHEN substr(reverse({_DIG}), j, 1)::INT > 4 THEN 2 * substr(reverse({_DIG}), j, 1)::INT - 9 "
             f"ELSE 2 * substr(reverse({_DIG}), j, 1)::INT END)) % 10 = 0")
_IBAN_MOVED = "substr(replace(v, ' ', ''), 5) || substr(replace(v, ' ', ''), 1, 4)"
_MOD97_SQL = (f"list_reduce(list_transform(string_split(array_to_string(list_transform(string_split({_IBAN_MOVED}, ''), "
              f"lambda c: CASE WHEN c BETWEEN 'A' AND 'Z' THEN (ascii(c) - 55)::VARCHAR ELSE c END), ''), ''), lambda c: c::INT), "
              f"lambda a, d: (a * 10 + d) % 97) = 1")


def _pii_check_sql(k) -> str:
    count = f"length({_DIG}) BETWEEN {k.digits[0]} AND {k.digits[1]}"
    return {"none": "true", "octets": rf"regexp_matches(v, '^{pii.OCTET}(?:\.{pii.OCTET}){{3}}$')", "digits": count,
            "luhn": f"CASE WHEN {count} THEN {_LUHN_SQL} ELSE false END", "mod97": _MOD97_SQL}[k.check]


def _pii_sql() -> str:
    parts = []
    for n, k in enumerate(pii.KINDS):
        parts.append(f"""k{n} AS (SELECT rid, {n} AS kn, '{k.name}' AS kind, {str(k.base).lower()} AS base, m[i] AS v,
    (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::BIGINT AS s
    FROM (SELECT rid, m, p, unnest(range(1, len(m) + 1)) AS i FROM (SELECT rid, regexp_extract_all(t, '{k.plain}') AS m,
    string_split_regex(t, '{k.plain}') AS p FROM d))),
c{n} AS (SELECT rid, kn, kind, base, s, s + length(v) AS e FROM k{n} JOIN d USING (rid) WHERE ({_pii_check_sql(k)}) AND (base OR
    least({k.score} + CASE WHEN regexp_matches(lower(right(left(t, s), {pii.BEFORE}) || ' ' || substr(t, s + length(v) + 1, {pii.AFTER})), '{k.context}')
      THEN {pii.CONTEXT_BONUS} ELSE 0.0 END, 1.0) >= {pii.THRESHOLD}))""")
    every = " UNION ALL ".join(f"SELECT * FROM c{n}" for n in range(len(pii.KINDS)))
    counts = ", ".join(f"count(*) FILTER (kind = '{k.name}') AS n_{k.name}" for k in pii.KINDS if k.base)
    zero = ", ".join(f"coalesce(n_{k.name}, 0)::BIGINT AS n_{k.name}" for k in pii.KINDS if k.base)
    listed = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY kn, s)"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
{', '.join(parts)},
g AS (SELECT rid, {counts}, {listed} FILTER (base) AS b, {listed} AS a FROM ({every}) GROUP BY rid)
SELECT doc_id, {zero}, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans FROM d LEFT JOIN g USING (rid)"""


@register("op9_pii", _pii_sql())
def op9_pii(spark, sf_dir):
    d = pii.find_spans(documents(spark, sf_dir).select("doc_id", "text"))
    base = [k.name for k in pii.KINDS if k.base]

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(*names):
        return F.filter("spans", lambda s: s["kind"].isin(*names))
    counts = [F.size(of(n)).cast("bigint").alias(f"n_{n}") for n in base]
    return d.select("doc_id", *counts, F.sha2(listed(of(*base)), 256).alias("base_sha256"),
                    listed(F.col("spans")).alias("spans"))


# ---------------------------------------------------------------- 4: mixing sources


@register("op4_mixing", rf"""
WITH d AS (SELECT doc_id, source, len({WORDS_SQL.format('text')})::BIGINT AS size,
    md5('{mixing.SEED}:' || doc_id) AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT *, CASE (k - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, {mixing.MAX_REPEATS} * source_size AS cap FROM s),
o AS (SELECT *, cap::DOUBLE / w AS ratio, {mixing.SHARE} * (SELECT sum(source_size) FROM s)::DOUBLE AS total,
    coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS caps_before,
    sum(w) OVER (ORDER BY cap::DOUBLE / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS weight_left FROM w),
p AS (SELECT *, ratio <= (total - caps_before) / weight_left AS capped FROM o),
l AS (SELECT total - coalesce(sum(cap) FILTER (capped), 0)::DOUBLE AS rest, sum(w) FILTER (NOT capped) AS weight FROM p GROUP BY total),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE rest / weight::DOUBLE * w END AS target FROM p, l),
q AS (SELECT *, least(source_size, floor(target))::BIGINT AS q0, (floor(target) - least(source_size, floor(target)))::BIGINT AS q1 FROM t),
r AS (SELECT d.*, source_size, target, q0, q1, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY u, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(size, q0 - before)) + greatest(0, least(size, q1 - before)))::BIGINT AS taken FROM r""")
def op4_mixing(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    rows = mixing.prepare(docs, F.col("doc_id"), F.col("text"), F.array("source")).select("doc_id", "source", "_mix")
    mix = mixing.plan_mix(rows)
    found = mixing.taken(rows, mix).alias("d").join(mix.sources.alias("s"), F.expr("d.source <=> s.source"), "left")
    return found.select("doc_id", F.col("_mix.size").alias("size"), "source_size", "target", "taken")


# ---------------------------------------------------------------- 7: BPE


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@register("op7_bpe")
def op7_bpe(spark, sf_dir):
    d = bpe.encode_texts(documents(spark, sf_dir).select("doc_id", "text"), vocabulary_path())
    return d.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                    F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                    F.sha2("decoded", 256).alias("decoded_sha256"))


# ---------------------------------------------------------------- 2: language


@register("op2_langid")
def op2_langid(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = langid.train(docs.where(~held_out))
    d = langid.label(docs.select("doc_id", "text"), model)
    spans = F.transform("lang_spans", lambda s: F.concat_ws(":", s["lang"], s["start"].cast("string"), s["end"].cast("string")))
    return d.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"),
                    F.array_join(spans, ",").alias("spans"))


# ---------------------------------------------------------------- 10: exact top-k


@register("op10_topk", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM p QUALIFY rank <= 10""")
def op10_topk(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = vafile.top_k(rows, "vec_id", vafile.scaled(F.col("embedding")), F.col("id") % 100 == 0)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


# ---------------------------------------------------------------- 3, 6: classifiers


def texts_and_labels(spark, sf_dir, mod: int, held: int):
    """Documents (doc_id, text), the labels to learn from, and the condition for what is held out."""
    held_out = fold(F.col("doc_id"), mod) == held
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return documents(spark, sf_dir).select("doc_id", "text"), labels.where(~held_out), held_out


@register("op3_quality")
def op3_quality(spark, sf_dir):
    docs, labels, held_out = texts_and_labels(spark, sf_dir, 3, 1)
    net = quality.train(docs, labels, "doc_id", "text", "quality")
    d = quality.score(docs, net, out="score")
    return d.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@register("op6_toxicity")
def op6_toxicity(spark, sf_dir):
    docs, labels, held_out = texts_and_labels(spark, sf_dir, 4, 2)
    model = toxicity.train(docs, labels, "doc_id", "text", "toxic")
    d = toxicity.score(docs, model, out="score")
    return d.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


# ---------------------------------------------------------------- 5: near duplicates


@register("op5_near_duplicates", rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM d),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb
    FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r(id, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id WHERE r.c < e.b),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, c AS component_id, c = doc_id AS kept FROM s JOIN m ON id = doc_id""")
def op5_near_duplicates(spark, sf_dir):
    d = minhash.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), width=2, percent=80)
    return d.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")


# ---------------------------------------------------------------- 8: repeated passages


@register("op8_suffix_dedup", f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS x, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, p, x[p + 1 : p + {suffix_dedup.LENGTH}] AS s
    FROM (SELECT doc_id, x, unnest(range(0, n - {suffix_dedup.LENGTH - 1})) AS p FROM d)),
f AS (SELECT s, min((doc_id, p)) AS lead FROM w GROUP BY s HAVING count(*) > 1),
l AS (SELECT w.doc_id, w.p FROM w JOIN f USING (s) WHERE (w.doc_id, w.p) > f.lead),
i AS (SELECT *, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {suffix_dedup.LENGTH}, true) AS fresh FROM l),
g AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM i),
r AS (SELECT doc_id, k, min(p) AS a, max(p) + {suffix_dedup.LENGTH} AS b FROM g GROUP BY doc_id, k),
c AS (SELECT r.doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY r.doc_id ORDER BY a), 0) AS z,
    lead(a) OVER (PARTITION BY r.doc_id ORDER BY a) IS NULL AS is_last, n, x FROM r JOIN d USING (doc_id)),
t AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans,
    string_agg(hex(x[z + 1 : a]) || CASE WHEN is_last THEN hex(x[b + 1 : n]) ELSE '' END, '' ORDER BY a) AS y FROM c GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(y, hex(x)))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)""")
def op8_suffix_dedup(spark, sf_dir):
    d = suffix_dedup.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return d.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
                    F.sha2("kept", 256).alias("kept_sha256"))


# ---------------------------------------------------------------- 11: BPE on padded matrices


@register("op11_padded_bpe")
def op11_padded_bpe(spark, sf_dir):
    import public_tokenizers

    d = padded_bpe.encode_texts(documents(spark, sf_dir).select("doc_id", "text"),
                                public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return d.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                    F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                    F.sha2("decoded", 256).alias("decoded_sha256"))


# ---------------------------------------------------------------- CRC-32 in SQL (DuckDB has none)

#: A one-row table (c256) of the 256 remainders, by the rule of the reflected polynomial, and (hx) the number of each byte's hex text.
CRC_CTE = """ct AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1
    THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS c256,
    map_from_entries(list_transform(range(256), lambda i: {'k': upper(printf('%02x', i)), 'v': i})) AS hx)"""


def crc_sql(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes; ``ct`` must be among the tables."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: hx[h])"
    return (f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, c256[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)")


# ---------------------------------------------------------------- 13: spelling variants

#: Fixed value: a run whose checksum this divides is misspelt first.
MISSPELL = 199
_RUNS_SQL = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[{variants.LETTERS}]+')"


@register("op13_variants", f"""
WITH RECURSIVE {CRC_CTE},
u AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest({_RUNS_SQL}) AS r FROM documents),
g AS (SELECT d, r, count(*) AS k FROM u WHERE length(r) >= {variants.MIN_LENGTH} GROUP BY d, r),
h AS (SELECT r, k, {crc_sql("d || ':' || r")} AS h FROM g, ct),
w AS (SELECT CASE WHEN h % {MISSPELL} = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS w, sum(k)::BIGINT AS n
    FROM h GROUP BY 1 HAVING length(w) >= {variants.MIN_LENGTH} AND sum(k) >= {variants.MIN_COUNT}),
i AS (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM w),
c AS (SELECT DISTINCT w, n, substr(w, 1, i - 1) || substr(w, i + 1) AS s FROM i),
m AS (SELECT w, n, substr(w, 1, i - 1) || '*' || substr(w, i + 1) AS s FROM i),
e AS (SELECT c.w AS a, c.n AS na, w.w AS b, w.n AS nb FROM c JOIN w ON c.s = w.w
    UNION ALL SELECT w.w, w.n, c.w, c.n FROM c JOIN w ON c.s = w.w
    UNION ALL SELECT x.w, x.n, y.w, y.n FROM m x JOIN m y ON x.s = y.s AND x.w <> y.w),
b AS (SELECT a, count(*) AS n_near, min({{'m': -nb, 'w': b}}) AS best, any_value(na) AS na FROM e GROUP BY a),
f AS (SELECT w, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best.m >= {variants.FACTOR} * n THEN best.w END AS form,
    (CASE WHEN -best.m >= {variants.FACTOR} * n THEN -best.m END)::BIGINT AS form_n FROM w LEFT JOIN b ON a = w),
r(w, z, form) AS (SELECT w, w, form FROM f UNION ALL SELECT r.w, f.w, f.form FROM r JOIN f ON r.form = f.w)
SELECT f.w AS word, f.form, r.z AS root, f.n, n_near, form_n FROM f JOIN r ON r.w = f.w AND r.form IS NULL""")
def op13_variants(spark, sf_dir):
    return variants.group_variants(variants.count_words(documents(spark, sf_dir), misspell=MISSPELL))


# ---------------------------------------------------------------- 12: conversation repair

_WHITE_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@register("op12_conversations", f"""
WITH RECURSIVE {CRC_CTE},
z AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS f FROM conversations, ct),
d AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy,
    CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM z WHERE f <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, left(role, 1) AS c,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen, rtrim(text, {_WHITE_SQL}) AS bare FROM d),
r AS (SELECT *, CASE WHEN bare = '' THEN 'b' WHEN seen THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
    coalesce(c || lead(c) OVER (PARTITION BY conv_id ORDER BY i) NOT IN ('su', 'ua', 'au'), false) AS illegal FROM o),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (illegal) AS illegal, count(*) AS n FROM r GROUP BY conv_id),
n(st, ins, mid, ic, lines) AS (VALUES (0, '', 0, 0, []), (0, 'I', 2, 5, ['user:']), (0, 'II', 3, 10, ['user:', 'assistant:']),
    (1, '', 1, 0, []), (1, 'I', 2, 5, ['user:']), (1, 'II', 3, 10, ['user:', 'assistant:']), (2, '', 2, 0, []), (2, 'I', 3, 5, ['assistant:']),
    (2, 'II', 2, 10, ['assistant:', 'user:']), (3, '', 3, 0, []), (3, 'I', 2, 5, ['user:']), (3, 'II', 3, 10, ['user:', 'assistant:'])),
e AS (SELECT n.*, l, CASE WHEN mid = 2 THEN 3 ELSE 2 END AS nxt FROM n, (VALUES ('D'), ('K'), ('R')) AS x(l)),
w(conv_id, i, st, best) AS (SELECT conv_id, 0::BIGINT, 0, {{'c': 0::BIGINT, 'a': '', 'x': []::VARCHAR[]}} FROM s UNION ALL
  SELECT w.conv_id, w.i + 1, CASE WHEN l = 'D' THEN mid WHEN l = 'K' AND r.c = 's' THEN 1 ELSE nxt END,
    min({{'c': best.c + ic + (CASE l WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END) + CASE WHEN l <> 'D' AND fault = 't' THEN 5 ELSE 0 END,
      'a': best.a || ins || l, 'x': list_concat(best.x, lines, CASE l WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [r.role || ':' || r.text]
        ELSE [CASE WHEN nxt = 2 THEN 'user:' ELSE 'assistant:' END || r.text] END)}})
  FROM w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1 JOIN e ON e.st = w.st
  WHERE l = 'D' OR fault NOT IN ('b', 'd') AND (l = 'R' OR (r.c = 's' AND mid = 0) OR (r.c = 'u' AND nxt = 2) OR (r.c = 'a' AND nxt = 3)) GROUP BY 1, 2, 3),
f AS (SELECT w.conv_id, min({{'c': best.c + ic, 'a': best.a || ins, 'x': list_concat(best.x, lines)}}) AS best FROM w JOIN s ON s.conv_id IS NOT DISTINCT FROM w.conv_id
    AND w.i = s.n JOIN n ON n.st = w.st WHERE n.mid = 3 OR (n.mid = 0 AND n.ins = '') GROUP BY w.conv_id)
SELECT q.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit,
  sha256(coalesce(array_to_string(best.x, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM q.conv_id LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM q.conv_id""")
def op12_conversations(spark, sf_dir):
    rows, present = conversations.damage(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return conversations.repair(rows, present=present)
