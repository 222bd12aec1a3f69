"""The document operators as registered queries over the given tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard_join, lattice_lm, line_rules, merkle, mixing, packing, pii_crf, quality_mil, run_detection, simhash_tiles, spelling_trie, toxicity, url_filter
from .common import WORD, held_out, lower_ascii

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECE_VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
THRESHOLD = 0.7


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out(F.col("doc_id"), 4, 2)
    model = quality_mil.fit_quality(docs.where(~out), _read(spark, sf_dir, "labels"))
    scored = quality_mil.score_quality(docs, model)
    return scored.select("doc_id", out.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))


def op2_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out(F.col("doc_id"), 7, 2)
    scored = lattice_lm.lattice_scores(docs.withColumn("learn", F.col("doc_id").isNotNull() & ~out), PIECE_VOCABULARY)
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out(F.col("doc_id"), 3, 1)
    model = toxicity.fit_toxicity(docs.where(~out), _read(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", out.alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= THRESHOLD).cast("int").alias("predicted"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(_read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(_read(spark, sf_dir, "documents").select("doc_id", "text"), WORD_TOKENIZER)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", pii_crf.pii_spans(F.col("text"), pii_crf.train()).alias("f"))
    return found.select("doc_id", "f.n_email", "f.n_ip", "f.n_card", "f.n_phone", F.sha2("f.base", 256).alias("base_sha256"), F.col("f.spans").alias("spans"))


def op7_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = merkle.with_next(docs, "doc_id", ["text"])
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    rows = both.select("doc_id", n.cast("long").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"), merkle.paragraphs(F.col("text")).alias("_own"), merkle.paragraphs(edited).alias("_edited"), merkle.paragraphs(F.col("next_text")).alias("_next"))
    return rows.select("doc_id", "n_chars", "edited_sha256", merkle.fingerprint(F.col("_own")).alias("fingerprint"), merkle.fingerprint(F.col("_edited")).alias("edited_fingerprint"), merkle.likeness(F.col("_own"), F.col("_edited")).alias("near_edited"), merkle.likeness(F.col("_own"), F.col("_next")).alias("near_next"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(_read(spark, sf_dir, "documents").select("doc_id", "text"), words=4, percent=85)


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.filter_urls(_read(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = line_rules.quality_rules(_read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _planted(doc_id: Column, text: Column) -> Column:
    """A tenth of the texts made periodic: with h = crc32(doc_id) and g = h div 10, words from g mod n on repeat the first p of them."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def repeated(ws: Column) -> Column:
        n = F.size(ws).cast("long")
        a = g % F.greatest(n, F.lit(1))
        p = 1 + F.floor((n - a) / (3 + g % 8))
        word = lambda w, i: F.when(i < a, w).otherwise(F.get(ws, (a + (i - a) % p).cast("int")))
        return F.array_join(F.transform(ws, word), " ")

    # the words as the only element of an array: they are extracted once, not for each word
    words = F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    return F.when(h % 10 == 0, F.get(F.transform(words, repeated), F.lit(0))).otherwise(text)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    found = run_detection.collapse_runs(docs.select("doc_id", _planted(F.col("doc_id"), F.col("text")).alias("text")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    worst = [F.col(f"worst.{c}").alias(c) for c in ("start", "length", "period")]
    milli = F.floor(1000 * F.col("worst.length") / F.col("worst.period")).alias("exponent_milli")
    return found.select("doc_id", "n_runs", *worst, milli, F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash_tiles.simhash_join(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return classes.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    least = 7
    # shorter runs make no word, with or without the letter that is deleted below
    runs = F.explode(F.regexp_extract_all("text", F.lit(rf"[A-Za-z\u00C0-\u00FF]{{{least},}}"), F.lit(0))).alias("run")
    found = _read(spark, sf_dir, "documents").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), runs)
    found = found.withColumn("run", F.when(F.col("run").rlike("[A-Z]"), lower_ascii(F.col("run"))).otherwise(F.col("run")))
    size = F.char_length("run")
    # a letter of every 31st run is deleted, by a hash
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = (h % size).cast("int")
    word = F.when(h % 31 == 0, F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, size))).otherwise(F.col("run"))
    words = found.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n")).where((F.char_length("word") >= least) & (F.col("n") >= 2))
    return spelling_trie.spelling_variants(words).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {"op1_quality": op1_quality, "op2_lattice": op2_lattice, "op3_toxicity": op3_toxicity, "op4_mixing": op4_mixing, "op5_packing": op5_packing, "op6_pii": op6_pii, "op7_merkle": op7_merkle, "op8_jaccard": op8_jaccard, "op9_urls": op9_urls, "op10_rules": op10_rules, "op11_runs": op11_runs, "op12_simhash": op12_simhash, "op13_spelling": op13_spelling}

_WS = r"\x20\x09-\x0D"
_ABC = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_OP4 = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^{_WS}]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, list_extract([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT) AS weight,
        row_number() OVER (ORDER BY source NULLS LAST) AS nth, source_size * 3.0::DOUBLE AS cap FROM s),
l AS (SELECT *, sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over,
        sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_left FROM r),
t AS (SELECT source, source_size, least(cap, max(left_over / weight_left) OVER () * weight) AS target FROM l),
j AS (SELECT d.doc_id, d.size, t.source_size, t.target, least(CASE WHEN t.source_size = 0 THEN 0 ELSE t.target / t.source_size END, 3.0::DOUBLE) AS rate,
        ('0x' || substr(md5('11:' || coalesce(d.doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 AS draw
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM j
"""

_PARAGRAPH = merkle.PARAGRAPH.replace("++", "+").replace("*+", "*").replace("}+", "}")


def _tree(text: str) -> str:
    leaves = f"list_transform(regexp_extract_all({text}, '{_PARAGRAPH}'), lambda p: substr(md5(p), 1, 12))"
    return leaves


_SECTIONS = "list_transform(range(0, len({x}), 16), lambda i: substr(md5(array_to_string(({x})[i + 1:i + 16], '')), 1, 16))"


def _fingerprint(x: str) -> str:
    s = _SECTIONS.format(x=x)
    return f"md5(coalesce(array_to_string({s}, ''), '')) || '/' || coalesce(array_to_string({s}, ''), '') || '/' || coalesce(array_to_string({x}, ''), '')"


def _like(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(list_distinct({a}), list_distinct({b}))) / (len(list_distinct({a})) + len(list_distinct({b}))) END"


_OP7 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id DESC NULLS LAST, text) AS nth, count(*) OVER () AS n FROM documents),
b AS (SELECT d.doc_id, d.text, e.text AS next_text, length(d.text) AS n, length(d.text) // 3 AS cut FROM d JOIN d e ON e.nth = d.nth % d.n + 1),
c AS (SELECT *, substr(text, 1, n - cut) || substr(next_text, 1, cut) AS edited FROM b),
l AS (SELECT doc_id, n::BIGINT AS n_chars, sha256(edited) AS edited_sha256, {_tree("text")} AS own, {_tree("edited")} AS edi, {_tree("next_text")} AS nxt FROM c)
SELECT doc_id, n_chars, edited_sha256, {_fingerprint("own")} AS fingerprint, {_fingerprint("edi")} AS edited_fingerprint, {_like("own", "edi")} AS near_edited, {_like("own", "nxt")} AS near_next FROM l
"""

_OP8 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_ABC}), '[^{_WS}]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS s FROM w),
n AS (SELECT w.doc_id, count(g.s)::BIGINT AS n FROM w LEFT JOIN g USING (doc_id) GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 85 * (a.n + b.n - common)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT n.doc_id, n.n AS n_shingles, c.component_id FROM n JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON c.x = n.doc_id
"""


def _terms(u: str, terms: tuple[str, ...]) -> str:
    return " + ".join(f"CASE WHEN regexp_matches({u}, '(^|[^\\p{{L}}\\p{{N}}]){t}($|[^\\p{{L}}\\p{{N}}])') THEN 1 ELSE 0 END" for t in terms)


_RULES = [(a, h, p) for a, h, p in sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))]
_FITS = {h + p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))" for _, h, p in _RULES}
_OP9 = f"""
WITH a AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, lower(coalesce(url, '')) AS u, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), {_ABC}) AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, CASE {" ".join(f"WHEN {_FITS[h + p]} THEN '{h + p}'" for _, h, p in _RULES)} END AS rule FROM b)
SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{h + p}' THEN '{a}'" for a, h, p in _RULES)}
  WHEN {url_filter.SOFT_LIMIT} * ({_terms("u", url_filter.STRICT)}) + {_terms("u", url_filter.SOFT)} >= {url_filter.SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict FROM c
"""

_LINE = rf"trim(regexp_replace(regexp_replace(translate(x, {_ABC}), '[{_WS}]+', ' ', 'g'), '[0-9]', '0', 'g'), ' ')"
_OP10 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^{_WS}]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM d),
v AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS times FROM w),
r AS (SELECT doc_id, count(DISTINCT k)::BIGINT AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM v WHERE times > 1) GROUP BY doc_id),
x AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS x FROM d),
y AS (SELECT doc_id, source, text, x, len(regexp_extract_all(x, '[^{_WS}]+')) AS words FROM x),
q AS (SELECT doc_id, (count(*) - count(DISTINCT x))::BIGINT AS n FROM y WHERE words > 0 GROUP BY doc_id),
z AS (SELECT doc_id, source, text, {_LINE} AS line, words FROM y WHERE words > 0),
f AS (SELECT source, line FROM z GROUP BY source, line HAVING count(DISTINCT doc_id) >= {line_rules.MIN_DOCS}),
m AS (SELECT doc_id, sum(words)::BIGINT AS gone FROM z JOIN f ON z.line = f.line AND z.source IS NOT DISTINCT FROM f.source GROUP BY doc_id),
o AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda a: length(a))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(q.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(m.gone, 0) AS gone
  FROM d LEFT JOIN q ON q.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id),
b AS (SELECT *, n_words < {line_rules.MIN_WORDS} OR 100 * n_repeat_words > {line_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM o)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (n_words - gone < {line_rules.MIN_LEFT} * n_words) AS kept FROM b
"""

ORACLE_SQL = {"op4_mixing": _OP4, "op7_merkle": _OP7, "op8_jaccard": _OP8, "op9_urls": _OP9, "op10_rules": _OP10}
