"""The operators as queries over the given tables, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.llm import codes, forest, language, manifest, mixing, packing, perplexity, pii, quality, runs, secrets, simhash, templates
from loglattice.llm.common import id_hash, table


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "context", "step_id")


def op2_line_templates(spark: SparkSession, folder: str) -> DataFrame:
    return templates.line_report(table(spark, folder, "documents"))


def op3_embedding_codes(spark: SparkSession, folder: str) -> DataFrame:
    return codes.near_duplicates(table(spark, folder, "embeddings"))


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language.train(docs.where(id_hash(F.col("doc_id"), 3) != 1))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (id_hash(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op5_pii_anchors(spark: SparkSession, folder: str) -> DataFrame:
    return pii.report(table(spark, folder, "documents"))


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").where(id_hash(F.col("doc_id"), 4) != 2)
    scored = quality.score(docs, quality.train(docs, labels))
    return scored.select("doc_id", (id_hash(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_report(table(spark, folder, "documents"))


def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return secrets.report(docs, secrets.train(secrets.labelled(docs)))


def op10_prefix_forest(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return forest.nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op11_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    shown = F.when(id_hash(F.col("doc_id"), 2) == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = manifest.proofs(docs, presented={"text": shown}).withColumn("folded_root", manifest.folded(F.col("presented"), F.col("path")))
    return found.select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.sha2(manifest.proof_text(F.col("path")), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


# every word from place a on is the original word p, 2p, ... places before it
REPEATED = r"""transform(array(regexp_extract_all(text, r'[^\x20\x09-\x0D]+', 0)), w -> if(size(w) = 0, text,
  transform(array(cast(g % size(w) as int)), a -> transform(array(1 + cast(floor((size(w) - a) / (3 + g % 8)) as int)), p ->
    array_join(transform(w, (x, i) -> if(i < a, x, w[a + (i - a) % p])), ' '))[0])[0]))[0]"""


def op12_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("h"))
    planted = docs.withColumn("g", F.floor(F.col("h") / 10)).withColumn("text", F.when(F.col("h") % 10 == 0, F.expr(REPEATED)).otherwise(F.col("text")))
    best = "array_max(transform(runs, r -> named_struct('length', r.length, 'start', -r.start, 'period', -r.period)))"
    found = runs.periodic_runs(planted).withColumn("best", F.expr(best))
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_perplexity(spark: SparkSession, folder: str) -> DataFrame:
    found = perplexity.judged(table(spark, folder, "documents"))
    return found.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {
    f.__name__: f
    for f in (
        op1_packing, op2_line_templates, op3_embedding_codes, op4_language, op5_pii_anchors,
        op6_quality, op7_mixing, op8_simhash, op9_secrets, op10_prefix_forest, op11_manifest, op12_runs, op13_perplexity,
    )
}


def manifest_sql(levels: int = 16, upper: int = 8) -> str:
    """The trees level by level: 3^levels rows in a source and 3^upper sources at most."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    row = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    bit = lambda i: f"k{i + 1} AS (SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END AS c FROM k{i})"
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295)"
    shown = f"CASE WHEN {crc} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END"

    def tree(name: str, n: int) -> list[str]:
        up = lambda j: f"""{name}{j + 1} AS MATERIALIZED (SELECT g, r // 3 AS r, (n + 2) // 3 AS n,
          CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY {name}{j}.r)) ELSE min(h) END AS h FROM {name}{j} GROUP BY g, {name}{j}.r // 3, n)"""  # noqa: E731
        side = lambda j: f"""{name}s{j} AS (SELECT g, r, n > 1 AS lift, coalesce(lag(h, 2) OVER w, '') || coalesce(lag(h) OVER w, '') AS lft,
          coalesce(lead(h) OVER w, '') || coalesce(lead(h, 2) OVER w, '') AS rgt FROM {name}{j} WINDOW w AS (PARTITION BY g, r // 3 ORDER BY r))"""  # noqa: E731
        walk = lambda j: f"""{name}p{j + 1} AS (SELECT p.* REPLACE (p.r // 3 AS r, CASE WHEN lift THEN sha256(lft || cur || rgt) ELSE cur END AS cur,
          proof || lft || rgt AS proof) FROM {name}p{j} p JOIN {name}s{j} s ON p.g IS NOT DISTINCT FROM s.g AND p.r = s.r)"""  # noqa: E731
        return [f(j) for j in range(n) for f in (up, side, walk)]

    return f"""WITH k0 AS (SELECT i, i::BIGINT AS c FROM range(256) x(i)), {", ".join(bit(i) for i in range(8))},
k AS (SELECT list(c ORDER BY i) AS t FROM k8),
d AS (SELECT doc_id, source, sha256({row} || {field("text")}) AS leaf, sha256({row} || {field(shown)}) AS shown FROM documents, k),
n0 AS (SELECT *, source AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM d),
a0 AS (SELECT g, r, n, leaf AS h FROM n0), ap0 AS (SELECT g, r, doc_id, leaf, shown AS cur, '' AS proof FROM n0), {", ".join(tree("a", levels))},
b0 AS (SELECT 0 AS g, g AS source, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS r, count(*) OVER () AS n, h FROM a{levels}),
bp0 AS (SELECT 0 AS g, b0.r, doc_id, leaf, cur, proof, b0.h AS subroot FROM ap{levels} JOIN b0 ON ap{levels}.g IS NOT DISTINCT FROM b0.source), {", ".join(tree("b", upper))}
SELECT doc_id, leaf, subroot, (SELECT h FROM b{upper}) AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = (SELECT h FROM b{upper}) AS verified FROM bp{upper}"""


def perplexity_sql(order: int = perplexity.ORDER, width: float = 4.0) -> str:
    """Bytes are pairs of hexadecimal digits; texts are cut into chunks first, as taking pieces of long ones is slow."""
    discount = lambda i: f"coalesce(CASE WHEN n{i} > 0 AND n{i + 1} > 0 THEN least(greatest({i} - {i + 1} * (n1 / (n1 + 2 * n2)) * n{i + 1} / n{i}, 0.0), {i}.0::DOUBLE) END, {i}::DOUBLE / 2) AS d{i}"
    parts = []
    for k in range(order, 0, -1):
        if k < order:
            parts.append(f"c{k} AS MATERIALIZED (SELECT lang, substr(g, 3) AS g, count(*) AS n FROM c{k + 1} GROUP BY ALL)")
    for k in range(1, order + 1):
        counts = ", ".join(f"count(*) FILTER (n = {i})::DOUBLE AS n{i}" for i in (1, 2, 3, 4))
        parts.append(f"e{k} AS (SELECT lang, {', '.join(discount(i) for i in (1, 2, 3))} FROM (SELECT lang, {counts} FROM c{k} GROUP BY lang))")
        few = " + ".join(f"d{i} * count(*) FILTER ({'n >= 3' if i == 3 else f'n = {i}'}) OVER w" for i in (1, 2, 3))
        parts.append(f"""r{k} AS (SELECT lang, g, (n - CASE n WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END) / (sum(n) OVER w)::DOUBLE AS own,
          ({few}) / (sum(n) OVER w)::DOUBLE AS free FROM c{k} JOIN e{k} USING (lang) WINDOW w AS (PARTITION BY lang, substr(g, 1, {2 * k - 2})))""")
        parts.append(f"p{k} AS MATERIALIZED (SELECT r.lang, r.g, own + free {'/ 256' if k == 1 else '* q.p'} AS p FROM r{k} r" + ("" if k == 1 else f" JOIN p{k - 1} q ON r.lang = q.lang AND substr(r.g, 3) = q.g") + ")")
    blank = r"[^\x20\x09-\x0D]"
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '{blank}+') AS w FROM documents),
h AS (SELECT k, lang, '{"00" * (order - 1)}' || hex(encode(array_to_string(w, ' '))) || '00' AS h FROM d WHERE len(w) > 0),
z AS (SELECT k, lang, substr(h, CAST(512 * c + 1 AS BIGINT), {512 + 2 * order - 2}) AS h FROM (SELECT *, unnest(range((len(h) - {2 * order - 2} + 511) // 512)) AS c FROM h)),
o AS MATERIALIZED (SELECT k, lang, substr(h, CAST(2 * i + 1 AS BIGINT), {2 * order}) AS g FROM (SELECT *, unnest(range((len(h) - {2 * order - 2}) // 2)) AS i FROM z)),
c{order} AS MATERIALIZED (SELECT lang, g, count(*) AS n FROM o GROUP BY ALL), {", ".join(parts)},
m AS (SELECT k, CAST(floor(1000 * sum((-log2(p))::FLOAT::DOUBLE) / any_value(len(w)) + 0.5) AS BIGINT) AS milli FROM o JOIN p{order} USING (lang, g) JOIN (SELECT k, w FROM d) USING (k) GROUP BY k),
x AS (SELECT k, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
v AS (SELECT k, i, x, lead(x) OVER y AS x2, lead(x, 2) OVER y AS x3 FROM x WINDOW y AS (PARTITION BY k ORDER BY i)),
twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, x, x2, x3) AS n FROM v WHERE x3 IS NOT NULL) WHERE n > 1),
again AS (SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY k),
l AS (SELECT k, list_filter(string_split(text, chr(10)), lambda q: regexp_matches(q, '{blank}')) AS l FROM d),
s AS (SELECT d.k, doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words FROM d JOIN l USING (k) LEFT JOIN again USING (k)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s LEFT JOIN m USING (k)),
b AS (SELECT lang, quantile_disc(milli, 0.25) AS q1, quantile_disc(milli, 0.5) AS q2, quantile_disc(milli, 0.75) AS q3 FROM f WHERE NOT base_failed AND milli IS NOT NULL GROUP BY lang)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
    n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND coalesce(milli BETWEEN q2 - {width} * (q3 - q1) AND q2 + {width} * (q3 - q1), FALSE) AS kept
FROM f LEFT JOIN b USING (lang)"""


# Mixing is integer sums, one division and an order by MD5; the manifest is SHA-256; the language model is counts and
# a few divisions: DuckDB has all of them. The other queries rest on XXH64, a tokenizer, trained models, suffix trees
# or (op3, op10) approximate search; the tests compare them with brute force.
ORACLES = {
    "op7_mixing": r"""
WITH d AS (SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
             CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS weight FROM s),
f AS (SELECT *, 2 * source_size AS lim, row_number() OVER fill AS turn, sum(source_size) OVER () * 1.5 AS budget,
        coalesce(sum(2 * source_size) OVER (fill ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        sum(weight) OVER () - coalesce(sum(weight) OVER (fill ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
      FROM w WINDOW fill AS (ORDER BY CAST(2 * source_size AS DOUBLE) / weight, source ASC NULLS LAST)),
v AS (SELECT *, (CAST(budget AS DOUBLE) - CAST(before AS DOUBLE)) / CAST(rest AS DOUBLE) AS lev FROM f),
l AS (SELECT *, (SELECT arg_min(lev, turn) FROM v WHERE NOT lim <= lev * weight) AS level FROM v),
t AS (SELECT source, source_size, weight, budget,
        CASE WHEN level IS NULL THEN CAST(lim AS DOUBLE) ELSE least(CAST(lim AS DOUBLE), level * weight) END AS target FROM l),
p AS (SELECT source, key, sum(size) AS size FROM d GROUP BY source, key),
u AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key) AS upto FROM p),
c AS (SELECT u.source, u.key, u.size, pass, CAST(upto + pass * source_size AS DOUBLE) / weight AS finish, budget
      FROM u JOIN t ON u.source IS NOT DISTINCT FROM t.source, (VALUES (0), (1)) AS q(pass)),
r AS (SELECT *, sum(size) OVER (ORDER BY finish, source ASC NULLS LAST, key, pass) AS total FROM c),
k AS (SELECT source, key, count(*) AS n FROM r WHERE total <= budget GROUP BY source, key)
SELECT d.doc_id, d.size, CAST(t.source_size AS BIGINT) AS source_size, t.target, d.size * coalesce(k.n, 0) AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
LEFT JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.key = k.key""",
    "op11_manifest": manifest_sql(),
    "op13_perplexity": perplexity_sql(),
}
