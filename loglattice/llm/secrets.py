"""Secrets by character Markov models, in DataFrame operations only.

Method. Two first-order Markov models over characters, one of random strings and one of ordinary
identifiers, are trained from labelled samples. A token whose mean log-likelihood ratio per character is
above `min_ratio` bits is reported as kind `random`. Beside it stand three base kinds with a known shape:
assign, access and hex. Spans are code points, end exclusive.

Positions come from the pieces between matches: a match starts where the pieces and matches before it end,
a running sum per text and kind.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglattice.llm.common import hash01, over_budget, stored

# The base kinds in their order, the pattern of each and the length it needs.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
CLASSES = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
N = len(CLASSES) + 1  # and one class for all other characters


def pairs(token: str) -> str:
    """SQL: the numbers of the character pairs of a token."""
    at = f"instr('{CLASSES}', substring({token}, i, 1)) * {N} + instr('{CLASSES}', substring({token}, i + 1, 1))"
    return f"transform(sequence(1, greatest(1, length({token}) - 1)), i -> {at})"


def labelled(docs: DataFrame, sample_docs: int = 20_000) -> DataFrame:
    """(token, random): ordinary words and names made of them, and random strings, from a bounded sample of rows.

    Ordinary: the longer words of a text, plain, joined by an underscore to the next one, and with a year
    or counter behind them. Random: digests of the id of the row, as hexadecimal, base 64 and capitals.
    About `sample_docs` rows are drawn by a hash of their id.
    """
    n = docs.agg(over_budget(F.count("*"), sample_docs).alias("share")).first()["share"]
    picked = docs.where(hash01(F.col("doc_id"), F.lit("secrets")) < n)
    words = F.filter(F.split(F.col("text").cast("string"), r"[^A-Za-z]+"), lambda w: F.length(w) >= 5)
    names = picked.select(words.alias("w")).where("size(w) > 1").select(
        F.explode(F.expr("flatten(transform(w, (x, i) -> array(x, concat(x, '_', w[(i + 1) % size(w)]), concat(lower(x), '-', i), concat(x, '_20', 10 + i))))")).alias("token"), F.lit(False).alias("random")
    )
    digest = F.sha2(F.concat(F.lit("random "), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    drawn = picked.select(F.explode(F.array(digest, F.regexp_replace(F.base64(F.unhex(digest)), "=", ""), F.upper(F.regexp_replace(F.base64(F.unhex(digest)), "[+/=a-m]", "")))).alias("token"), F.lit(True).alias("random"))
    return names.unionByName(drawn)


def train(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratios in bits of all character pairs, random over ordinary, from (token, random).

    The probability of a character after another is its share among the pairs with the same first
    character, smoothed. The table has one number for each pair of classes, whatever the sample's size.
    """
    counted = samples.where("length(token) > 1").select("random", F.explode(F.expr(pairs("token"))).alias("pair")).groupBy("pair").agg(
        F.sum(F.col("random").cast("int")).alias("r"), F.sum((~F.col("random")).cast("int")).alias("o")
    )
    counts = {row["pair"]: (row["r"], row["o"]) for row in counted.collect()}
    table = []
    for first in range(N):
        row = [counts.get(first * N + second, (0, 0)) for second in range(N)]
        total = [sum(c[k] for c in row) + smoothing * N for k in (0, 1)]
        table += [math.log2((r + smoothing) / total[0] * total[1] / (o + smoothing)) for r, o in row]
    return table


def ratio(table: list[float], token: str) -> str:
    """SQL: mean bits per pair of a token."""
    numbers = ",".join(f"{x:.6f}" for x in table)
    return f"aggregate({pairs(token)}, 0D, (s, p) -> s + cast(split('{numbers}', ',') as array<double>)[p]) / greatest(1, length({token}) - 1)"


def spans(docs: DataFrame, table: list[float], min_ratio: float = 1.0) -> DataFrame:
    """(key, spans) for the texts that hold any: an array of (start, kind, end), by start, then kind.

    key is `text_key` of the row; rows with the same key have the same spans.
    """
    text = F.col("text").cast("string")
    rows = docs.select(text_key(docs).alias("key"), text.alias("text")).where(text.rlike(rf"(?i:passw|secret|token|api_?key)|AKIA|{HEX}|[A-Za-z0-9+/_-]{{20}}"))
    checks = {
        "assign": (ASSIGN, f"length(regexp_extract(hit, {quoted(ASSIGN)}, 2)) >= 12"),
        "access": (ACCESS, "length(hit) >= 18"),
        "hex": (HEX, "true"),
        "random": (TOKEN, f"{ratio(table, 'hit')} >= {min_ratio}"),
    }
    parts = [
        f"transform(arrays_zip(regexp_extract_all(text, {quoted(p)}, 0), split(text, {quoted(p)}, -1)), (z, i) -> named_struct('kind', {k}, 'i', i, 'gap', length(z.`1`), 'hit', z.`0`))"
        for k, (p, _) in enumerate(checks.values())
    ]
    # each pattern is only laid out for the texts where it occurs
    cut = [f"if(text rlike {quoted(p)}, {part}, cast(array() as array<struct<kind:int,i:int,gap:int,hit:string>>))" for (p, _), part in zip(checks.values(), parts, strict=True)]
    hits = rows.select("key", F.explode(F.expr(f"concat({', '.join(cut)})")).alias("h")).select("key", "h.*").where("hit is not null").dropDuplicates(["key", "kind", "i"])
    upto = Window.partitionBy("key", "kind").orderBy("i")
    placed = hits.withColumn("end", F.sum(F.col("gap") + F.length("hit")).over(upto))
    good = F.expr("case kind " + " ".join(f"when {k} then {check}" for k, (_, check) in enumerate(checks.values())) + " end")
    found = placed.where(good).select("key", F.struct((F.col("end") - F.length("hit")).alias("start"), "kind", "end").alias("s"))
    arrays = found.groupBy("key").agg(F.sort_array(F.collect_list("s")).alias("all"))
    # what a base kind covers in part is not reported twice
    base = "filter(all, s -> s.kind < 3)"
    return arrays.select("key", F.expr(f"transform(array({base}), b -> filter(all, s -> s.kind < 3 or not exists(b, x -> x.start < s.end and s.start < x.end)))[0]").alias("spans"))


def quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def text_key(docs: DataFrame) -> Column:
    """Digest of id and text."""
    return F.sha2(F.concat(F.coalesce(docs["doc_id"].cast("string"), F.lit("-")), F.lit(":"), F.coalesce(docs["text"].cast("string"), F.lit(""))), 256)


def joined(of: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({of}, s -> concat(array({names})[s.kind], ':', s.start, ':', s.end)), ',')"


def report(docs: DataFrame, table: list[float], min_ratio: float = 1.0) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) per row.

    Null and empty texts have no span. Rows are read one by one; repeated rows are found once and returned
    as often as they occur. An empty table gives an empty result; other columns play no part.
    """
    found = stored(spans(docs, table, min_ratio), "secrets").withColumnRenamed("key", "_key")
    rows = docs.select("doc_id", text_key(docs).alias("key"))
    out = rows.join(found, F.col("key") == F.col("_key"), "left").withColumn("s", F.coalesce("spans", F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)")))
    base = "filter(s, x -> x.kind < 3)"
    counts = [F.expr(f"cast(size(filter(s, x -> x.kind = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS[:3])]
    return out.select("doc_id", *counts, F.sha2(F.expr(f"cast({joined(base)} as binary)"), 256).alias("base_sha256"), F.expr(joined("s")).alias("spans"))
