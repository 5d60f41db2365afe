"""Manifest, periodic runs and perplexity rules against plain definitions."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loglattice.llm import manifest, perplexity, queries, runs
from tools.check_oracle import TABLES, rows_of

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, leaf string, row int, n int, block int, kept int, runs int"
ODD = [None, "", " \n\t ", "x", "the " * 60, "é" * 500, "a\n\nb\n", "one two three " * 40, "a b " * 250_000]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and names that clash with ours."""
    more = ("k", "l", 1, 2, 3, 4, 5)
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", 1, *more) for i, t in enumerate(ODD)]
    rows += [rows[4], rows[4], (5, "same id, other text", None, "s", 1, *more), (None, "no id", *[None] * 10), (None, "no id either", *[None] * 10), (None,) * 12]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", ["op7_mixing", "op11_manifest", "op13_perplexity"])
def test_query_equals_sql(spark, name):
    import duckdb

    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = entry.queries()[name](spark, SMALL)
    cursor = duck.execute(entry.oracle_sql()[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cursor.description], cursor.fetchall())


# ---- manifest --------------------------------------------------------------------------------------


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return H(*(field(row[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")))


def tree(nodes):
    """Root, and for each node its siblings level by level."""
    paths, at = [[] for _ in nodes], [(h, [i]) for i, h in enumerate(nodes)]
    while len(at) > 1:
        up = []
        for i in range(0, len(at), 3):
            part = at[i : i + 3]
            for j, (_, below) in enumerate(part):
                for k in below:
                    paths[k].append(("".join(h for h, _ in part[:j]), "".join(h for h, _ in part[j + 1 :])))
            up.append((H(*(h for h, _ in part)), [k for _, below in part for k in below]))
        at = up
    return at[0][0], paths


def expected(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row["source"]].append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    out, subroots = [], []
    for name in names:
        ordered = sorted(groups[name], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        subroot, paths = tree([leaf_of(r) for r in ordered])
        subroots.append(subroot)
        out.append([(r["doc_id"], leaf_of(r), subroot, p) for r, p in zip(ordered, paths, strict=True)])
    root, above = tree(subroots)
    return root, [(i, h, s, [*p, *up]) for part, up in zip(out, above, strict=True) for i, h, s, p in part]


def shown(rows):
    return sorted((repr(r["key"]), r["leaf"], r["subroot"], [(s["left"], s["right"]) for s in r["path"]]) for r in rows)


def test_manifest_of_odd_rows(odd, nothing):
    root, want = expected(odd.collect())
    got = manifest.proofs(odd).collect()
    assert {r["root"] for r in got} == {root} and all(r["presented"] == r["leaf"] for r in got)
    assert shown(got) == sorted((repr(i), h, s, p) for i, h, s, p in want)
    assert manifest.proofs(nothing).count() == 0


def test_manifest_over_several_tiers(spark, monkeypatch):
    """Blocks of 9: a source of 400 rows takes three tiers, 30 sources two; single rows and sources of three, too."""
    monkeypatch.setattr(manifest, "DIGITS", 2)
    monkeypatch.setattr(manifest, "BLOCK", 9)
    rows = [(i, "big" if i < 400 else f"s{i % 29}", "en", i, f"text {i}") for i in range(480)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    root, want = expected(docs.collect())
    got = manifest.proofs(docs).withColumn("back", manifest.folded(F.col("leaf"), F.col("path"))).collect()
    assert shown(got) == sorted((repr(i), h, s, p) for i, h, s, p in want)
    assert {r["back"] for r in got} == {r["root"] for r in got} == {root}


def test_tampering_shows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for row in queries.op11_manifest(spark, SMALL).collect():
        even = zlib.crc32(str(row["doc_id"]).encode()) % 2 == 0
        assert row["verified"] == (not (even and "\n" in texts[row["doc_id"]]))


# ---- runs ------------------------------------------------------------------------------------------


def brute_runs(words, least=6, times=4):
    out, n = [], len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            part = words[i : j + q]
            if len(part) >= max(least, times * q) and not any(part[d:] == part[: len(part) - d] for d in range(1, q)):
                out.append((i, len(part), q))
            i = j + (i == j)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_against_brute_force():
    draw = random.Random(3)
    texts = [[draw.choice("abc"[: 1 + i % 3]) for _ in range(draw.randint(0, 40))] for i in range(800)]
    for _ in range(300):  # pieces that repeat, some of them twice in a text
        text = [w for _ in range(4) for w in [draw.choice("abcd") for _ in range(draw.randint(1, 5))] * draw.randint(1, 6)]
        texts.append([*text, *map(str, range(draw.randint(0, 9))), *text[: draw.randint(0, 20)]])
    total = 0
    for least, times in ((6, 4), (4, 2)):
        found = runs.find_runs([[w.encode() for w in t] for t in texts], least, times)
        for text, got in zip(texts, found, strict=True):
            assert [tuple(r) for r in got.tolist()] == brute_runs(text, least, times), text
            total += len(got)
    assert total > 500


def test_extensions_by_definition():
    draw = random.Random(4)
    text = [draw.randint(1, 2) for _ in range(300)]
    found = runs.Extensions(text)
    pairs = [(draw.randrange(301), draw.randrange(301)) for _ in range(2000)]
    pairs = [(i, j) for i, j in pairs if i != j]
    import numpy as np

    got = found.longest(*(np.array(x) for x in zip(*pairs, strict=True)))
    for (i, j), n in zip(pairs, got.tolist(), strict=True):
        assert n == next((d for d in range(300) if max(i, j) + d == 300 or text[i + d] != text[j + d]), 0)
    suffixes = sorted(range(300), key=lambda i: text[i:])
    assert sorted(range(300), key=lambda i: found.where[i]) == suffixes


def test_query_of_runs(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in queries.op12_runs(spark, SMALL).collect()}
    assert len(got) == len(docs)
    some = 0
    for row in docs:
        words = (row["text"] or "").encode().split()
        h, n = zlib.crc32(str(row["doc_id"]).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = brute_runs(words)
        some += bool(found)
        out = got[row["doc_id"]]
        gone = {i for s, length, q in found for i in range(s + q, s + length)}
        best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        assert out["n_runs"] == len(found)
        assert (out["start"], out["length"], out["period"], out["exponent_milli"]) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert out["runs_sha256"] == H(*(f"{s},{length},{q}\n" for s, length, q in found))
        assert out["collapsed_sha256"] == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()
    assert some > 10


def test_runs_of_odd_rows(odd, nothing):
    got = runs.periodic_runs(odd).collect()
    assert len(got) == odd.count() and runs.periodic_runs(nothing).count() == 0
    by = {r["doc_id"]: r for r in got if r["doc_id"] not in (None, 5)}
    assert by[0]["collapsed"] == by[1]["collapsed"] == by[2]["collapsed"] == "" and by[0]["runs"] == []
    assert [tuple(r) for r in by[4]["runs"]] == [(0, 60, 1)] and by[4]["collapsed"] == "the"
    assert [tuple(r) for r in by[7]["runs"]] == [(0, 120, 3)] and by[7]["collapsed"] == "one two three"
    assert [tuple(r) for r in by[8]["runs"]] == [(0, 500_000, 2)] and by[8]["collapsed"] == "a b"
    with pytest.raises(ValueError):
        runs.periodic_runs(odd, times=1)


# ---- perplexity ------------------------------------------------------------------------------------


def test_model_by_definition(spark):
    """Modified Kneser-Ney, followed step by step for every n-gram of a few texts."""
    draw = random.Random(5)
    texts = [" ".join(draw.choice(["ab", "abc", "b", "cab", "é"]) for _ in range(60)) for _ in range(20)]
    docs = spark.createDataFrame([(t, "x") for t in texts], "text string, lang string")
    got = {r["gram"]: r["bits"] for r in perplexity.model(perplexity.counted(docs)).collect()}
    N = perplexity.ORDER
    levels = [Counter()]
    for t in texts:
        data = bytes(N - 1) + t.encode() + b"\0"
        levels[0].update(data[i : i + N] for i in range(len(data) - N + 1))
    for _ in range(N - 1):
        levels.append(Counter(g[1:] for g in levels[-1]))
    levels = {N - i: c for i, c in enumerate(levels)}

    def discount(k, n):
        c = Counter(levels[k].values())
        i = min(n, 3)
        if not (c[i] and c[i + 1]):
            return i / 2
        return min(max(i - (i + 1) * (c[1] / (c[1] + 2 * c[2])) * c[i + 1] / c[i], 0), i)

    def p(gram):
        if not gram:
            return 1 / 256
        k = len(gram)
        row = {g: n for g, n in levels[k].items() if g[:-1] == gram[:-1]}
        total = sum(row.values())
        free = sum(discount(k, n) for n in row.values()) / total
        return (row[gram] - discount(k, row[gram])) / total + free * p(gram[1:])

    assert len(got) == len(levels[N])
    for gram in levels[N]:
        assert got[int.from_bytes(gram, "big")] == pytest.approx(-math.log2(p(gram)), rel=1e-9)
    for k in (2, 4):  # a distribution: the followers seen and the rest add up to one
        context = next(iter(levels[k]))[:-1]
        row = {g: n for g, n in levels[k].items() if g[:-1] == context}
        total = sum(row.values())
        own = sum((n - discount(k, n)) / total for n in row.values())
        assert own + sum(discount(k, n) for n in row.values()) / total == pytest.approx(1)


def test_sizes_change_no_result(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = lambda **sizes: sorted(tuple(r) for r in perplexity.judged(docs, **sizes).collect())
    want = rows()
    assert rows(block_bytes=20_000, part_grams=500, slice_blocks=2) == want and len(want) == docs.count()


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_junk_goes_and_prose_stays(spark, folder):
    """Beyond what the base rules catch: some of the junk goes, and hardly any prose."""
    docs = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet")
    found = perplexity.judged(docs).select("row.doc_id", "base_failed", "kept")
    labels = spark.read.parquet(f"/root/testdata/{folder}/labels.parquet")
    rows = found.join(labels, "doc_id").where("not base_failed").collect()
    good, bad = ([r["kept"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert sum(good) > 0.98 * len(good) and sum(bad) < 0.85 * len(bad), (sum(good), len(good), sum(bad), len(bad))


def test_perplexity_of_odd_rows(odd, nothing):
    got = perplexity.judged(odd).collect()
    assert len(got) == odd.count() and perplexity.judged(nothing).count() == 0
    by = {r["row"]["doc_id"]: r for r in got if r["row"]["doc_id"] not in (None, 5)}
    assert all(by[i]["n_words"] == 0 and by[i]["milli"] is None and not by[i]["kept"] for i in (0, 1, 2))
    assert (by[5 - 1]["n_words"], by[4]["n_repeat_words"], by[4]["base_failed"]) == (60, 60, True)
    assert by[8]["n_words"] == 500_000 and by[8]["word_chars"] == 500_000
    assert by[6]["n_dup_lines"] == 0
    kept = perplexity.keep_good(odd)
    assert kept.columns == odd.columns
    prose = " ".join(f"w{i} of{i % 7}" for i in range(60))
    same = odd.sparkSession.createDataFrame([(i, prose, None) for i in range(3)], "doc_id long, text string, lang string")
    assert perplexity.keep_good(same).count() == 3
