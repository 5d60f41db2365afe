"""The training-data operators against brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import time
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from loglattice.llm import codes, forest, language, mixing, packing, pii, quality, secrets, simhash, templates

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, fp int, key int, leaf int, template string, source_size int, _row int, _text int, v int, n int, dims int, digest string"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " \n\t ", "x", "the " * 3000, "é" * 500, "a\n\nb\n", "-- !! 12", "word of some length here\n" * 40_000]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, columns whose names clash with ours."""
    more = ("x", 7, 1, 2, "t", 3, 4, 5, 6, 7, 8, "d")
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", 1, *more) for i, t in enumerate(ODD)]
    rows += [rows[4], rows[4], (None, "null id", *[None] * 15), (None,) * 17]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def test_packing_round_trip(documents):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(TOKENIZER).encode
    pieces = packing.pack(documents, TOKENIZER).toPandas()
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    for doc_id, group in pieces.sort_values("start").groupby("doc_id"):
        ids = np.frombuffer(b"".join(group.tokens), dtype="<u4")
        assert ids.tolist() == [*encode(texts[doc_id], add_special_tokens=False).ids, 1]
        assert (group.doc_tokens == len(ids)).all() and (group.start == group.length.cumsum() - group.length).all()
    assert set(pieces.doc_id) == set(texts)
    padded = total = 0
    for _, group in pieces.sort_values("offset").groupby("sequence_id"):
        size = int(group.length.sum())
        assert size <= 2048 and (group.offset == group.length.cumsum() - group.length).all()
        total, padded = total + size, padded + (2048 if size & (size - 1) else size)
    assert padded < 1.02 * total


def test_tokens_of_odd_chunks():
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(TOKENIZER).encode
    texts = ["á b İx K'sé don't <|endoftext|>x", "\x1cab c ß\tq", "中文 字。 Straße. 12ab ab12! ﬁn ΑΣ. a###, x--"]
    words = packing.Words(TOKENIZER, 3)
    for text, got in zip(texts, packing.token_bytes(texts, words, 1), strict=True):
        assert np.frombuffer(got, dtype="<u4").tolist() == [*encode(text, add_special_tokens=False).ids, 1]


def test_pack_lengths_places_every_token_once():
    rng = np.random.default_rng(1)
    lengths = [*rng.integers(1, 6000, 400).tolist(), 1, 2048, 4096, 257]
    seen = [[] for _ in lengths]
    for context, pieces in packing.pack_lengths(lengths):
        assert sum(p[2] for p in pieces) <= context
        for doc, start, n in pieces:
            seen[doc].append((start, n))
    for n, parts in zip(lengths, seen, strict=True):
        at = 0
        for start, size in sorted(parts):
            assert start == at
            at += size
        assert at == n


def test_simhash_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 60, dtype=np.int64)
    fps = np.unique(np.concatenate([base, *[base ^ (1 << int(rng.integers(63))) ^ (1 << int(rng.integers(63))) for _ in range(4)]]))
    want = {(int(a), int(b)) for a in fps for b in fps if a < b and int(a ^ b).bit_count() <= 2}
    got = simhash.links(spark.createDataFrame([(int(x),) for x in fps], "fp long"), 2).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 100


def test_fingerprint_by_definition():
    text = "The quick  Brown fox\tJUMPS é over. the the the"
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text.encode()) == want
    assert simhash.fingerprint(b"one two") == xxhash.xxh64_intdigest(b"one two", 42)
    assert simhash.fingerprint(None) == simhash.fingerprint(b" \n") == 0


def test_one_document_of_each_group_stays(odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert ids == [0, 3, 4, 5, 6, 7, 8]  # 1 and 2 have no word, like 0; 4 is there three times


def test_one_of_each_group_whatever_the_ids(spark):
    """Rows without an id, and different texts under one id, are told apart."""
    texts = [f"{w} " * 3 + f"{w}{w} tail {w}" for w in ("red", "green", "blue", "grey", "pink", "teal")]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (None, texts[2]), (5, texts[3]), (5, texts[4]), (6, texts[4]), (7, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for shuffled in (docs, docs.repartition(5), docs.orderBy("text")):
        kept = sorted(map(tuple, simhash.keep_one(shuffled).collect()), key=repr)
        assert kept == sorted([(None, texts[0]), (None, texts[1]), (None, texts[2]), (5, texts[3]), (5, texts[4]), (7, texts[5])], key=repr)


def test_one_of_each_group_against_all_pairs(documents):
    rows = documents.collect()
    prints = {r["doc_id"]: simhash.fingerprint((r["text"] or "").encode()) for r in rows}
    low = {i: i for i in prints}
    near = {i: [j for j in prints if (prints[i] ^ prints[j]).bit_count() <= 2] for i in prints}
    for _ in low:
        now = {i: min(low[j] for j in near[i]) for i in low}
        if now == low:
            break
        low = now
    assert sorted(r["doc_id"] for r in simhash.keep_one(documents).collect()) == sorted({*low.values()})


def test_mixing_reaches_targets(documents):
    rows = mixing.mix_report(documents).toPandas().merge(documents.select("doc_id", "source").toPandas(), on="doc_id")
    by = rows.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"), most=("size", "max"))
    assert abs(by.target.sum() - 1.5 * by["size"].sum()) < 1e-6 * by["size"].sum()
    assert ((by.taken - by.target).abs() <= by.most).all() and (rows.taken <= 2 * rows["size"]).all()
    total = mixing.mix(documents).select(mixing.words(F.col("text")).alias("n")).groupBy().sum("n").first()[0]
    assert total == rows.taken.sum()


def test_language_held_out(documents):
    model = language.train(documents.where("doc_id % 3 <> 1"))
    rows = language.identify(documents, model).join(documents.where("doc_id % 3 = 1").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) > 0.95 * len(rows)


def test_code_lengths_by_definition():
    """The tables give the code length that the escape rule gives when it is followed byte by byte."""
    text, order = b"  abracadabra abra cadabra", 2
    model = language.LanguageModel(["x"], order)
    for k in range(order + 1):
        keys, n = np.unique(language.grams(np.frombuffer(text, np.uint8), k + 1)[order:], return_counts=True)
        model.keys.append(keys)
        model.counts.append(n[:, None].astype(float))

    def cost(context: bytes, byte: int) -> float:
        seen = [text[i] for i in range(order, len(text)) if text[i - len(context) : i] == context]
        kinds, lower = len(set(seen)), (lambda: cost(context[1:], byte) if context else 8.0)
        if not seen:
            return lower()
        if byte in seen:
            return -math.log2(seen.count(byte) / (len(seen) + kinds))
        return -math.log2(kinds / (len(seen) + kinds)) + lower()

    probe = b"abba zcad"
    padded = b" " * order + probe
    want = sum(cost(padded[i : i + order], padded[i + order]) for i in range(len(probe)))
    assert model.bits([probe])[0, 0] == pytest.approx(want, rel=1e-5)


def test_quality_held_out(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = quality.train(docs, labels.where("doc_id % 4 <> 2"))
    rows = quality.score(docs, model).join(labels.where("doc_id % 4 = 2"), "doc_id").collect()
    assert sum((r["score"] >= 0.7) == (r["quality"] == 1) for r in rows) > 0.95 * len(rows)


def base_pii(t):
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    yield from (("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t))
    yield from (("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) < 256 for p in m[0].split(".")))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[ -]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield ("card", *m.span())
    yield from (("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15)


def test_pii_against_patterns():
    rng = np.random.default_rng(5)
    for alphabet in ("ab@.-1 2+", "0123.. ", "0 -12", "+0 (1).-2a", "@a.b@.c", "1.2.3.4..5 256"):
        for _ in range(3000):
            text = "".join(rng.choice(list(alphabet), rng.integers(0, 30)))
            assert [s for s in pii.find(text) if s[0] in pii.BASE] == list(base_pii(text)), text
    assert pii.find("x" * 100 + " [at] mail.example")[-1][:2] == ("spoken", 0)
    extra = {s[0] for s in pii.find("see https://a.example/x?y=1, IBAN GB82 WEST 1234 5698 7654 32 or jo [at] mail [dot] example")}
    assert extra == {"url", "account", "spoken"}


def test_pii_takes_time_in_proportion():
    for cue in ("-ssn", "iban ", "@a.", "+1 ", "1.2.", "x [at] "):
        text = cue * (1_000_000 // len(cue))
        start = time.perf_counter()
        pii.find(text)
        assert time.perf_counter() - start < 6, cue


def test_random_tokens_against_names(spark):
    """Precision and recall of the character models on planted tokens, those without a digit included."""
    rng = np.random.default_rng(11)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    drawn = ["".join(rng.choice(letters, 28)) for _ in range(200)]
    drawn += [base64.b64encode(rng.bytes(21)).decode().replace("+", "A").replace("/", "B") for _ in range(200)]
    words = [w for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(200).collect() for w in re.findall("[a-z]{5,12}", r["text"])]
    names = ["_".join(words[i : i + 4]) for i in range(0, 4000, 10)]
    names = [n for n in names if len(n) >= 20]
    rows = [(i, f"key {t} end") for i, t in enumerate([*drawn, *names])]
    table = secrets.train(secrets.labelled(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))
    found = {r["doc_id"] for r in secrets.report(spark.createDataFrame(rows, "doc_id long, text string"), table).where("spans like '%random%'").collect()}
    hit = len([i for i in found if i < len(drawn)])
    assert hit >= 0.98 * len(drawn) and len(found) - hit <= 0.02 * len(names)


def test_secrets_against_patterns(spark):
    texts = [
        None, "", 'token = "abcdefghijkl" secret:token:abcdefghijklmnop é PASSWD=123', "AKIAABCDEFGHIJKLMN AKIA1 deadbeefdeadbeef00 api-key: x api_key=aaaaaaaaaaaaa",
        "key q9Zk2LmXw8RtVb4Ns7Jd1Hc6 and understandable_configuration_2024 thninthtiontionthhareand",
    ]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[2]])], "doc_id long, text string")
    rules = {
        "assign": (r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 12),
        "access": ("AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18), "hex": ("[0-9a-f]+", lambda m: len(m[0]) >= 16),
    }
    table = secrets.train(secrets.labelled(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")))
    for row in secrets.report(docs, table).collect():
        text = [*texts, texts[2]][row["doc_id"]] or ""
        want = sorted((m.start(), k, m.end(), kind) for k, (kind, (p, ok)) in enumerate(rules.items()) for m in re.finditer(p, text) if ok(m))
        assert row["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in want).encode()).hexdigest()
        added = [text[int(s) : int(e)] for k, s, e in (x.split(":") for x in row["spans"].split(",") if x) if k == "random"]
        assert added == (["q9Zk2LmXw8RtVb4Ns7Jd1Hc6"] if row["doc_id"] == 4 else [])


def vectors(spark, n=300, near=40):
    rng = np.random.default_rng(7)
    v = rng.standard_normal((n, 16))
    v[:near] = v[0] + 0.12 * rng.standard_normal((near, 16))
    v[near] = v[near + 1] = v[1]
    rows = [(i, x.tolist(), i % 2 if i >= near + 2 else 0) for i, x in enumerate(v)]
    rows += [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [float("nan")] * 16, 0), (n + 3, [1.0, None], 1), (n + 4, v[0].tolist(), None)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), rows


def test_embedding_links_against_all_pairs(spark):
    frame, rows = vectors(spark)
    good = [r for r in rows if r[0] < 300]
    unit = {r[0]: np.array(r[1]) / np.linalg.norm(r[1]) for r in good}
    near = {a[0]: {b[0] for b in good if a[0] != b[0] and a[2] == b[2] and unit[a[0]] @ unit[b[0]] >= 0.93} for a in good}
    low = {i: i for i in near}
    for _ in range(len(low)):
        low = {i: min([low[i], *(low[j] for j in near[i])]) for i in low}
    for bucket in (16, 256):
        for r in codes.near_duplicates(frame, bucket=bucket).collect():
            assert r["n_links"] == len(near.get(r["vec_id"], ()))
            assert r["component_id"] == low.get(r["vec_id"], r["vec_id"]) and r["kept"] == (r["component_id"] == r["vec_id"])


def test_vectors_that_share_an_id(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [0.01, 1.0], 0), (4, [0.02, 1.0], 0)]
    got = sorted(tuple(r) for r in codes.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (4, 2, 1, False)]


def test_forest_recall(spark):
    frame, rows = vectors(spark)
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")  # the groups of both sides must meet in separate tasks as well
    try:
        found = forest.nearest(frame, frame.where("vec_id % 10 = 0"), shard=100, query_block=8).collect()
    finally:
        spark.conf.unset(coalesce)
    good = [(r[0], np.array(r[1]) / np.linalg.norm(r[1])) for r in rows if r[0] < 300 or r[0] == 304]
    hit = total = 0
    for q, v in good:
        if q % 10 == 0:
            best = sorted(((-float(v @ w), i) for i, w in good if i != q))[:5]
            mine = sorted((r["rank"], r["vec_id"]) for r in found if r["query_id"] == q)
            assert [r for r, _ in mine] == [1, 2, 3, 4, 5]
            hit, total = hit + len({i for _, i in best} & {i for _, i in mine}), total + 5
    assert hit >= 0.9 * total


def test_recurring_lines_go_but_the_first(spark):
    note = "Copyright notice number {} all of it is reserved here"
    rows = [(i, f"only {i} has this first line of words\n{note.format(i)}\nshort") for i in range(5)]
    out = {r["doc_id"]: r["text"] for r in templates.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert note.format(0) in out[0]
    assert all("Copyright" not in out[i] and "short" in out[i] for i in range(1, 5))


def dropped_by_tree(docs, depth=3, share=0.7):
    """(doc_id, line_no) that a plain tree over all lines drops; ids are distinct."""
    leaves, forms = defaultdict(list), defaultdict(list)
    for doc_id, text in docs:
        for no, line in enumerate((text or "").split("\n")):
            words = [w for w in re.split(r"[\t\x0b\x0c\r ]", line) if w]
            shape = ["<*>" if re.search("[0-9]", w) else w for w in words]
            if len(words) >= 3:
                leaves[len(words), *shape[:depth]].append((doc_id, no, words, shape))
    for lines in leaves.values():
        seen = Counter((i, w) for *_, shape in lines for i, w in enumerate(shape))
        for doc_id, no, words, shape in lines:
            fixed = [w if seen[i, w] >= 3 else None for i, w in enumerate(shape)]
            general = sum(w is not None for w in fixed) >= share * len(words) and sum(w not in (None, "<*>") for w in fixed) >= 2
            forms[(True, *fixed) if general else (False, *words)].append((doc_id, no))
    return {at for places in forms.values() if len({d for d, _ in places}) >= 3 for at in places if at[0] != min(d for d, _ in places)}


def test_lines_against_a_plain_tree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = dropped_by_tree([tuple(r) for r in docs.collect()])
    got = {(r["doc_id"], r["line_no"]) for r in templates.repeated_lines(docs).collect()}
    assert got == want and len(want) > 100


def test_short_lines_have_templates(spark):
    rows = [(i, f"Page {i} of {i + 7}\n{i} {i + 1} {i + 2}\nown words {'abcdefgh'[i]}") for i in range(8)]
    out = [r["text"] for r in templates.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()]
    assert out[0].startswith("Page 0") and not any("Page" in t for t in out[1:])
    assert all(t.count("\n") == 1 for t in out[1:])  # numbers alone are no template


def test_quality_against_a_plain_discriminant(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    x = {k: np.array([quality.statistics(texts[r["doc_id"]]) for r in labels.orderBy("doc_id").collect() if r["quality"] == k]) for k in (0, 1)}
    own = {k: np.cov(v.T, bias=True) for k, v in x.items()}
    n = {k: len(v) for k, v in x.items()}
    within = (n[0] * own[0] + n[1] * own[1]) / (n[0] + n[1])
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}

    def density(k, row):
        mixed = 0.5 * own[k] + 0.5 * within
        mixed = 0.9 * mixed + 0.1 * np.eye(len(row)) * np.trace(mixed) / len(row)
        gap = row - x[k].mean(axis=0)
        return -0.5 * (gap @ np.linalg.inv(mixed) @ gap + np.linalg.slogdet(mixed)[1])

    for doc_id in list(texts)[:100]:
        row = np.array(quality.statistics(texts[doc_id]))
        gap = density(1, row) - density(0, row) + math.log((n[1] + 1) / (n[0] + 1))
        assert got[doc_id] == pytest.approx(1 / (1 + math.exp(-max(-700, min(700, gap)))), abs=1e-6)
    small = quality.train(docs, labels, max_rows=30)
    assert small.prior == model.prior  # the sample's size does not move the prior


def test_language_counts_do_not_depend_on_batches(documents):
    one, other = (language.train(d) for d in (documents.coalesce(1), documents.repartition(7)))
    for k in range(4):
        assert (one.keys[k] == other.keys[k]).all() and (one.counts[k] == other.counts[k]).all()


def test_odd_rows_and_empty_tables(spark, odd, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.train(docs)
    table = secrets.train(secrets.labelled(docs))
    judge = quality.train(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    runs = [
        lambda d: language.identify(d, model), pii.report, lambda d: quality.score(d, judge), mixing.mix_report,
        simhash.near_duplicates, lambda d: secrets.report(d, table), templates.line_report, templates.drop_repeated_lines, pii.redact,
    ]
    for run in runs:
        assert run(odd).count() == odd.count()
        assert run(nothing).count() == 0
    assert mixing.mix(nothing).columns == odd.columns and language.keep_known(nothing, model).count() == 0
    und = {r["doc_id"] for r in language.identify(odd, model).where("lang_pred = 'und'").collect()}
    assert {0, 1, 2, 7} <= und
    assert packing.pack(odd, TOKENIZER).where("start = 0").count() == odd.count() and packing.pack(nothing, TOKENIZER).count() == 0
    none = spark.createDataFrame([], "vec_id long, embedding array<double>, label int")
    assert codes.near_duplicates(none).count() == 0 and forest.nearest(none, none).count() == 0


def test_stages_keep_columns(spark, documents):
    at = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, "/root/testdata/sf0.001")
        assert at.columns == documents.columns, name
        assert at.count() > 0.8 * documents.count(), name


def test_pipeline_by_stage(spark, documents):
    """The whole pipeline: each stage does to all that the one before kept what its operator does, and nothing is lost."""
    at, kept = documents, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, at = at.collect(), stage(spark, at, "/root/testdata/sf0.001").checkpoint()
        kept[name] = at.collect()
        ids = {r["doc_id"] for r in before}
        assert {r["doc_id"] for r in kept[name]} <= ids
        if name == "lines":
            gone = dropped_by_tree([(r["doc_id"], r["text"]) for r in before])
            want = {r["doc_id"]: "\n".join(x for i, x in enumerate((r["text"] or "").split("\n")) if (r["doc_id"], i) not in gone) for r in before}
            assert {r["doc_id"]: r["text"] for r in kept[name]} == want
    final = corpus_pipeline.STAGES[-1][1](spark, at, "").collect()
    mixed = Counter(r["doc_id"] for r in kept["mixing"])
    starts = Counter(r["doc_id"] for r in final if r["start"] == 0)
    assert starts == mixed
    whole = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert Counter(r["doc_id"] for r in whole.where("start = 0").collect()) == mixed
