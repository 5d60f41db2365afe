"""Quality rules with an n-gram language model: documents too predictable or too surprising go.

Method. Spark counts the n-grams of all documents per language and makes a modified Kneser-Ney model of them:
below the highest order an n-gram counts by the symbols seen before it, and discounts for counts of one, two and
more come from the counts of counts of the order. Symbols are bytes, so an n-gram of `ORDER` bytes is its own
perfect hash, a number of 40 bits, and the model is a table of sorted hash arrays with the bits each n-gram costs
in its context. A document's perplexity is two to the power of its bits per word; a language's documents have a
band of them around their median, and outside of it a document is rejected. So is one that fails the plain rules.

The model grows with the corpus and is never broadcast or collected. Documents are dealt to blocks of bounded
size by a hash; a block asks for its own distinct n-grams, part by part, and gets their bits back as arrays. The
exchange that deals the texts, packed, serves both, so texts move once. As each n-gram of a document has been
counted, no lookup misses.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglattice.llm.common import pieces, stored

ORDER = 5
SYMBOLS = b"#*$%&|<>"
HELD = 4_000_000  # distinct n-grams a counting task holds before it passes them on
PIECE = 1 << 21  # bytes of text worked on at once


def plain(words: list[bytes]) -> bytes:
    """What the model reads: the words between single blanks."""
    return b" ".join(words)


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, starts): the n-grams that end at each byte and at the end of each text, and where each text begins.

    Before a text and at its end stands the byte 0.
    """
    pad = bytes(ORDER - 1)
    data = np.frombuffer(b"".join([pad + t + b"\0" for t in texts]), dtype=np.uint8)
    sizes = np.array([len(t) + 1 for t in texts])
    starts = np.cumsum(sizes) - sizes
    # windows of the padding of the next text are no n-grams
    at = np.arange(sizes.sum()) + np.repeat(np.arange(len(texts)) * (ORDER - 1), sizes)
    keys = np.zeros(len(at), dtype=np.int64)
    for i in range(ORDER):
        keys = keys << 8 | data[at + i]
    return keys, starts


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with their counts added up."""
    found, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(inverse, np.concatenate(counts), len(found)).astype(np.int64)


def counted(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): n-grams of all texts with a word, by language; added up in tasks before they move."""

    def run(batches):
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def out():
            for lang, (keys, counts) in held.items():
                for at in range(0, len(keys), 1 << 16):
                    n = len(keys[at : at + (1 << 16)])
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(keys[at : at + n]), pa.array(counts[at : at + n])], names=["lang", "gram", "n"])

        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
            for begin, end in pieces(sizes, PIECE):
                by_lang: dict[str, list[bytes]] = {}
                for lang, text in zip(batch.column(0).slice(begin, end - begin).to_pylist(), texts.slice(begin, end - begin).to_pylist(), strict=True):
                    if text and (words := text.split()):
                        by_lang.setdefault(lang, []).append(plain(words))
                for lang, group in by_lang.items():
                    found, n = np.unique(grams(group)[0], return_counts=True)
                    keys, counts = held.get(lang, (found[:0], n[:0]))
                    held[lang] = merged([keys, found], [counts, n])
            if sum(len(k) for k, _ in held.values()) > HELD:
                yield from out()
                held.clear()
        yield from out()

    return docs.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def discounts(level: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3) of one order, from its counts of counts.

    Where a count of counts is missing, half of the count is taken off; no discount exceeds its count.
    """
    seen = level.groupBy(F.col("lang").alias("_lang")).agg(*[F.count_if(F.col("n") == i).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)])
    first = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    cut = [F.coalesce(F.when((F.col(f"n{i}") > 0) & (F.col(f"n{i + 1}") > 0), F.least(F.greatest(i - (i + 1) * first * F.col(f"n{i + 1}") / F.col(f"n{i}"), F.lit(0.0)), F.lit(float(i)))), F.lit(i / 2)).alias(f"d{i}") for i in (1, 2, 3)]
    return seen.select("_lang", *cut)


def model(counts: DataFrame) -> DataFrame:
    """(lang, gram, bits): what each n-gram's last byte costs after the others."""
    levels = [counts]
    for order in range(ORDER - 1, 0, -1):
        shorter = levels[-1].select("lang", F.col("gram").bitwiseAND(F.lit((1 << (8 * order)) - 1)).alias("gram"))
        levels.append(stored(shorter.groupBy("lang", "gram").agg(F.count("*").alias("n")), "orders"))
    below = None
    for order, level in enumerate(reversed(levels), 1):
        # a context has at most 256 followers
        context = Window.partitionBy("lang", F.shiftright("gram", 8))
        d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        rates = with_language(level, discounts(level), F.col("gram")).withColumn("d", d)
        # sums of a few dozen fixed values: the same in any order but for the last bits, hence whole counts first
        free = sum((F.col(f"d{i}") * F.sum((F.least("n", F.lit(3)) == i).cast("long")).over(context) for i in (2, 3)), F.col("d1") * F.sum((F.col("n") == 1).cast("long")).over(context))
        total = F.sum("n").over(context)
        rates = rates.select("lang", "gram", ((F.col("n") - F.col("d")) / total).alias("own"), (free / total).alias("free"))
        if below is None:
            below = rates.select("lang", "gram", (F.col("own") + F.col("free") / 256).alias("p"))
        else:
            short = below.select(F.col("lang").alias("_lang"), F.col("gram").alias("_gram"), F.col("p").alias("_p"))
            suffix = F.col("gram").bitwiseAND(F.lit((1 << (8 * (order - 1))) - 1))
            below = rates.join(short, (F.col("lang") == F.col("_lang")) & (suffix == F.col("_gram"))).select("lang", "gram", (F.col("own") + F.col("free") * F.col("_p")).alias("p"))
    return below.select("lang", "gram", (-F.log2("p")).alias("bits"))


def base_rules(text: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    inside = sum(map(len, words))
    chars = len(text.decode("utf-8", "replace")) - (len(text) - inside)
    return len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three that occur twice or more, the first one included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    again = np.fromiter((seen[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), dtype=bool)
    for i in range(3):
        covered[i : i + len(windows)] |= again
    return int(covered.sum())


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SALT = 64


def with_language(rows: DataFrame, small: DataFrame, by: Column) -> DataFrame:
    """`rows` with the columns of `small`, one row a language; a language's rows are spread by `by` over `SALT` keys."""
    salts = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    at = rows.withColumn("_part", F.pmod(by, F.lit(SALT)).cast("int"))
    return at.join(salts, (at["lang"] == salts["_lang"]) & (at["_part"] == salts["_salt"]), "left").drop("_lang", "_salt", "_part")


def squeezed(keys: np.ndarray) -> bytes:
    """Sorted keys as their compressed differences."""
    return pa.compress(np.diff(keys, prepend=0).tobytes(), "zstd", asbytes=True)


def unsqueezed(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(pa.decompress(data, 8 * n, "zstd", asbytes=True), dtype=np.int64))


def dealt(docs: DataFrame, carry: tuple[str, ...], blocks: int) -> DataFrame:
    """(lang, block, rows, stats..., sizes, packed): documents of a batch and block in one row, their texts compressed.

    A row's block follows from its values, so it is the same whenever a task is run again.
    """
    kind = docs.select(F.struct(*carry).alias("row")).schema["row"].dataType.simpleString()
    spec = f"lang string, block int, rows array<{kind}>, {', '.join(f'{c} array<bigint>' for c in STATS)}, sizes array<bigint>, packed binary"

    def run(batches):
        for batch in batches:
            texts = batch.column(3).cast(pa.binary()).to_pylist()
            langs, numbers = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(langs, numbers, strict=True)):
                groups.setdefault(key, []).append(i)
            for (lang, block), at in groups.items():
                split = [(texts[i] or b"").split() for i in at]
                stats = zip(*[base_rules(texts[i] or b"", w) for i, w in zip(at, split, strict=True)], strict=True)
                clean = [plain(w) for w in split]
                rows = batch.column(2).take(pa.array(at))
                lists = [rows, *[pa.array(c, pa.int64()) for c in stats], pa.array([len(t) for t in clean], pa.int64())]
                ends = pa.array([0, len(at)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang], pa.string()), pa.array([block], pa.int32()), *[pa.ListArray.from_arrays(ends, x) for x in lists], pa.array([pa.compress(b"".join(clean), "zstd", asbytes=True)], pa.binary())],
                    names=["lang", "block", "rows", *STATS, "sizes", "packed"],
                )

    text = F.col("text").cast("string")
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    block = F.pmod(F.xxhash64(*[F.col(c) for c in carry], text), F.lit(blocks)).cast("int")
    return docs.select(lang.alias("lang"), block.alias("block"), F.struct(*carry).alias("row"), text.alias("text")).mapInArrow(run, spec)


def scored(docs: DataFrame, carry: tuple[str, ...], block_bytes: int = 16 << 20, part_grams: int = 400_000, slice_blocks: int = 256) -> DataFrame:
    """(row, lang, stats..., milli): per row the columns to carry, its base rules and thousandths of a bit per word.

    milli is null for a text without words. The sizes bound what one task holds, and change no result.
    """
    counts = stored(counted(docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("string").alias("text"))), "grams")
    size = counts.agg(F.count("*").alias("distinct"), F.sum("n").alias("total")).first()
    blocks = 1 + (size["total"] or 0) // block_bytes
    # odd, so that no byte alone decides on the part
    parts = 1 + (size["distinct"] or 0) // part_grams // 2 * 2
    slices = -(-blocks // slice_blocks)
    part = F.pmod(F.col("gram"), F.lit(parts)).cast("int").alias("part")
    every = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")
    arrays = model(counts).groupBy("lang", part).agg(F.sort_array(F.collect_list(F.struct("gram", "bits"))).alias("sorted"))
    stocked = stored(arrays.select("lang", "part", F.col("sorted.gram").alias("grams"), F.col("sorted.bits").alias("bits")), "hash-arrays")

    def texts_of(table: pa.Table):
        """Pieces of the texts with a word, some documents at a time."""
        for sizes, packed in zip(table.column("sizes"), table.column("packed"), strict=True):
            sizes = np.array(sizes.as_py())
            data = pa.decompress(packed.as_py(), int(sizes.sum()), "zstd", asbytes=True)
            ends = np.cumsum(sizes)
            for begin, end in pieces(sizes, PIECE):
                full = [data[e - n : e] for n, e in zip(sizes[begin:end].tolist(), ends[begin:end].tolist(), strict=True) if n]
                if full:
                    yield full

    def ask(table: pa.Table) -> pa.Table:
        found = [np.unique(grams(full)[0]) for full in texts_of(table)]
        keys = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *found]))
        own, block = table.column("lang")[0].as_py(), table.column("block")[0].as_py()
        held = keys % parts
        lists = [(p, keys[held == p]) for p in np.unique(held).tolist()]
        return pa.table({
            "lang": pa.array([own] * len(lists), pa.string()), "part": pa.array([p for p, _ in lists], pa.int32()), "slice": pa.array([block // slice_blocks] * len(lists), pa.int32()),
            "block": pa.array([block] * len(lists), pa.int32()), "n": pa.array([len(k) for _, k in lists], pa.int64()), "grams": pa.array([squeezed(k) for _, k in lists], pa.binary()),
        })

    def answer(asked: pa.Table, stock: pa.Table) -> pa.Table:
        out = []
        if asked.num_rows:
            keys, bits = (stock.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("grams", "bits"))
            for n, data in zip(asked.column("n").to_pylist(), asked.column("grams").to_pylist(), strict=True):
                wanted = unsqueezed(data, n)
                at = np.searchsorted(keys, wanted)
                if not np.array_equal(keys[np.minimum(at, len(keys) - 1)], wanted):
                    raise ValueError("a text has changed since its n-grams were counted")
                out.append(bits[at].astype(np.float32).tobytes())
        return pa.table({"lang": asked.column("lang"), "block": asked.column("block"), "n": asked.column("n"), "grams": asked.column("grams"), "bits": pa.array(out, pa.binary())})

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        keys, bits = np.zeros(0, dtype=np.int64), np.zeros(0)
        if answers.num_rows:
            keys = np.concatenate([unsqueezed(g, n) for g, n in zip(answers.column("grams").to_pylist(), answers.column("n").to_pylist(), strict=True)])
            bits = np.frombuffer(b"".join(answers.column("bits").to_pylist()), dtype=np.float32).astype(np.float64)
            order = np.argsort(keys)
            keys, bits = keys[order], bits[order]
        rates = []
        for full in texts_of(table):
            asked, starts = grams(full)
            cost = np.add.reduceat(bits[np.searchsorted(keys, asked)], starts)
            words = np.array([t.count(b" ") + 1 for t in full])
            rates.append(np.floor(1000 * cost / words + 0.5).astype(np.int64))
        flat = {c: table.column(c).combine_chunks().flatten() for c in ("rows", *STATS, "sizes")}
        some = np.flatnonzero(flat["sizes"].to_numpy() > 0)
        milli, none = np.zeros(len(flat["sizes"]), dtype=np.int64), np.ones(len(flat["sizes"]), dtype=bool)
        milli[some], none[some] = np.concatenate(rates) if rates else [], False
        n, again = (flat[c].to_numpy() for c in ("n_words", "n_repeat_words"))
        failed = (n < 50) | (100 * again > 50 * n)
        langs = pa.array([table.column("lang")[0].as_py()] * len(n) if len(n) else [], pa.string())
        return pa.table([flat["rows"], langs, *[flat[c] for c in STATS], pa.array(failed), pa.array(milli, pa.int64(), mask=none)], names=["row", "lang", *STATS, "base_failed", "milli"])

    # one exchange of the packed texts serves the questions and the scores
    packed = dealt(docs, carry, blocks)
    rows = packed.groupBy("lang", "block")
    asked = rows.applyInArrow(ask, "lang string, part int, slice int, block int, n long, grams binary")
    stock = stocked.select("lang", "part", every, "grams", "bits")
    keys = ["lang", "part", "slice"]
    answers = asked.groupBy(*keys).cogroup(stock.groupBy(*keys)).applyInArrow(answer, "lang string, block int, n long, grams binary, bits binary")
    kind = packed.schema["rows"].dataType.elementType.simpleString()
    return rows.cogroup(answers.groupBy("lang", "block")).applyInArrow(score, f"row {kind}, lang string, {', '.join(f'{c} long' for c in STATS)}, base_failed boolean, milli long")


def bands(rows: DataFrame, width: float) -> DataFrame:
    """(lang, low, high): the median of a language's documents, less and plus `width` times their quartile range.

    From a count of documents per thousandth of a bit, of those that pass the base rules.
    """
    bins = rows.where(~F.col("base_failed") & F.col("milli").isNotNull()).groupBy("lang", "milli").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy("milli"))
    run = bins.withColumn("upto", upto).withColumn("total", F.sum("n").over(Window.partitionBy("lang")))
    at = [F.min(F.when(4 * F.col("upto") >= i * F.col("total"), F.col("milli"))).alias(f"q{i}") for i in (1, 2, 3)]
    spread = width * (F.col("q3") - F.col("q1"))
    return run.groupBy(F.col("lang").alias("_lang")).agg(*at).select("_lang", (F.col("q2") - spread).alias("low"), (F.col("q2") + spread).alias("high"))


def judged(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), width: float = 4.0, **sizes) -> DataFrame:
    """(row, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, milli, low, high, kept).

    row holds the columns to carry. Words are what stands between blanks (space, and \\t to \\r). A text fails
    the base rules with fewer than 50 words, or when more than half of its words are in repeated windows of
    three. Of the others those in the band of their language are kept. Null and empty texts have no word and
    fail; a null language is a language of its own. Repeated rows count and are returned as often as they
    occur; an empty table gives an empty result; columns that are not carried play no part.
    """
    rows = stored(scored(docs, carry, **sizes), "judged")
    found = with_language(rows, bands(rows, width), F.xxhash64("milli", "word_chars"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("milli").between(F.col("low"), F.col("high")), F.lit(False))
    return found.select("row", *STATS, "base_failed", "milli", "low", "high", kept.alias("kept"))


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that pass, with all their columns."""
    return judged(docs, tuple(docs.columns), **options).where("kept").select("row.*")
