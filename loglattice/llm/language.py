"""Language identification by prediction by partial matching over bytes.

Method. Each language has a tree of byte contexts of up to `order` bytes, with counts. In a context with n
bytes seen, d of them distinct, a byte seen c times has probability c / (n + d), and the escape to the next
shorter context has d / (n + d); the empty context escapes to the uniform byte. The statistics are frozen
after training, so the code length of a byte in its context is a constant: the tables keep it for every
pair seen in any language, and the escape of every context. A text is scored by adding up its constants,
which gives the exact code length under each language; the shortest code wins.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm.common import hash01, over_budget

OTHER = re.compile(r"[\W\d_]+")
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"
BLOCK, ROWS = 1 << 19, 1000  # bytes and rows scored at once


def plain(text: str | None) -> bytes:
    """Lower-case words between single blanks: what is left of a text once layout and symbols are gone."""
    return OTHER.sub(" ", text.lower()).strip().encode("utf-8", "replace") if text else b""


class Table:
    """Rows by 64-bit key, open addressing in numpy arrays; keys are distinct."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.iinfo(np.uint64).max, dtype=np.uint64)
        self.rows = np.zeros((1 << bits, rows.shape[1]), dtype=np.float32)
        self.reach = 1
        at, left = self._home(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at] == np.iinfo(np.uint64).max
            spot, first = np.unique(at[free], return_index=True)
            chosen = left[free][first]
            self.keys[spot], self.rows[spot] = keys[chosen], rows[chosen]
            rest = np.ones(len(left), dtype=bool)
            rest[np.flatnonzero(free)[first]] = False
            left, at = left[rest], (at[rest] + 1) & self.mask
            self.reach += bool(len(left))

    def _home(self, keys):
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, -1 where it is not stored."""
        at = self._home(keys)
        out = np.where(self.keys[at] == keys, at, -1)
        left = np.flatnonzero((out < 0) & (self.keys[at] != np.iinfo(np.uint64).max))
        for _ in range(self.reach):
            if not len(left):
                break
            at[left] = (at[left] + 1) & self.mask
            hit = self.keys[at[left]] == keys[left]
            out[left[hit]] = at[left[hit]]
            left = left[~hit & (self.keys[at[left]] != np.iinfo(np.uint64).max)]
        return out


def grams(data: np.ndarray, size: int) -> np.ndarray:
    """Key of the `size` bytes that end at each place; the first size - 1 places must be padding."""
    out = np.zeros(len(data), dtype=np.uint64)
    wide = data.astype(np.uint64)
    for back in range(size):
        out[back:] |= wide[: len(wide) - back] << np.uint64(8 * back)
    return out


@dataclass
class LanguageModel:
    """Frozen counts: for each order, the keys of context + byte and their counts per language."""

    languages: list[str]
    order: int
    keys: list[np.ndarray] = field(default_factory=list)
    counts: list[np.ndarray] = field(default_factory=list)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "built"}

    def tables(self):
        """Per order: the code lengths of the pairs seen, and the escapes of the contexts; built once per worker."""
        if "built" in self.__dict__:
            return self.built
        n = len(self.languages)
        self.built: list[tuple[Table, Table]] = []
        for k in range(self.order + 1):
            keys, counts = self.keys[k], self.counts[k].astype(np.float64)
            contexts, inverse = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, kinds = np.zeros((len(contexts), n)), np.zeros((len(contexts), n))
            np.add.at(total, inverse, counts)
            np.add.at(kinds, inverse, counts > 0)
            # a context that a language has never seen escapes for nothing
            escape = np.where(total > 0, -np.log2(np.maximum(kinds, 1) / np.maximum(total + kinds, 1)), 0.0)
            lower = self.code_lengths(keys, k - 1).astype(np.float64)
            own = -np.log2(np.maximum(counts, 1) / np.maximum((total + kinds)[inverse], 1))
            self.built.append((Table(keys, np.where(counts > 0, own, escape[inverse] + lower)), Table(contexts, escape)))
        return self.built

    def code_lengths(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Bits of the last byte of each key in its context of `order` bytes, per language."""
        if order < 0:
            return np.full((len(keys), len(self.languages)), 8.0, dtype=np.float32)
        pairs, contexts = self.built[order]
        short = keys & np.uint64((1 << (8 * (order + 1))) - 1)
        at = pairs.find(short)
        out = pairs.rows[at]
        miss = np.flatnonzero(at < 0)
        if len(miss):
            up = contexts.find(short[miss] >> np.uint64(8))
            out[miss] = self.code_lengths(short[miss], order - 1) + np.where(up[:, None] >= 0, contexts.rows[up], 0)
        return out

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text under each language."""
        self.tables()
        out = np.zeros((len(texts), len(self.languages)))
        pad = b" " * self.order
        start = 0
        while start < len(texts):
            end, held = start, 0
            while end < len(texts) and (end == start or held + len(texts[end]) < BLOCK):
                held += len(texts[end])
                end += 1
            if end == start + 1 and held > BLOCK:
                whole = pad + texts[start]
                for at in range(0, held, BLOCK):
                    out[start] += self._sums(whole[at : at + BLOCK + self.order], [0])[0]
            else:
                joined = b"".join(pad + t for t in texts[start:end])
                out[start:end] = self._sums(joined, np.cumsum([0] + [len(t) + self.order for t in texts[start : end - 1]]))
            start = end
        return out

    def _sums(self, data: bytes, starts) -> np.ndarray:
        keys = grams(np.frombuffer(data, dtype=np.uint8), self.order + 1)
        lengths = self.code_lengths(keys, self.order)
        for i in range(self.order):  # the padding itself costs nothing
            lengths[np.minimum(np.asarray(starts) + i, len(lengths) - 1)] = 0
        return np.add.reduceat(lengths, starts, axis=0, dtype=np.float64)


def train(docs: DataFrame, order: int = 3, sample_bytes: int = 2_000_000) -> LanguageModel:
    """Count contexts over labelled rows (doc_id, text, lang).

    Fitted on a bounded sample: per language, documents drawn by a hash of their id until about
    `sample_bytes` characters, which bounds the model too. Rows without text or language are no examples. The
    counting is a Spark aggregation, done once; the driver gets the bounded model.
    """
    rows = docs.where("lang is not null and text is not null").select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    share = rows.groupBy("lang").agg(over_budget(F.sum(F.length("text")), sample_bytes).alias("share")).collect()
    shares = {r["lang"]: r["share"] for r in share}
    if not shares:
        return LanguageModel([], order, [np.zeros(0, np.uint64)] * (order + 1), [np.zeros((0, 0))] * (order + 1))
    names = sorted(shares)
    picked = rows.where(hash01(F.col("doc_id"), F.lit("language")) < F.create_map(*[F.lit(x) for n in names for x in (n, shares[n])])[F.col("lang")])

    def count(batches):
        for batch in batches:
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(b" " * order + plain(text))
            for lang, texts in by_lang.items():
                data = np.frombuffer(b"".join(texts), dtype=np.uint8)
                # the padding before each text is context only
                inside = np.ones(len(data), dtype=bool)
                ends = np.cumsum([0] + [len(t) for t in texts[:-1]])
                inside[(ends[:, None] + np.arange(order)).ravel()] = False
                for k in range(order + 1):
                    keys, n = np.unique(grams(data, k + 1)[inside], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array([k] * len(keys), pa.int32()), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "k", "gram", "n"])

    found = picked.select("lang", "text").mapInArrow(count, "lang string, k int, gram long, n long").groupBy("k", "gram", "lang").agg(F.sum("n").alias("n"))
    model = LanguageModel(names, order)
    found = found.toPandas()
    for k in range(order + 1):
        top = found[found["k"] == k]
        keys, at = np.unique(top["gram"].to_numpy(np.int64).view(np.uint64), return_inverse=True)
        counts = np.zeros((len(keys), len(names)))
        if len(top):
            counts[at, np.searchsorted(names, top["lang"])] = top["n"]
        model.keys.append(keys)
        model.counts.append(counts)
    return model


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score, bits_per_byte) per row, from the whole text alone.

    score is the posterior of the language under equal priors. Null text, text without a letter, or a model
    without languages gives `und` with score 0; ties go to the language that sorts first.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                yield predict(batch.slice(at, ROWS), shared.value)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double, bits_per_byte double")


def predict(batch: pa.RecordBatch, model: LanguageModel) -> pa.RecordBatch:
    texts = batch.column(1).to_pylist()
    clean = [plain(t) for t in texts]
    known = [bool(t and LETTER.search(t)) and bool(model.languages) for t in texts]
    names, scores, rates = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.full(len(texts), 8.0)
    if any(known):
        bits = model.bits(clean)
        best = bits.argmin(axis=1)
        low = bits[np.arange(len(texts)), best]
        posterior = 1 / np.exp2(-np.minimum(bits - low[:, None], 1000)).sum(axis=1)
        for i, ok in enumerate(known):
            if ok:
                names[i], scores[i], rates[i] = model.languages[best[i]], posterior[i], low[i] / max(1, len(clean[i]))
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores), pa.array(rates)], names=["doc_id", "lang_pred", "score", "bits_per_byte"])


def keep_known(docs: DataFrame, model: LanguageModel, min_score: float = 0.5, max_bits: float = 7.0) -> DataFrame:
    """The rows of `docs` in a language of the model, with all their columns.

    Rejected: no letter at all, no language with over half of the posterior, or a code no better than
    `max_bits` bits a byte, which no text of a known language needs.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                text = pc.struct_field(batch.column(0), "text").cast(pa.string())
                out = predict(pa.RecordBatch.from_arrays([text, text], names=["doc_id", "text"]), shared.value)
                ok = [n != UNKNOWN and s >= min_score and b <= max_bits for n, s, b in zip(*(out.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
                yield batch.filter(pa.array(ok, pa.bool_())).select(["_row"])

    rows = docs.select(F.struct("*").alias("_row"))
    kind = docs.schema.simpleString()
    return rows.mapInArrow(run, f"_row {kind}").select("_row.*")
