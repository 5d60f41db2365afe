"""SimHash near-duplicates: fingerprints of word shingles, paired through the words of a covering code.

Method. A perfect code puts every word within its covering radius of exactly one codeword, its anchor.
Two fingerprints that differ in at most d bits then meet at the anchor of either: the other one is within
radius + d of it. Each distinct fingerprint is sent once to its own anchor and, as a visitor, to every
anchor within radius + d; comparison is per anchor. Two binary Golay words of 23 bits (radius 3) make an
anchor of 46 bits, so there are 2^24 anchors; the other 18 bits only take part in the exact comparison.
The excess of the two halves is bounded together (e1 + e2 <= d), which keeps the visits near 61 for d = 2.
No pair is lost: the code covers the whole space.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.llm.common import cut, stored
from loglattice.llm.components import components

BLOCK = 1 << 16  # shingles whose bits are counted at once

# Fixed values of the binary Golay code: length, generator polynomial, covering radius.
LENGTH, GENERATOR, RADIUS = 23, 0b101011100011, 3


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """64-bit SimHash of the whole text: bit i is set when over half of the shingle hashes have it.

    Words are runs of non-blank bytes after lower-casing A-Z. Fewer words than `width` make one shingle;
    no word at all gives 0.
    """
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) <= width:
        shingles = iter([b" ".join(words)])
        n = 1
    else:
        n = len(words) - width + 1
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(42))
    counts = np.zeros(64, dtype=np.int64)
    for start in range(0, n, BLOCK):
        part = np.fromiter(hashes, dtype="<u8", count=min(BLOCK, n - start))
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def row_digest(docs: DataFrame) -> Column:
    """Digest of all columns of a row: equal for equal rows only."""
    return F.sha2(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}), 256)


def fingerprints(docs: DataFrame, width: int = 3, digest: bool = False) -> DataFrame:
    """(doc_id, fp: long, digest) per row of `docs`; the 64 bits are kept as a signed long, digest is null unless asked for."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), batch.column(2)], names=["doc_id", "fp", "digest"])

    key = row_digest(docs) if digest else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), key.alias("digest")).mapInArrow(run, "doc_id long, fp long, digest string")


@lru_cache(maxsize=4)
def _rings(distance: int):
    """For excess 0..distance: (starts, patterns) of the error patterns by syndrome; and the syndrome tables."""
    unit = []
    for i in range(LENGTH):
        value = 1 << i
        for bit in range(LENGTH - 1, 10, -1):
            if value >> bit & 1:
                value ^= GENERATOR << (bit - 11)
        unit.append(value)

    def syndromes(words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words), dtype=np.int64)
        for i, value in enumerate(unit):
            out ^= ((words >> i) & 1) * value
        return out

    rings = []
    for excess in range(distance + 1):
        weights = range(RADIUS + 1) if excess == 0 else (RADIUS + excess,)
        found = np.array([sum(1 << i for i in c) for w in weights for c in combinations(range(LENGTH), w)], dtype=np.int64)
        syndrome = syndromes(found)
        order = np.argsort(syndrome, kind="stable")
        rings.append((np.searchsorted(syndrome[order], np.arange(2**11 + 1)), found[order]))
    low = syndromes(np.arange(1 << 12, dtype=np.int64))
    high = syndromes(np.arange(1 << 11, dtype=np.int64) << 12)
    return rings, low, high


def anchors(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, anchor, own) for all anchors that each fingerprint visits; own marks its single nearest anchor."""
    rings, low, high = _rings(distance)
    mask = (1 << LENGTH) - 1
    words = [fps & mask, (fps >> LENGTH) & mask]
    syndromes = [low[w & 4095] ^ high[w >> 12] for w in words]
    rows, keys, own = [], [], []
    for first in range(distance + 1):
        for second in range(distance + 1 - first):
            (starts1, found1), (starts2, found2) = rings[first], rings[second]
            n1 = (starts1[1:] - starts1[:-1])[syndromes[0]]
            n2 = (starts2[1:] - starts2[:-1])[syndromes[1]]
            total = n1 * n2
            row = np.repeat(np.arange(len(fps)), total)
            at = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
            e1 = found1[starts1[syndromes[0][row]] + at // n2[row]]
            e2 = found2[starts2[syndromes[1][row]] + at % n2[row]]
            rows.append(row)
            keys.append((words[0][row] ^ e1) << LENGTH | (words[1][row] ^ e2))
            own.append(np.full(len(row), first == 0 and second == 0))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(own)


def links(distinct: DataFrame, distance: int = 2) -> DataFrame:
    """(a, b) with a < b: distinct fingerprints (column fp) that differ in 1..distance bits."""
    if not 0 <= distance <= 4:
        raise ValueError("distance must be between 0 and 4")

    def run(batches):
        for batch in batches:
            all_fps = batch.column(0).to_numpy(zero_copy_only=False)
            for start in range(0, len(all_fps), 4096):
                fps = all_fps[start : start + 4096]
                row, key, own = anchors(fps, distance)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[row]), pa.array(own)], names=["anchor", "fp", "own"])

    visits = distinct.select("fp").mapInArrow(run, "anchor long, fp long, own boolean")
    home = visits.where("own").select("anchor", F.col("fp").alias("a"))
    guest = visits.select("anchor", F.col("fp").alias("b"))
    near = F.expr(f"bit_count(a ^ b) <= {distance}")
    # each pair meets at the anchor of either end: keeping one order loses nothing
    return home.join(guest, (home.anchor == guest.anchor) & (F.col("a") < F.col("b")) & near).select("a", "b")


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) per row: component_id is the smallest doc_id reachable through links.

    Equal fingerprints are one node with its smallest doc_id, so a group of exact copies costs one row.
    Empty, blank and null texts have fingerprint 0 and link with each other (and with others near 0).
    A null doc_id gets a component like any other row; it is the id of a component only when no row of it
    has an id. Repeated rows are returned as often as they occur; extra columns are ignored.
    """
    rows = stored(fingerprints(docs, width).drop("digest"), "fingerprints")
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    grouped = _groups(nodes, distance)
    least = grouped.groupBy("component").agg(F.min("low").alias("component_id"))
    members = grouped.join(least, "component").select("fp", "component_id")
    return rows.join(members, "fp").select("doc_id", "fp", "component_id")


def _groups(nodes: DataFrame, distance: int) -> DataFrame:
    """`nodes` (one row per fp) with the component of each."""
    found = components(links(nodes, distance))
    return nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def keep_one(docs: DataFrame, width: int = 3, distance: int = 2) -> DataFrame:
    """One row of `docs` of each group of near-duplicates, with all its columns: the one with the smallest doc_id.

    Rows without an id come last; among rows of one id the digest of the whole row decides, so the choice is
    the same in every run, and different texts under one id, or under none, are told apart. Equal rows are one.
    Empty, blank and null texts are a group like any other. An empty table gives an empty one.
    """
    rows = stored(fingerprints(docs, width, digest=True), "fingerprints")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("best")
    nodes = cut(rows.groupBy("fp").agg(best))
    chosen = _groups(nodes, distance).groupBy("component").agg(F.min("best").alias("best")).select(F.col("best.digest").alias("digest"))
    keys = stored(rows.join(chosen, "digest", "left_semi").groupBy(F.col("digest").alias("_digest")).agg(F.count("*").alias("_n")), "kept")
    kept = docs.select(F.struct("*").alias("_row"), row_digest(docs).alias("_digest")).join(keys, "_digest")
    out = kept.where("_n = 1").select("_row")
    if keys.where("_n > 1").limit(1).count():
        # equal rows: any of them, one per task before they move
        out = out.unionByName(kept.where("_n > 1").groupBy("_digest").agg(F.first("_row").alias("_row")).select("_row"))
    return out.select("_row.*")
