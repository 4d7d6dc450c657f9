"""SimHash near-duplicates by a segment-popcount embedding.

Each fingerprint maps to the bit counts of its 32 two-bit segments. The counts are held as
thermometer codes (0: 00, 1: 01, 2: 11), so the Manhattan distance of two embeddings
is the number of differing code bits; it never exceeds the Hamming distance.

Grid range-join: the segments form ``max_bits + 3`` blocks. Within Manhattan distance ``max_bits`` at
most that many blocks differ, so two such points agree on at least three blocks: they
share a unit cell of the grid over some three blocks. Points meet there, the
Manhattan bound drops most pairs, and the exact bit distance decides. A pair is judged in
the first cell that it shares only. A cell of many points is divided again by the bits
of three blocks themselves, in the same way, and then dealt out in pieces.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewise.llm.common import look_up, map_text, read, saved
from tidewise.llm.graph import components

SEED = 42
#: A cell of more points is divided again by bits; a piece of a cell has about so many points.
CELL = 512
EVEN = 0x5555555555555555
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprints(text: pa.Array, shingle: int) -> np.ndarray:
    """SimHash of each text as signed 64-bit integers; a text without words has 0."""
    n = len(text)
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    count = np.zeros(n, np.int64)
    for d, s in enumerate(text.to_pylist()):
        words = s.encode("utf-8").lower().split() if s else []
        if not words:
            continue
        joined = b" ".join(words)
        if len(words) <= shingle:
            hashes.append(digest(joined, SEED))
            count[d] = 1
            continue
        ends = np.cumsum([len(w) + 1 for w in words])
        first = np.r_[0, ends[:-shingle]].tolist()
        last = (ends[shingle - 1:] - 1).tolist()
        hashes += [digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)]
        count[d] = len(last)
    h = np.array(hashes, np.uint64)
    doc = np.repeat(np.arange(n), count)
    # histogram of byte values by (document, byte place), then bits by byte value
    at = (doc[:, None] * 2048 + np.arange(8) * 256 + h.view(np.uint8).reshape(-1, 8)).ravel()
    ones = np.zeros((n, 64), np.int64)
    for lo in range(0, n, 2048):  # bounds the histogram
        hi = min(n, lo + 2048)
        a, b = np.searchsorted(doc, [lo, hi])
        hist = np.bincount(at[a * 8:b * 8] - lo * 2048, minlength=(hi - lo) * 2048)
        ones[lo:hi] = (hist.reshape(-1, 256) @ _BITS).reshape(hi - lo, 64)
    return np.packbits(2 * ones > count[:, None], axis=1, bitorder="little").view(np.uint64).ravel().view(np.int64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _grid(max_bits: int) -> list[tuple[int, tuple[int, int, int]]]:
    """Masks of the cells: (bits of three blocks, up to max_bits earlier blocks that must differ)."""
    blocks = max_bits + 3
    edges = [2 * round(32 * k / blocks) for k in range(blocks + 1)]
    masks = [sum(1 << i for i in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    out = []
    for own in combinations(range(blocks), 3):
        earlier = [_signed(masks[k]) for k in range(own[-1]) if k not in own]
        out.append((_signed(masks[own[0]] | masks[own[1]] | masks[own[2]]), tuple(earlier + [0] * (max_bits - len(earlier)))))
    return out


def embedding(fp: Column) -> Column:
    """Thermometer codes of the bit counts of the 32 two-bit segments."""
    high, even = F.shiftrightunsigned(fp, 1), F.lit(EVEN)
    either = fp.bitwiseOR(high).bitwiseAND(even)
    both = fp.bitwiseAND(high).bitwiseAND(even)
    return either.bitwiseOR(F.shiftleft(both, 1))


def _cells(points: DataFrame, code: str, grid: list) -> DataFrame:
    """A row for each cell of each point, ``key`` names the cell (within its former key, if any)."""
    former = [F.col("key")] if "key" in points.columns else []
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("cell"), F.lit(m).alias("mask")) for i, (m, _) in enumerate(grid)]))
    return points.select("*", cells.alias("c")).withColumn("at", F.col("c.cell")).withColumn(
        "key", F.xxhash64(*former, F.col("c.cell"), F.col(code).bitwiseAND(F.col("c.mask")))).drop("c")


def _first_shared(diff: Column, cell: Column, grid: list) -> Column:
    """The pair differs in every earlier block that its cell leaves out."""
    ok = F.lit(True)
    for j in range(len(grid[0][1])):
        must = F.element_at(F.array(*[F.lit(e[j]) for _, e in grid]), cell + 1)
        ok = ok & ((must == 0) | (diff.bitwiseAND(must) != 0))
    return ok


def _crowded(cells: DataFrame, name: str) -> DataFrame:
    """Rows of the cells of two points or more, with the number of points ``n``."""
    sizes = saved(cells.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), f"{name}-sizes")
    return saved(look_up(cells, "key", sizes, "n", name).filter("n > 1"), f"{name}-shared")


def _pairs(cells: DataFrame, keep: Column) -> DataFrame:
    """Verified links inside cells; a cell of many points is dealt out in pieces."""
    pieces = F.ceil(F.col("n") / (8 * CELL)).cast("long")
    a = cells.withColumn("piece", F.pmod(F.xxhash64("fp"), pieces))
    b = cells.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)))
    a, b = a.alias("a"), b.alias("b")
    same = (F.col("a.key") == F.col("b.key")) & (F.col("a.piece") == F.col("b.piece")) & (F.col("a.fp") < F.col("b.fp"))
    return a.join(b, same & keep).select(F.col("a.fp").alias("fp_a"), F.col("b.fp").alias("fp_b"))


def links(classes: DataFrame, max_bits: int) -> DataFrame:
    """Pairs of different fingerprints (column ``fp``) at most ``max_bits`` bits apart, each once."""
    grid = _grid(max_bits)

    def diff(code: str) -> Column:
        return F.col(f"a.{code}").bitwiseXOR(F.col(f"b.{code}"))

    near = F.bit_count(diff("fp")) <= max_bits
    bound = F.bit_count(diff("code")) <= max_bits  # Manhattan distance of the embeddings
    cells = _crowded(saved(_cells(classes.select("fp", embedding(F.col("fp")).alias("code")), "code", grid), "cells"), "cells")
    first = (F.col("a.at") == F.col("b.at")) & _first_shared(diff("code"), F.col("a.at"), grid)
    plain = _pairs(cells.filter(F.col("n") <= CELL), first & bound & near)
    large = cells.filter(F.col("n") > CELL).drop("n").withColumnRenamed("at", "outer")
    finer = _crowded(saved(_cells(large, "fp", grid), "finer"), "finer")
    outer = (F.col("a.outer") == F.col("b.outer")) & _first_shared(diff("code"), F.col("a.outer"), grid)
    inner = (F.col("a.at") == F.col("b.at")) & _first_shared(diff("fp"), F.col("a.at"), grid)
    return saved(plain.unionByName(_pairs(finer, outer & inner & bound & near)), "pairs")


def _grouped(docs: DataFrame, text: str, carry: list[str], shingle: int, max_bits: int) -> DataFrame:
    """``carry`` columns (``doc_id`` among them), fp, root of the component, component_id, n_links of each row."""
    field = T.StructField("fp", T.LongType())
    rows = map_text(docs, text, carry, [field], lambda t: [pa.array(fingerprints(t, shingle), pa.int64())])
    rows = saved(rows, "fingerprints")
    classes = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n_docs")), "classes")
    found = links(classes, max_bits)
    degree = found.select(F.explode(F.array("fp_a", "fp_b")).alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("n_links"))
    roots = components(found, "fp_a", "fp_b").withColumnRenamed("node", "fp")
    marked = saved(classes.join(roots, "fp", "left").join(degree, "fp", "left")
                   .withColumn("root", F.coalesce("root", "fp")).fillna(0, ["n_links"]), "marked")
    groups = saved(marked.groupBy("root").agg(F.min("first_doc").alias("component_id"), F.count(F.lit(1)).alias("n_classes")), "groups")
    marked = saved(look_up(marked, "root", groups, "n_classes", "root").select("fp", "root", "component_id", "n_links", "n_docs"), "components")
    return look_up(rows, "fp", marked, "n_docs", "fp")


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_links) for each row.

    Documents link when their fingerprints differ in at most ``max_bits`` bits;
    ``component_id`` is the smallest doc_id reachable, ``n_links`` the number of other
    fingerprints linked. Equal fingerprints are one class before the join. Texts without
    words (null, empty) have fingerprint zero and link like any other. Repeated rows
    appear as often as given; a null doc_id never names a component, unless all are null.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    out = _grouped(rows, "text", ["doc_id"], shingle, max_bits)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_links")


def one_of_each_group(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """One row of ``docs`` for each component, also where an id is null or stands in several rows.

    It is the row with the smallest doc_id (null after all others); of several such rows the one whose text has the smallest
    SHA-256 (null first), then the one with the smallest other columns in their order.
    """
    digest = F.sha2(F.col("text").cast("binary"), 256)
    # a row's id and text as one key without nulls, so the join and the last choice need one shuffle of the texts
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit("/"), F.coalesce(digest, F.lit("none"))).cast("binary"))
    rows = _grouped(docs.select("doc_id", "text", digest.alias("__digest"), key.alias("__key")), "text", ["doc_id", "__digest", "__key"],
                    shingle, max_bits)
    chosen = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__digest", "__key")).alias("c"))
    kept = docs.withColumn("__key", key).join(chosen.select(F.col("c.__key").alias("__key")), "__key", "left_semi")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    first = kept.groupBy("__key").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in [*rest, "doc_id", "text"]])).alias("r"))
    return first.select(*[F.col(f"r.`{c}`").alias(c) for c in docs.columns])


def op5_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(read(spark, sf_dir, "documents"))
