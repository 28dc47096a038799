"""Near-duplicate documents by MinHash, confirmed on whole shingle sets.

1. Each text becomes its set of distinct word shingles (64-bit hashes), the minima of many universal
   hash functions over the set, and a key for each band of minima.
2. Equal sets are one class; from here on one document stands for each.
3. Classes that share a band key are candidates. Each bucket gives a star of links to its least
   member, never all its pairs; a bucket of two keeps its link only if the two signatures agree
   often enough. Large-star and small-star join the stars to candidate groups.
4. Whatever is linked is inside one candidate group, so each group is confirmed on the full sets, in
   tasks of bounded size. A task gives one row for each document that it has linked to a smaller one.
5. Components of the confirmed links, spread to all documents of each class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed, mix, shingle_sets, stored, text_buffers
from tessera.llm.graph import connected_components

#: Minima in a band, and the chance to miss a pair at the threshold.
ROWS, MISS = 6, 1e-6
#: Documents in a block of a candidate group.
BLOCK = 256
#: So many components of more than BLOCK documents are broadcast at most, two numbers each; more are joined by a shuffle.
BROADCAST_LARGE = 200_000
#: Standard deviations that a signature may fall short of the threshold.
SLACK = 5.0


def bands_for(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands so that two sets of that similarity share none with a chance of at most `miss`."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7919)
    return rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each function a * x + b mod 2**32 over the set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 2**32 - 1, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(out, (a[:, None] * x[None, i : i + 1024] + b[:, None]).min(axis=1), out=out)
    return out


SIGNED = "doc_id long, n_shingles long, set_lo long, set_hi long, bands array<long>, signature binary"


def signatures(docs: DataFrame, k: int, threshold: float, rows: int = ROWS) -> DataFrame:
    """A row for each of docs (doc_id, text): set size, a 128-bit hash of the set, band keys and the minima's low bytes.

    Empty sets have no band keys.
    """
    bands = bands_for(threshold, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _functions(bands * rows)
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            for first, buf, offsets in text_buffers(batch.column(1)):
                sets = shingle_sets(buf, offsets, k)
                low = np.array([int(s.sum()) if len(s) else 0 for s in sets], np.uint64)
                high = np.array([int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum()) if len(s) else 0 for s in sets], np.uint64)
                least = np.array([minima(s, a, b) for s in sets], np.uint32).reshape(len(sets), bands, rows)
                keys = np.tile(salt, (len(sets), 1))
                for i in range(rows):
                    keys = mix(keys + least[:, :, i])
                keys = keys.view(np.int64)
                small = (least & 0xFF).astype(np.uint8).reshape(len(sets), -1)
                full = np.array([len(s) > 0 for s in sets])
                values = pa.array(keys[full].reshape(-1))
                cuts = pa.array(np.concatenate([[0], np.cumsum(np.where(full, bands, 0))]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(low.view(np.int64)), pa.array(high.view(np.int64)), pa.ListArray.from_arrays(cuts, values), pa.array([x.tobytes() for x in small], pa.binary())],
                    ["doc_id", "n_shingles", "set_lo", "set_hi", "bands", "signature"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SIGNED)


def _agree(threshold: float, n: int) -> int:
    """Of n low bytes, how many two similar sets have in common at least."""
    return math.floor(n * threshold - SLACK * math.sqrt(n * threshold * (1 - threshold)))


def _labels(linked: np.ndarray) -> np.ndarray:
    """The least index that each row of a symmetric boolean matrix reaches."""
    n = len(linked)
    label = np.arange(n)
    while True:
        least = np.where(linked, label[None, :], n).min(axis=1)
        new = np.minimum(label, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def confirmed(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the least index that it reaches through pairs with 100 * intersection >= percent * union."""
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    if m == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([0, 0 if 100 * both >= percent * (size.sum() - both) else 1])
    owner = np.repeat(np.arange(m), size)
    code, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.cumsum(shared) - 1
    keep = shared[inverse]
    owner, col = owner[keep], column[inverse[keep]]
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    both = np.zeros((m, m), np.float32)
    width = 8192
    for lo in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(col, [lo, lo + width])
        dense = np.zeros((m, width), np.float32)
        dense[owner[a:b], col[a:b] - lo] = 1
        both += dense @ dense.T
    both = both.astype(np.int64)
    linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    return _labels(linked)


def _checked(placed: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(u, v) of every document that is linked to a smaller one in its task; placed has u, component, i and j, which name tasks."""

    def check(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        ids = rows.column("u").to_numpy()
        sets: list[np.ndarray] = []
        for _, buf, offsets in text_buffers(rows.column("text").combine_chunks()):
            sets += shingle_sets(buf, offsets, k)
        order = np.argsort(ids, kind="stable")
        label = confirmed([sets[i] for i in order], percent)
        ids = ids[order]
        linked = label < np.arange(len(ids))
        return pa.table({"u": ids[linked], "v": ids[label[linked]]})

    return placed.join(texts, "u").groupBy("component", "i", "j").applyInArrow(check, "u long, v long")


def _confirm(docs: DataFrame, groups: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (u, v) that hold the true components of groups (u, component) together.

    A group of up to BLOCK documents is one task. A larger one is first cut into blocks, each checked together
    with the group's least document. What that has not joined to the group's largest part, mostly little, is then
    checked block by block against all of the group; pairs within the largest part need no check.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("u"), "text").join(groups.select("u"), "u", "left_semi")
    zero = F.lit(0).alias("j")
    sizes = groups.groupBy("component").agg(F.count("*").alias("n"))
    large, _ = stored(sizes.where(F.col("n") > BLOCK).select("component", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    found = large.count()  # the rows of a large component stay where they are if its size comes to them
    members = groups.join(F.broadcast(large) if found <= BROADCAST_LARGE else large, "component", "left")
    members = members.select("u", "component", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    own = F.pmod(F.xxhash64("u"), F.col("blocks")).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    first = members.where("u <> component").select("u", "component", own.alias("i"), zero)
    first = first.unionByName(members.where("u = component").select("u", "component", each.alias("i"), zero))
    links = _checked(first, texts, k, percent)
    if not found:
        return links
    links, _ = stored(links)
    part = connected_components(links).withColumnRenamed("component", "root")
    large = members.where("blocks > 1").join(part, "u", "left").select("u", "component", "blocks", F.coalesce("root", "u").alias("root"))
    parts = large.groupBy("component", "root").agg(F.count("*").alias("m")).groupBy("component")
    parts = parts.agg(F.max_by("root", "m").alias("main"), (F.sum("m") - F.max("m")).alias("rest")).where("rest > 0")
    large = large.join(parts.select("component", "main", F.ceil(F.col("rest") / BLOCK).cast("int").alias("pieces")), "component")
    large, _ = stored(large)
    rest = large.where("root <> main").select("u", "component", F.pmod(F.xxhash64("u"), F.col("pieces")).cast("int").alias("i"), each.alias("j"))
    every = large.select("u", "component", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("i"), own.alias("j"))
    return links.unionByName(_checked(rest.unionByName(every).distinct(), texts, k, percent))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs (doc_id, text).

    Two documents are linked if 100 * intersection >= percent * union of their sets of k-word shingles
    (words are runs of anything but ASCII white space, A-Z lowered; fewer than k words are one shingle).
    component_id is the least doc_id that links reach. Texts that are null or have no words have an empty
    set, are linked with nothing and kept. Rows that repeat a doc_id are one document with several texts;
    a row whose doc_id is null is linked with nothing and kept, with a null component_id.
    """
    threshold = percent / 100
    signed = checkpointed(signatures(docs, k, threshold, rows))
    classes = signed.where("doc_id is not null and n_shingles > 0").groupBy("set_lo", "set_hi", "n_shingles").agg(F.min("doc_id").alias("rep"))
    classes = checkpointed(classes)
    # a document with several texts may stand for several classes: its rows then share one id, which links them
    standing = signed.where("n_shingles > 0").join(classes, (signed.doc_id == classes.rep) & (signed.set_lo == classes.set_lo) & (signed.set_hi == classes.set_hi), "left_semi")
    keyed = standing.select(F.col("doc_id").alias("u"), F.explode("bands").alias("band"))
    buckets = keyed.groupBy("band").agg(F.count("*").alias("n"), F.min("u").alias("v"), F.max("u").alias("last")).where("n > 1 and v < last")
    pairs = buckets.where("n = 2").select(F.col("last").alias("u"), "v").distinct()
    stars = keyed.join(buckets.where("n > 2").select("band", "v"), "band").where("u <> v").select("u", "v").distinct()
    n = bands_for(threshold, rows) * rows
    signature = standing.groupBy("doc_id").agg(F.min("signature").alias("s"), F.count("*").alias("texts"))
    alike = _agreeing(pairs, signature, _agree(threshold, n))
    groups = connected_components(alike.unionByName(stars))
    groups = checkpointed(groups.unionByName(groups.select(F.col("component").alias("u"), "component").distinct()))
    links = _confirm(docs, groups, k, percent)
    same = signed.where("doc_id is not null and n_shingles > 0").join(classes, ["set_lo", "set_hi", "n_shingles"]).where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    found = connected_components(links.unionByName(same))
    return (
        signed.select("doc_id", "n_shingles")
        .join(found.select(F.col("u").alias("doc_id"), "component"), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def _agreeing(pairs: DataFrame, signature: DataFrame, least: int) -> DataFrame:
    """Pairs (u, v) whose signatures agree in at least `least` bytes; documents with several texts always pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in (batch.column(2), batch.column(3)))
            several = batch.column(4).to_numpy(zero_copy_only=False) > 2
            good = pa.array(((a == b).sum(axis=1) >= least) | several)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], ["u", "v"])

    left = signature.select(F.col("doc_id").alias("u"), F.col("s").alias("su"), F.col("texts").alias("nu"))
    right = signature.select(F.col("doc_id").alias("v"), F.col("s").alias("sv"), F.col("texts").alias("nv"))
    both = pairs.join(left, "u").join(right, "v").select("u", "v", "su", "sv", (F.col("nu") + F.col("nv")).alias("texts"))
    return both.mapInArrow(run, "u long, v long")
