"""What the corpus operators share: checkpoints in the cluster's folder and vectorised word hashing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TABLE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.int64).astype(_U) | _U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_CHUNK = 1 << 19
_powers: dict[int, np.ndarray] = {}
#: Bytes in one batch of rows between Spark and a Python worker. Executor, worker and both ways hold one each at a time, for every core.
BATCH_BYTES, _BATCH = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of texts that are scored together; what is worked out for each byte takes many times as much.
SCORED_AT_ONCE = 1 << 18


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that is unset, as in tests, it is set to a temporary folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return sc.getCheckpointDir()


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's batches of rows for Python workers by BATCH_BYTES, unless a smaller bound is set."""
    now = int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch())
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage through the shared folder, so a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, release: bool = False) -> tuple[DataFrame, str]:
    """The rows of df as a table of their own in the shared folder, and its path.

    Unlike a checkpoint it brings no constraints along, which grow without bound when one table is made from
    another again and again. The caller drops tables that it no longer needs. Shuffle files that led to the table
    go once the driver's garbage collector has found them unused, which it is asked for here.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4()}"
    df.write.option("compression", "zstd").parquet(path)
    if release:
        gc.collect()
        spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a stored table."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, _CHUNK + 1)
        have = np.empty(size, _U)
        have[0] = 1
        have[1:] = _U(base)
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def word_hashes(buf: np.ndarray, lower: bool = True, between: np.ndarray = _SPACE, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word of UTF-8 bytes, A-Z lowered if asked for.

    Words are what stands between bytes that `between` marks, [^\\x20\\x09-\\x0D]+ if not said otherwise.
    With prefixes the hashes have a row for the words and one for the first so many bytes of each; a word
    that is no longer has 0 there. Works through pieces that end between words, so memory stays a small
    multiple of a piece.
    """
    hashes, starts, ends = [], [], []
    at, n = 0, len(buf)
    while at < n:
        end = min(n, at + _CHUNK)
        while end < n and not between[buf[end - 1]]:
            gap = between[buf[end : end + 4096]]
            end = end + int(gap.argmax()) + 1 if gap.any() else min(n, end + 4096)
        piece = buf[at:end]
        word = ~between[piece]
        edge = np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(s):
            if lower:
                piece = _LOWER[piece]
            sums = np.empty(len(piece) + 1, _U)
            sums[0] = 0
            np.cumsum(_TABLE[piece] * _power(_BASE, len(piece)), out=sums[1:])
            back = _power(_INVERSE, len(piece))[s]
            h = mix((sums[e] - sums[s]) * back + (e - s).astype(_U))
            if prefixes:
                cut = [np.where(e - s > k, mix((sums[np.minimum(e, s + k)] - sums[s]) * back + _U(k * _BASE % 2**64)), _U(0)) for k in prefixes]
                h = np.stack([h, *cut])
            hashes.append(h)
            starts.append(s + at)
            ends.append(e + at)
        at = end
    if not hashes:
        shape = (1 + len(prefixes), 0) if prefixes else (0,)
        return np.empty(shape, _U), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(hashes, axis=-1), np.concatenate(starts), np.concatenate(ends)


def text_buffers(column: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, UTF-8 bytes with a line feed after each text, text starts and the end) of runs of a few MB; null is empty."""
    rows, first, size = [], 0, 0
    texts = column.to_pylist() if pa.types.is_dictionary(column.type) else column
    for i in range(len(texts)):
        value = texts[i].as_buffer() if not isinstance(texts, list) else (texts[i] or "").encode()
        data = b"" if value is None else bytes(value)
        if rows and size + len(data) > most:
            yield first, *_joined(rows)
            rows, first, size = [], i, 0
        rows.append(data)
        size += len(data) + 1
    if rows:
        yield first, *_joined(rows)


def _joined(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in rows], out=offsets[1:])
    return np.frombuffer(b"\n".join(rows) + b"\n", np.uint8), offsets


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text: k consecutive words, or all words as one where there are fewer."""
    h, starts, _ = word_hashes(buf)
    bounds = np.searchsorted(starts, offsets)
    rolled = np.zeros(max(0, len(h) - k + 1), _U)
    for i in range(k):
        rolled += mix(h[i : i + len(rolled)] + _U(0x632BE59BD9B4E019 * (i + 1) % 2**64))
    rolled = mix(rolled + _U(k))
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            part = sum((mix(h[a + i : a + i + 1] + _U(0x632BE59BD9B4E019 * (i + 1) % 2**64)) for i in range(b - a)), np.zeros(1, _U))
            out.append(mix(part + _U(b - a)))
        else:
            out.append(np.empty(0, _U))
    return out


def release_memory() -> None:
    """Gives back to the system what this process has freed but holds, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def crc32_mod(column, modulus: int):
    """crc32(id as text) mod modulus."""
    return F.crc32(column.cast("string").cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> list[tuple[str, int]]:
    """(text, label) of at most `per_class` documents of each class, in an order fixed by a hash of their ids.

    The number of rows that reach the driver is bounded by twice `per_class`. Null labels, ids and texts are left out.
    """
    chosen = None
    for value in (0, 1):
        own = labels.where((F.col(label) == value) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(value).alias("label"))
        own = own.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = own if chosen is None else chosen.unionByName(own)
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label").collect()
    return [(r["text"], r["label"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["label"], r["text"]))]


def adam(gradient, weights: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Minimises by Adam; gradient(weights, step) gives the gradient."""
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    for t in range(1, steps + 1):
        g = gradient(weights, t)
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        weights = weights - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return weights


def with_score(docs: DataFrame, scores) -> DataFrame:
    """docs with a column score, in one pass; scores(bytes, offsets) gives those of a run of texts.

    A column of docs that is called score already is replaced.
    """
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c != "score"]
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [scores(buf, offsets) for _, buf, offsets in text_buffers(batch.column(at), SCORED_AT_ONCE)]
            values = np.concatenate(parts) if parts else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], [*names, "score"])

    rows = docs.select(*names)
    return rows.mapInArrow(run, StructType([*rows.schema, StructField("score", DoubleType())]))
