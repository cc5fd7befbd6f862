"""Helpers shared by the corpus operators: tables, shared scratch space, text as arrays."""

from __future__ import annotations

import contextlib
import ctypes
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where scratch tables of a session with a local master go if it names no folder.
LOCAL_SCRATCH = "/tmp/checkpoints"
#: Bytes of text that become Python strings at once.
SLICE = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_base(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir, as a URI; a path without a scheme is one of
    Hadoop's default file system.  Only a session with a local master, where all tasks share the machine, may leave the
    setting out."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{LOCAL_SCRATCH}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    base = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:/+", "file:///", base).rstrip("/")


#: Folders made so far by each application, oldest first.
_MADE: dict[str, list[str]] = {}


def scratch_dir(spark: SparkSession) -> str:
    """A new folder name below the shared folder."""
    folder = f"{scratch_base(spark)}/llm-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return folder


def scratch_mark(spark: SparkSession) -> int:
    """How many scratch folders there are, for drop_scratch()."""
    return len(_MADE.get(spark.sparkContext.applicationId, []))


def drop_scratch(spark: SparkSession, mark: int = 0, keep: int = 0) -> None:
    """Delete the scratch folders made since `mark`, but for the `keep` newest.  Results that are not written yet may
    need them: only for callers that have written what they want."""
    made = _MADE.get(spark.sparkContext.applicationId, [])
    for folder in made[mark : len(made) - keep]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        made.remove(folder)


#: Bytes that Spark sends to a Python worker at once while an operator writes a table of its own.
ARROW_BATCH = "4m"


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, size: str = ARROW_BATCH) -> Iterator[None]:
    """Actions within run with Arrow batches of `size`; afterwards the session is as it was."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df: DataFrame, partitions: int | None = None, codec: str = "snappy") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    with arrow_batches(spark):
        (df if partitions is None else df.coalesce(partitions)).write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def clear_of(names, taken) -> str:
    """A prefix that no name in `taken` begins with, for helper columns beside a caller's own."""
    prefix = "_"
    while any(t.lower().startswith(prefix) for t in taken):
        prefix += "_"
    return prefix + names


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "_text", limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts have about `limit` bytes; a longer text stands alone.  Batches stay Arrow
    memory; only a slice becomes Python strings."""
    for batch in batches:
        for part in array_slices(batch.column(column), limit):
            yield batch.slice(part.start, part.stop - part.start)
    release_memory()


def release_memory() -> None:
    """Give what a task has freed back to the system: its Python worker goes on to other tasks, or waits for them."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def array_slices(texts: pa.Array, limit: int = SLICE) -> Iterator[slice]:
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield slice(start, stop)
        start = stop


def record_batch(**columns) -> pa.RecordBatch:
    """A batch of arrays or lists."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns.values()], list(columns))


def frame(**columns) -> pd.DataFrame:
    """A pandas frame whose lists become plain object columns, which any Arrow type can be built from."""
    n = max((len(c) for c in columns.values() if isinstance(c, (list, np.ndarray, pd.Series))), default=0)
    out = {}
    for name, c in columns.items():
        if isinstance(c, np.ndarray):
            out[name] = c
        else:
            values = list(c) if isinstance(c, (list, pd.Series)) else [c] * n
            held = np.empty(n, object)
            for i, v in enumerate(values):
                held[i] = v
            out[name] = held
    return pd.DataFrame(out, index=range(n))


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def text_key(col: str = "text") -> Column:
    """128 bits of the text's SHA-256 as 32 hex digits: equal for equal texts (null counts as empty)."""
    return F.substring(F.sha2(text_or_empty(col), 256), 1, 32)


def id_bucket(col: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo `modulus`; null ids fall into bucket -1."""
    return F.coalesce(F.pmod(F.crc32(F.col(col).cast("string")), F.lit(modulus)), F.lit(-1))


def least_levels(df: DataFrame, count: str, limit: int, by: str | None = None) -> dict:
    """For each value of `by` (or None) the least `level` (see level_of) of the column `count` from which on there are
    no more than `limit` rows.  A few hundred levels a value come to the driver, never the rows."""
    keys = [] if by is None else [by]
    levels = df.groupBy(*keys, level_of(count).alias("_level")).agg(F.count("*").alias("_n")).collect()
    out, totals, full = {}, {}, set()
    for row in sorted(levels, key=lambda r: -r["_level"]):
        key = row[by] if by else None
        totals[key] = totals.get(key, 0) + row["_n"]
        if totals[key] > limit:
            full.add(key)
        if key not in full:
            out[key] = row["_level"]
    return {k: out.get(k, 1 << 30) for k in totals}


def level_of(count: str) -> Column:
    """The count to a sixteenth of a power of two."""
    return F.floor(F.log2(F.col(count)) * 16)


def class_sample(rows: DataFrame, classes, sample: int, sample_bytes: int, least: int) -> DataFrame:
    """A bounded sample of rows (label, order, size): for each of the classes up to its even share of `sample` rows in
    ascending order whose sizes together stay within its even share of `sample_bytes` (a row that doesn't fit is passed
    over); if these are fewer than `least`, the smallest others too, until there are so many.  Only these rows' numbers,
    at most `sample` and `least` a class, come to the driver.  Columns label and order."""
    rows, picked = materialize(rows.select("label", "order", "size")), []
    for label in classes:
        mine, left, taken = rows.filter(F.col("label") == label), sample_bytes // len(classes), {}
        for r in mine.orderBy("order", "size").limit(sample // len(classes)).collect():
            if r["size"] <= left and r["order"] not in taken:
                left -= r["size"]
                taken[r["order"]] = label
        if len(taken) < least:
            for r in mine.orderBy("size", "order").limit(least).collect():
                if len(taken) < least:
                    taken[r["order"]] = label
        picked += [(label, order) for order in taken]
    return rows.sparkSession.createDataFrame(picked, "label int, order long")


# --- text as arrays -------------------------------------------------------------------------------

_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """Powers of an odd multiplier and of its inverse modulo 2**64, grown on demand.  Those for more than KEPT bytes are
    not kept, or a long text would cost its worker 16 times its bytes from then on."""

    KEPT = 1 << 21

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 20)
            up, down = (
                np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, m, np.uint64)]))
                for m in (np.uint64(_MULT), np.uint64(_INV))
            )
            if n > self.KEPT:
                return up, down
            self.up, self.down = up, down
        return self.up, self.down


_POWERS = Powers()


def segments(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs where `inside` holds."""
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each run, independent of where the run stands."""
    up, down = _POWERS.get(len(data) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])
    length = (ends - starts).astype(np.uint64)
    return mix64((total[ends] - total[starts]) * down[starts] + length * np.uint64(0xD6E8FEB86659FD93))


def chunks_of(texts: list[str], limit: int = 1 << 20):
    """Slices of the list that hold about `limit` characters each; a longer text stands alone."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield slice(begin, i)
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield slice(begin, len(texts))


def joined_bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the texts, a newline after each, and the offset of each text (and the end)."""
    coded = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join([*coded, b""]), np.uint8)
    return data, np.concatenate([[0], np.cumsum([len(c) + 1 for c in coded])]).astype(np.int64)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of non-white ASCII-space-separated characters) of all texts in order; per text
    the range of its words as offsets (len(texts) + 1 numbers)."""
    data, at = joined_bytes(texts)
    starts, ends = segments(data, ~_SPACE[data])
    return run_hashes(data, starts, ends), np.searchsorted(starts, at)


_STEP = [np.uint64(pow(0xC2B2AE3D27D4EB4F | 1, k + 1, 1 << 64)) for k in range(16)]


def shingle_hashes(texts: list[str], width: int = 5) -> list[np.ndarray]:
    """Per text the hashes of its `width`-word shingles in order, lower-cased.  A text of one to width - 1 words
    has one shingle, all its words; a text without words has none."""
    words, at = word_hashes([t.lower() for t in texts])
    out = []
    full = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        full += words[k : k + len(full)] * _STEP[k]
    full = mix64(full)
    for a, b in zip(at[:-1], at[1:]):
        n = b - a
        if n >= width:
            out.append(full[a : b - width + 1])
        elif n:
            steps = np.array(_STEP[:n], np.uint64)
            out.append(mix64((words[a:b] * steps).sum(keepdims=True) + np.uint64(n)))
        else:
            out.append(full[:0])
    return out
