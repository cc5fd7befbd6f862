"""Exact top-k search by distributed histogram selection.

Vectors of scaled integers are written once, in blocks, to the shared folder, and so are, each round, the starts of the
queries' ranges; rows that move between tasks name places in these files only.  Every block of queries meets every block of candidates.  Each round scores everything and counts scores in
histograms that are summed over all candidates; the bin that holds a query's kth score is the range of the next round,
until it is one value wide.  A last pass keeps the scores above the kth and, of the ties at it, those with the smallest
ids.

A task sends, for each query, only the bins down to the one in which its own kth score lies: the global kth score is
never below that, so the bins that decide are complete, and rows sent are bounded by k, not by the candidates.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terralith.llm.common import frame, materialize, scratch_dir, table

#: Rows of a block of queries and of candidates; a task holds one block of queries and WAVE rows of candidates.
QUERIES, CANDIDATES, WAVE = 512, 1 << 14, 2048
BINS = 4096
SCALE = 256.0

_BLOCKS = "block string, dim int, norm double, n long, file string, start long"


def pack(vectors: DataFrame, rows: int, folder: str) -> DataFrame:
    """Write vectors (vec_id, embedding), each component x as floor(256 x), in blocks of `rows` to files below `folder`
    and return where the blocks are.  A block is n ids (long), then n * dim components (double).

    Rows with a null id, a null vector, or null or non-finite components are left out.  Vectors of different lengths
    never share a block.  norm: the largest Euclidean norm in the block.
    """

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        held: dict[int, list] = {}
        name, out, at = uuid.uuid4().hex, None, 0

        def emit(dim: int) -> pd.DataFrame:
            nonlocal out, at
            part = held.pop(dim)
            data = np.stack([v for _, v in part]) if dim else np.zeros((len(part), 0))
            norm = float(np.sqrt((data * data).sum(axis=1)).max())
            out = out or store.open_output_stream(f"{root}/{name}", compression=None)
            out.write(np.array([i for i, _ in part], np.int64).tobytes())
            out.write(data.tobytes())
            row = frame(block=[f"{name}-{at}"], dim=[dim], norm=[norm], n=[len(part)], file=[name], start=[at])
            at += 8 * len(part) * (1 + dim)
            return row

        for batch in batches:
            for i, x in zip(batch["vec_id"], batch["embedding"]):
                if x is None or i is None or i != i:
                    continue
                v = np.floor(SCALE * np.array([np.nan if c is None else c for c in x] if x.dtype == object else x, np.float64))
                if not np.isfinite(v).all():
                    continue
                held.setdefault(len(v), []).append((int(i), v))
                if len(held[len(v)]) >= rows:
                    yield emit(len(v))
        for dim in list(held):
            yield emit(dim)
        if out is not None:
            out.close()

    valid = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id IS NOT NULL AND embedding IS NOT NULL")
    return materialize(valid.mapInPandas(blocks, _BLOCKS))


def _pair_up(queries: DataFrame, candidates: DataFrame, lows: DataFrame) -> DataFrame:
    """Where every block of queries, the starts of its queries' ranges (see _by_block) and every block of candidates of the
    same length are; dealt out one pair a task, up to TASKS tasks."""
    q = queries.select("block", "dim", F.col("n").alias("q_n"), F.col("file").alias("q_file"), F.col("start").alias("q_start"))
    q = q.join(lows.withColumnRenamed("block", "_b"), F.col("block") == F.col("_b")).drop("_b", "block")
    c = candidates.select(F.col("dim").alias("_dim"), F.col("n").alias("c_n"), F.col("file").alias("c_file"), F.col("start").alias("c_start"))
    counts = [{r["dim"]: r["n"] for r in x.groupBy("dim").agg(F.count("*").alias("n")).collect()} for x in (queries, candidates)]
    pairs = sum(n * counts[1].get(dim, 0) for dim, n in counts[0].items())
    return q.join(c, F.col("dim") == F.col("_dim")).drop("_dim").repartition(min(max(1, pairs), TASKS))


#: More pairs than this share tasks.
TASKS = 20000


def _scored(per_wave: Callable, schema: str, pairs: DataFrame, folders: tuple[str, str, str], width: float, span: float, merge: Callable | None = None) -> DataFrame:
    """What per_wave makes of the scores of every pair's waves; `merge` makes one frame of a pair's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        (store, q_root), (_, c_root), (_, l_root) = map(fs.FileSystem.from_uri, folders)

        def read(f, at: int, n: int, dim: int, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
            last = n if last is None else last
            ids = f.read_at(8 * (last - first), at + 8 * first)
            data = f.read_at(8 * dim * (last - first), at + 8 * n + 8 * dim * first)
            return np.frombuffer(ids, np.int64), np.frombuffer(data).reshape(last - first, dim)

        for batch in batches:
            for p in batch.itertuples(index=False):
                with store.open_input_file(f"{q_root}/{p.q_file}") as f:
                    q_ids, q = read(f, p.q_start, p.q_n, p.dim)
                with store.open_input_file(f"{l_root}/{p.l_file}") as f:
                    known, low = np.frombuffer(f.read_at(8 * p.q_n, p.l_start), np.int64), np.frombuffer(f.read_at(8 * p.q_n, p.l_start + 8 * p.q_n))
                lows, found = low[np.searchsorted(known, q_ids)], []
                with store.open_input_file(f"{c_root}/{p.c_file}") as f:
                    for first in range(0, p.c_n, WAVE):
                        c_ids, c = read(f, p.c_start, p.c_n, p.dim, first, min(p.c_n, first + WAVE))
                        scores = q @ c.T
                        scores[q_ids[:, None] == c_ids[None, :]] = -np.inf  # a query is no candidate of its own
                        found.append(per_wave(q_ids, scores, lows, width, span, c_ids))
                        if merge is None:
                            yield found.pop()
                if found:
                    yield merge(pd.concat(found))

    return pairs.mapInPandas(run, schema)


def _histograms(k: int) -> Callable:
    def count(q_ids, scores, lows, width, span, c_ids):
        offset = scores - lows[:, None]
        ok = (offset >= 0) & (offset < span)
        spot = np.floor(offset / width)
        row, _ = np.nonzero(ok)
        counts = np.bincount(row * BINS + spot[ok].astype(np.int64), minlength=len(q_ids) * BINS).reshape(len(q_ids), BINS)
        above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts  # scores in higher bins of this range
        sent = (counts > 0) & (above < k)
        row, at = np.nonzero(sent)
        return frame(query_id=q_ids[row], bin=at.astype(np.int64), n=counts[row, at])

    return count


def _winners(k: int) -> Callable:
    def keep(q_ids, scores, lows, width, span, c_ids):
        row, at = np.nonzero(scores >= lows[:, None])
        ok = np.isfinite(scores[row, at])
        row, at = row[ok], at[ok]
        order = np.lexsort((c_ids[at], -scores[row, at], row))
        row, at = row[order], at[order]
        first = np.searchsorted(row, row)
        best = np.arange(len(row)) - first < k
        row, at = row[best], at[best]
        score = np.clip(scores[row, at], -(2.0**63), 2.0**63 - 1024).astype(np.int64)
        return frame(query_id=q_ids[row], vec_id=c_ids[at], score=score)

    return keep


def _best(k: int) -> Callable:
    """The k best of each query among a pair's waves."""

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], kind="stable")
        return rows[rows.groupby("query_id").cumcount() < k]

    return merge


def _by_block(lows: DataFrame, folder: str) -> DataFrame:
    """Write lows (block, query_id, low) to files below `folder`, of each block its ids in ascending order and then their
    lows, and return where they are.  A block has QUERIES queries at most; a task writes one file."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name, out, at = uuid.uuid4().hex, None, 0
        rest = None

        def emit(rows: pd.DataFrame) -> pd.DataFrame:
            nonlocal out, at
            out = out or store.open_output_stream(f"{root}/{name}", compression=None)
            out.write(rows["query_id"].to_numpy(np.int64).tobytes() + rows["low"].to_numpy(np.float64).tobytes())
            at += 16 * len(rows)
            return frame(block=[rows["block"].iloc[0]], l_file=[name], l_start=[at - 16 * len(rows)])

        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch])
            last = rest["block"].iloc[-1] if len(rest) else None
            for _, rows in rest[rest["block"] != last].groupby("block", sort=False):
                yield emit(rows)
            rest = rest[rest["block"] == last]
        if rest is not None and len(rest):
            yield emit(rest)
        if out is not None:
            out.close()

    rows = lows.select("block", "query_id", "low").repartition("block").sortWithinPartitions("block", "query_id")
    return materialize(rows.mapInPandas(write, "block string, l_file string, l_start long"))


def search(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of each query (vec_id, embedding) with
    the candidates (vec_id, embedding), all of them if there are fewer; ties go to the smaller vec_id.

    Candidates with the query's own id take no part, nor do vectors of another length than the query's.  Of queries
    that share an id, the least vector counts; candidates that share an id each count.  Inner products are exact below
    2 ** 53 in size; larger ones are rounded to double precision and end at the range of long.  Other columns are
    ignored.  Empty tables give no rows.
    """
    spark = candidates.sparkSession
    single = queries.select("vec_id", "embedding").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    folders = scratch_dir(spark), scratch_dir(spark), scratch_dir(spark)
    q_blocks, c_blocks = pack(single, QUERIES, folders[0]), pack(candidates, CANDIDATES, folders[1])
    most = c_blocks.agg(F.max("norm")).first()[0], q_blocks.agg(F.max("norm")).first()[0]
    if None in most:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    names = materialize(q_blocks.select("block", "n", "file", "start").mapInPandas(_ids(folders[0]), "block string, query_id long"))
    bound = float(np.ceil(most[0] * most[1])) + 1
    lows, width = names.withColumn("low", F.lit(-bound)).withColumn("above", F.lit(0).cast("long")), float(np.ceil((2 * bound + 1) / BINS))
    span = width * BINS
    while True:
        counted = _scored(_histograms(k), "query_id long, bin long, n long", _pair_up(q_blocks, c_blocks, _by_block(lows, folders[2])), folders, width, span)
        summed = counted.groupBy("query_id", "bin").agg(F.sum("n").alias("n")).withColumnRenamed("query_id", "_q")
        down = Window.partitionBy("_q").orderBy(F.desc("bin"))
        held = summed.join(lows.select(F.col("query_id").alias("_id"), "above"), F.col("_q") == F.col("_id")).withColumn("_upper", F.col("above") + F.sum("n").over(down) - F.col("n"))
        # the bin in which the kth score lies; the lowest one if there are fewer than k
        found = held.filter(F.col("_upper") < k).groupBy("_q").agg(F.min("bin").alias("_bin"), F.max("_upper").alias("_upper"))
        moved = lows.join(found, F.col("query_id") == F.col("_q"), "left")
        low = F.col("low") + F.coalesce("_bin", F.lit(0)) * width
        lows = materialize(moved.select("block", "query_id", low.alias("low"), F.coalesce("_upper", "above").alias("above")))
        if width <= 1:
            break
        width, span = float(np.ceil(width / BINS)), width
    best = _scored(_winners(k), "query_id long, vec_id long, score long", _pair_up(q_blocks, c_blocks, _by_block(lows, folders[2])), folders, 1.0, 1.0, _best(k))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _ids(folder: str) -> Callable:
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for b in batch.itertuples(index=False):
                with store.open_input_file(f"{root}/{b.file}") as f:
                    yield frame(block=b.block, query_id=np.frombuffer(f.read_at(8 * b.n, b.start), np.int64))

    return read


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors.filter(F.col("vec_id") % 50 == 0), vectors, 5)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
