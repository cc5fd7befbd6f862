"""BPE encoding and decoding through a table of distinct words.

1. Tasks split whole texts into words; the distinct words and their counts become one table, and each distinct word
   is encoded once.
2. Tasks turn texts into blocks: word codes in order of position.  The HOT most frequent words (a fixed number, so the
   table that every task loads is bounded) have codes of their own; every other word of a block gets a code within
   the block, and a row (block, code, word).
3. Those rows meet the word table by word; their ids return to the block.  The ids of the block's distinct words meet
   the id-to-piece table, and the block's ids and decoded texts are put together by position.

Rows shuffled are distinct words of a block, never single positions.
"""

from __future__ import annotations

import functools
import itertools
import re
import struct
import unicodedata
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.llm.common import least_levels, level_of, materialize, record_batch, scratch_dir, table, text_or_empty, text_slices
from terralith.llm.vocab import default_path, word_parts

VOCABULARY = "word_bpe_49k.json"
#: This many of the most frequent words are known to every task.
HOT = 1 << 18
#: A block holds texts of about this many bytes, or one longer text.
BLOCK_BYTES = 1 << 22
#: A task counts up to about this many distinct chunks between white space before it sends their words, SENT at once.
COUNTED, SENT = 1 << 17, 1 << 14
#: Codes of so many chunks are remembered within a block.
SEEN = 1 << 16
#: Ids are gathered for about this many word codes at once.
GATHERED = 1 << 17
#: Longer words stay out of the hot table, so that its size is bounded in bytes too.
HOT_CHARS = 64

# Unicode white space, and the word pattern of the vocabulary file (fixed values)
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_WORD = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_SPACE}\p{{L}}\p{{N}}]+"


@functools.lru_cache(maxsize=1)
def _patterns():
    import regex

    return regex.compile(_WORD)


@functools.lru_cache(maxsize=2)
def _special(path: str):
    """Pattern of the special tokens' strings, and their ids."""
    found = word_parts(path)[2]
    return (re.compile("(" + "|".join(map(re.escape, sorted(found, key=len, reverse=True))) + ")") if found else None), found


def _lowered(text: str) -> str:
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    # one character at a time: a capital sigma has one lower form, wherever it stands
    return text.replace("Σ", "σ").lower()


def split_words(text: str, path: str) -> list[str]:
    """The words of a text in order.  A special token's string is one word, marked by a leading NUL."""
    pattern, _ = _special(path)
    find = _patterns().findall
    if pattern is None or "<" not in text:
        return find(_lowered(text))
    out = []
    for k, part in enumerate(pattern.split(text)):
        out += [f"\0{part}"] if k % 2 else find(_lowered(part))
    return out


_ODD_SPACE = re.compile("[\x1c-\x1f]")


def split_chunks(text: str, path: str) -> list[str]:
    """The text's chunks between white space, in order; no word spans two.  Texts with special tokens, or with control
    characters that only Python takes for white space, come as single words."""
    pattern, _ = _special(path)
    if ("<" in text and pattern is not None and pattern.search(text)) or _ODD_SPACE.search(text):
        return split_words(text, path)
    return _lowered(text).split()


def words_of(chunk: str, path: str) -> list[str]:
    if chunk[0] == "\0" and chunk[1:] in _special(path)[1]:
        return [chunk]
    return _patterns().findall(chunk)


def distinct_words(texts: DataFrame, path: str | None) -> DataFrame:
    """(word, n): every distinct word of column `_text` with its number of occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: Counter = Counter()
        file = path or default_path(VOCABULARY)

        def counted() -> Iterator[pa.RecordBatch]:
            n: dict[str, int] = {}
            while chunks:
                chunk, k = chunks.popitem()
                for w in words_of(chunk, file):
                    n[w] = n.get(w, 0) + k
                if len(n) >= SENT:
                    yield record_batch(word=list(n.keys()), n=list(n.values()))
                    n = {}
            if n:
                yield record_batch(word=list(n.keys()), n=list(n.values()))

        for part in text_slices(batches):
            chunks.update(itertools.chain.from_iterable(split_chunks(t, file) for t in part.column("_text").to_pylist()))
            if len(chunks) >= COUNTED:
                yield from counted()
        yield from counted()

    return texts.select("_text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def encode_words(words: DataFrame, path: str | None) -> DataFrame:
    """words (word, n) with ids, binary (little-endian unsigned 32-bit): each distinct word encoded once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, _, special = word_parts(path or default_path(VOCABULARY))
        for part in text_slices(batches, "word", 1 << 14):
            words = part.column("word").to_pylist()
            ids = [e.ids for e in model.encode_batch(words, add_special_tokens=False)]
            for i, w in enumerate(words):
                if w.startswith("\0") and w[1:] in special:
                    ids[i] = [special[w[1:]]]
            yield record_batch(word=part.column("word"), n=part.column("n"), ids=pa.array([struct.pack(f"<{len(x)}I", *x) for x in ids], pa.binary()))

    return words.select("word", "n").mapInArrow(encode, "word string, n long, ids binary")


def word_table(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(word, n, ids) of all distinct words of docs.text."""
    return materialize(encode_words(distinct_words(docs.select(text_or_empty().alias("_text")), path), path))


def write_hot_words(words: DataFrame, hot: int, folder: str) -> None:
    """Write the most frequent short words, `hot` at most, below `folder`: those from the least count on for which
    they are no more."""
    short = words.filter(F.char_length("word") <= HOT_CHARS)
    least = least_levels(short, "n", hot).get(None, 0)
    short.filter(level_of("n") >= least).select("word", "n", "ids").write.parquet(folder)


@functools.lru_cache(maxsize=1)
def _hot_table(folder: str, forms: bool) -> dict[str, int] | Ids:
    """The code of each hot word or, if `forms`, the ids of each code.  Read by each worker, which keeps the one that
    its stage needs; the driver never has it."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    rows = pq.read_table(root, columns=["word", "n", *["ids"] * forms], filesystem=store).sort_by([("n", "descending"), ("word", "ascending")])
    return Ids.of(rows.column("ids")) if forms else {w: i for i, w in enumerate(rows.column("word").to_pylist())}


class Ids:
    """The ids of each code: all in one array, and where each code's begin (and the last ones end)."""

    def __init__(self, flat: np.ndarray, starts: np.ndarray) -> None:
        self.flat, self.starts = flat, starts

    @classmethod
    def of(cls, coded: pa.ChunkedArray) -> Ids:
        parts = [c for c in coded.chunks if len(c)]
        sizes = [np.diff(np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]) // 4 for c in parts]
        flat = [np.frombuffer(b"".join(c.to_pylist()), "<u4") for c in parts]
        return cls(np.concatenate([np.zeros(0, "<u4"), *flat]), np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes]))]).astype(np.int64))

    def __len__(self) -> int:
        return len(self.starts) - 1

    def followed_by(self, other: Ids) -> Ids:
        return Ids(np.concatenate([self.flat, other.flat]), np.concatenate([self.starts, other.starts[1:] + self.starts[-1]]))

    def gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the codes in order, and how many each code has."""
        begin = self.starts[codes]
        sizes = self.starts[codes + 1] - begin
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(begin - ends + sizes, sizes) + np.arange(int(sizes.sum()))], sizes


def decode(ids: np.ndarray, pieces: np.ndarray) -> str:
    """The pieces of the ids in order, a space between: each id meets the id-to-piece table."""
    return " ".join(pieces[ids].tolist())


def _squeeze(codes: array, ends: list[int], n_own: int, rows: pa.Table) -> bytes:
    """A block's word codes, where each text's end, how many words are its own, and the texts' other columns."""
    # the bytes of equal weight of all codes stand together
    planes = np.asarray(codes, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    head = struct.pack("<QQQ", len(codes), len(ends), n_own)
    return zstandard.compress(b"".join([head, planes, np.asarray(ends, "<u8").tobytes(), sink.getvalue()]), 3)


def _unsqueeze(data: bytes) -> tuple[np.ndarray, list[int], int, pa.Table]:
    data = zstandard.decompress(data)
    n, texts, own = struct.unpack_from("<QQQ", data)
    codes = np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * n, 24).reshape(4, -1).T).view("<u4").ravel()
    ends = np.frombuffer(data, np.uint8, 8 * texts, 24 + 4 * n).copy().view("<u8").astype(np.int64).tolist()
    return codes, ends, own, pa.ipc.open_stream(pa.py_buffer(data)[24 + 4 * n + 8 * texts :]).read_all()


def encode_documents(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), words: DataFrame | None = None, path: str | None = None, hot: int = HOT) -> DataFrame:
    """Per row of docs (text and the columns `keep`): those columns, n_tokens, ids (binary, little-endian unsigned
    32-bit) and decoded.

    Null text is empty: no ids, decoded "".  Any text is encoded whole.  Rows that repeat are encoded each; an empty
    table gives an empty result.  Other columns are ignored, whatever their names.  `path` names the vocabulary file on
    every machine; by default each finds its own copy.
    """
    words = word_table(docs, path) if words is None else words
    kept = docs.select(*keep, text_or_empty().alias("_text"))
    folder, hot_folder = scratch_dir(docs.sparkSession), scratch_dir(docs.sparkSession)
    write_hot_words(words, hot, hot_folder)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        file = path or default_path(VOCABULARY)
        hot_codes, name, out, at, number = _hot_table(hot_folder, False), uuid.uuid4().hex, None, 0, TaskContext.get().partitionId() << 32
        first = len(hot_codes)
        own: dict[str, int] = {}
        seen: dict[str, list[int]] = {}
        codes, ends, rows, size = array("I"), [], [], 0

        def block() -> Iterator[pa.RecordBatch]:
            nonlocal codes, ends, rows, size, out, at, number
            data = _squeeze(codes, ends, len(own), pa.Table.from_batches(rows))
            out = out or store.open_output_stream(f"{root}/{name}", compression=None)
            out.write(data)
            yield record_batch(block=pa.array([number]), code=pa.array([-1], pa.int32()), word=[name], start=pa.array([at]), length=pa.array([len(data)]))
            if own:
                n, zero = len(own), pa.array(np.zeros(len(own), np.int64))
                yield record_batch(block=pa.array(np.full(n, number)), code=pa.array(np.fromiter(own.values(), np.int32, n)), word=list(own), start=zero, length=zero)
            at, number, codes, ends, rows, size = at + len(data), number + 1, array("I"), [], [], 0
            own.clear()
            seen.clear()

        for part in text_slices(batches):
            for text in part.column("_text").to_pylist():
                for chunk in split_chunks(text, file):
                    known_codes = seen.get(chunk)
                    if known_codes is None:
                        known_codes = seen[chunk] = [c if (c := hot_codes.get(w)) is not None else own.setdefault(w, first + len(own)) for w in words_of(chunk, file)]
                    codes.extend(known_codes)
                if len(seen) > SEEN:
                    seen.clear()
                ends.append(len(codes))
            rows.append(pa.RecordBatch.from_arrays(part.columns[:-1], names=part.schema.names[:-1]) if len(part.columns) > 1 else pa.record_batch({"_none": pa.nulls(part.num_rows)}))
            size += part.column("_text").nbytes
            if size >= BLOCK_BYTES:
                yield from block()
        if rows:
            yield from block()
        if out is not None:
            out.close()

    # blocks lie in files of the shared folder, one a task; only their places and their rarer words are rows
    packed = materialize(kept.mapInArrow(pack, "block long, code int, word string, start long, length long"))
    asked = packed.filter("code >= 0").select("block", "code", "word")
    rare = asked.join(words.select(F.col("word").alias("_word"), "ids"), F.col("word") == F.col("_word")).select("block", "code", "ids")
    blocks = packed.filter("code < 0").select(F.col("block").alias("_name"), F.col("word").alias("file"), "start", "length")

    def unpack(block: pa.Table, answers: pa.Table) -> pa.Table:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        pieces = word_parts(path or default_path(VOCABULARY))[1]
        place = block.to_pylist()[0]
        with store.open_input_file(f"{root}/{place['file']}") as f:
            codes, ends, n_own, rows = _unsqueeze(f.read_at(place["length"], place["start"]))
        if answers.num_rows != n_own:
            raise ValueError(f"{answers.num_rows} of {n_own} words of a block have ids")
        known = _hot_table(hot_folder, True).followed_by(Ids.of(answers.sort_by("code").column("ids")))
        data, decoded, i, begin = [], [], 0, 0
        while i < len(ends):
            j = max(i + 1, int(np.searchsorted(ends, begin + GATHERED, "right")))
            ids, sizes = known.gather(codes[begin : ends[j - 1]].astype(np.int64))
            upto, base = np.concatenate([[0], np.cumsum(sizes)]), begin
            for end in ends[i:j]:
                mine = ids[upto[begin - base] : upto[end - base]]
                data.append(mine.tobytes())
                decoded.append(decode(mine, pieces))
                begin = end
            i = j
        columns = {c: rows.column(c) for c in rows.column_names if c in keep}
        return pa.table(columns | {"n_tokens": pa.array([len(x) // 4 for x in data], pa.int64()), "ids": pa.array(data, pa.binary()), "decoded": pa.array(decoded, pa.string())})

    schema = ", ".join([*(f"`{c}` {t}" for c, t in kept.drop("_text").dtypes), "n_tokens long, ids binary, decoded string"])
    return blocks.groupBy("_name").cogroup(rare.groupBy("block")).applyInArrow(unpack, schema)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_documents(table(spark, sf_dir, "documents")))


def digests(coded: DataFrame) -> DataFrame:
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
