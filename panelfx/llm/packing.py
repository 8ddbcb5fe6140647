"""Concatenate and cut: documents end to end in fixed windows, with global offsets from prefix sums.

Pass one tokenizes each partition once and writes the ids with the document's place in its partition.
The partitions' token totals (one row a partition) are summed into each partition's global offset.
Pass two cuts every document where a window ends. No row of text or ids is ever shuffled; only
windows that span partitions need pieces of two tasks, and those are the boundary records.

Written pass-one files fix the order, so a task that runs again yields the same offsets.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import save

WINDOW, END_ID = 2048, 1
#: Chunks (a word with the space before it) whose ids a worker remembers; then it starts afresh.
CACHE = 300_000
#: How byte-level BPE files of this kind part a text (the library's own pattern).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space before white space or the end.
_BLANK_RUN = re.compile(r" (?!\S)")


class ChunkTokenizer:
    """Ids of whole texts from a tokenizer file, with remembered ids of single chunks.

    A byte-level BPE of this kind never merges across a space that a visible character follows, so a
    text can be cut before each such space. Texts in which a space meets other white space, and those
    that hold an added token, are tokenized whole. Where the file's ids follow its merges' order, chunks
    are merged by a faster library that gives the same ids.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            parsed = json.load(f)
        self.added = [t["content"] for t in parsed.get("added_tokens") or []]
        self.fast = _ranked(parsed)
        self.known: dict[str, bytes] = {}  # by what follows the space

    def _whole(self, text: str) -> bytes:
        return array("I", self.encode.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if _BLANK_RUN.search(text) or any(t in text for t in self.added):
            return self._whole(text)
        head, *rest = text.split(" ")
        if len(self.known) > CACHE:
            self.known.clear()
        known = self.known
        ids = list(map(known.get, rest))
        if None in ids:
            for k, found in enumerate(ids):
                if found is None:
                    ids[k] = known[rest[k]] = self._chunk(" " + rest[k])
        return self._chunk(head) + b"".join(ids)

    def _chunk(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        return array("I", self.fast.encode_ordinary(chunk)).tobytes() if self.fast else self._whole(chunk)


def _ranked(parsed: dict):
    """The vocabulary as merge ranks, if the file is a plain byte-level BPE whose ids follow its merges; else None."""
    model, split = parsed["model"], parsed.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and not parsed.get("normalizer") and not model.get("dropout") and not model.get("ignore_merges")
    if not plain or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return None
    vocab = model["vocab"]
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    if any(vocab.get(m) != 256 + k for k, m in enumerate(merged)):
        return None
    import tiktoken

    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    byte_of = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}
    added = {t["content"] for t in parsed.get("added_tokens") or []}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in added}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: One tokenizer a worker process: its remembered chunks serve all tasks that the worker runs.
_LOADED: dict[str, ChunkTokenizer] = {}


def load(path: str) -> ChunkTokenizer:
    if path not in _LOADED:
        _LOADED[path] = ChunkTokenizer(path)
    return _LOADED[path]


def tokenize(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Pass one: ``(id, part, begin, n, ids)``; ids end with ``end_id``, begin is the place in the partition."""
    ship(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part, begin = load(tokenizer_path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype="<u4").tobytes()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                ids = [tok.ids(t.as_py() or "") + end for t in b.column(1).slice(at, 256)]
                n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                ends = begin + np.cumsum(n)
                arrays = [b.column(0).slice(at, 256), pa.array(np.full(len(n), part, dtype=np.int32)), pa.array(ends - n), pa.array(n), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "part", "begin", "n", "ids"])
                begin = int(ends[-1])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, part int, begin long, n long, ids binary")


def global_offsets(tokens: DataFrame) -> DataFrame:
    """Partition totals to ``(part, base)``: one row a partition, summed before it."""
    totals = tokens.groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row a piece: id, start, length, ids (binary, little-endian uint32), doc_tokens, sequence_id, offset, boundary.

    A null or empty text is just the end id. Repeated rows are packed each. Every id of every document
    is in exactly one piece; sequences are full but for the last. ``boundary`` marks pieces of a
    document that continues in another sequence. An empty table gives an empty result; extra columns
    are ignored. Texts of any length are tokenized whole.
    """
    tokens = save(tokenize(docs, tokenizer_path, id_col, text_col, end_id), "tokens")
    placed = tokens.join(F.broadcast(save(global_offsets(tokens), "offsets")), "part")
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                own = b.slice(at, 256)
                begin, n = own.column(1).to_numpy(), own.column(2).to_numpy()
                pieces = (begin + n - 1) // window - begin // window + 1
                row = np.repeat(np.arange(len(n)), pieces)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                seq = begin[row] // window + nth
                lo, hi = np.maximum(begin[row], seq * window), np.minimum(begin[row] + n[row], (seq + 1) * window)
                raw = own.column(3).to_pylist()
                ids = [raw[r][4 * s : 4 * e] for r, s, e in zip(row, lo - begin[row], hi - begin[row], strict=True)]
                arrays = [own.column(0).take(pa.array(row)), pa.array(lo - begin[row]), pa.array(hi - lo), pa.array(ids, pa.binary()), pa.array(n[row]), pa.array(seq), pa.array(lo - seq * window), pa.array(pieces[row] > 1)]
                yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "boundary"])

    rows = placed.select(id_col, (F.col("base") + F.col("begin")).alias("begin"), "n", "ids")
    return rows.mapInArrow(cut, f"`{id_col}` {id_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, boundary boolean")


def ids_crc32(pieces: DataFrame) -> DataFrame:
    """Replace the pieces' ids by their CRC-32."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """Pieces to whole windows ``(sequence_id, tokens, ids)``, the last padded; a group has one window's ids at most."""
    joined = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("tokens"))
    pad = int(pad_id).to_bytes(4, "little") * window
    body = F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return joined.select("sequence_id", "tokens", F.substring(F.concat(body, F.lit(pad)), 1, 4 * window).alias("ids"))
