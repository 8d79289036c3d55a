"""Token-id output: documents as ids in files of independently coded blocks.

Texts are encoded with a tokenizer file, each document gets an end id, and ids
are written in ascending document order. A file holds the ids of consecutive
documents: a header, the document ids and lengths, and blocks of the range coder
(see ``coder``), each with its checksum. Files are rows of a table that Spark
writes to the shared folder, so a lost task leaves nothing half written;
``export_files`` puts them into a folder as single files. Reading gives every
document's ids and its place among all ids; places come from the files' totals,
summed per task first.

A word's ids do not depend on its neighbours: the tokenizer splits before every
blank that a non-blank character follows, around line ends beside such characters,
and between a letter or digit and common punctuation. So distinct words are found in many texts at once, encoded if no
task of the process saw them lately, and put together; texts with a special token's
string, and all texts of a tokenizer with other rules, go to it whole.

Defined cases: null and empty texts are an end id alone; rows with equal or null
ids are documents each, in the order (id, nulls first; text); ids beyond 16 bits
are refused; a damaged block is an error.
"""

from __future__ import annotations

import json
import os
import re
import string
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from lexmill.llm import coder
from lexmill.llm.common import pieces, row_keyed, stored, table, text_buffer

TOKENIZER = "byte_bpe_50k.json"
END = 2
FILE_IDS = 1 << 22
CACHE = 400_000
MAGIC = b"LXTOK2\0\0"
CLEAN = re.compile(" ?[^\\s\x1c-\x1f\x85]+")


def _borders() -> np.ndarray:
    """For a byte and the next: 1 if a word begins at the first, 2 if at the second, 3 if at the second after a lone line end, 0 if that is not sure."""
    blank, mark, alnum, shown = (np.isin(np.arange(256), [*x]) for x in ([*range(0x21), 0xC2, 0xE1, 0xE2, 0xE3], b".,;:!?()\"-", string.ascii_letters.encode() + string.digits.encode(), range(0x21, 0x7F)))
    out = np.zeros((256, 256), np.uint8)
    out[32, ~blank] = 1
    out[10, ~blank] = 3
    out[shown, 10] = 2
    out[np.ix_(alnum, mark)] = 2
    return out.ravel()


BORDERS = _borders()
# bytes of the letters A to Z, a to z and U+00C0 to U+023F, but for the signs of times and division
LETTER = np.isin(np.arange(256), [*string.ascii_letters.encode(), *range(0x80, 0xC0), *range(0xC3, 0xC9)])
SIGN = np.isin(np.arange(256), [0x97, 0xB7])


def _alphabet() -> np.ndarray:
    """The character of each byte in byte-level tokens; a line end stays one."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = np.zeros(256, "<u4")
    out[shown] = shown
    out[np.setdiff1d(np.arange(256), shown)] = 256 + np.arange(256 - len(shown))
    out[10] = 10
    return out


ALPHABET = _alphabet()


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Words:
    """A tokenizer with a store of the words it has seen."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        first, model = rules["pre_tokenizer"] or {}, rules["model"]
        # anything but the byte-level rules gets whole texts
        self.splits = rules["normalizer"] is None and first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space") and model["type"] == "BPE"
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # the same merges for single pieces, one a line, in the byte-level alphabet
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = CharDelimiterSplit("\n")
        vocab = self.tokenizer.get_vocab()
        # a character of a byte-level token stands for one byte
        self.widths = np.zeros(max(vocab.values(), default=0) + 1, np.int64)
        self.widths[list(vocab.values())] = list(map(len, vocab))
        # words seen lately, and those before them
        self.known: dict[bytes, bytes] = {}
        self.aged: dict[bytes, bytes] = {}

    def _single(self, words: list[bytes]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    def _cut(self, ids: list[int], ends: np.ndarray) -> list[bytes]:
        """Ids of pieces that end at bytes ``ends``."""
        upto = np.cumsum(self.widths[ids])
        at = np.searchsorted(upto, ends)
        if int(upto[-1]) != int(ends[-1]) or (upto[at] != ends).any():
            raise ValueError("a token of the tokenizer spans words")
        data, at = np.array(ids, "<u4").tobytes(), (4 * at + 4).tolist()
        return [data[i:j] for i, j in zip([0, *at[:-1]], at, strict=True)]

    def _letters(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of letters, each a piece of its own to the tokenizer."""
        text = np.frombuffer(b"\n".join(words), np.uint8)
        ids = self.merges.encode_batch_fast([ALPHABET[text].tobytes().decode("utf-32-le")], add_special_tokens=False)[0].ids
        return self._cut(ids, np.cumsum(np.fromiter(map(len, words), np.int64, len(words))))

    def _lines(self, words: list[bytes]) -> list[bytes]:
        """Ids of words without blanks inside, encoded as lines of one text."""
        ids = self.tokenizer.encode_batch_fast([b"\n".join(words).decode() + "\n"], add_special_tokens=False)[0].ids
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(np.c_[sizes, np.ones(len(words), np.int64)].ravel())
        return self._cut(ids, ends)[::2]

    def _encode(self, words: list[bytes]) -> list[bytes]:
        out = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data, starts = np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes
        odd = ~LETTER[data]
        odd[1:] |= (data[:-1] == 0xC3) & SIGN[data[1:]]
        odd[starts[(data[starts] == 32) & (sizes > 1)]] = False
        letters = ~np.logical_or.reduceat(odd, starts) & self.splits if words else np.zeros(0, bool)
        others: tuple[list[int], list[int]] = ([], [])
        for i in np.flatnonzero(~letters).tolist():
            t = words[i].decode()
            others[not self.splits or not CLEAN.fullmatch(t) or any(x in t for x in self.special)].append(i)
        for chosen, run in ((np.flatnonzero(letters).tolist(), self._letters), (others[0], self._lines), (others[1], self._single)):
            for k in range(0, len(chosen), 20_000):
                part = chosen[k : k + 20_000]
                for i, ids in zip(part, run([words[i] for i in part]), strict=True):
                    out[i] = ids
        return out

    def _stored(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words, from the store if they were seen."""
        if len(self.known) > CACHE:
            self.known, self.aged = {}, self.known
        out = list(map(self.known.get, words))
        lost = [i for i, x in enumerate(out) if x is None]
        again = [words[i] for i in lost]
        found = list(map(self.aged.get, again))
        fresh = [w for w, x in zip(again, found, strict=True) if x is None]
        new = iter(self._encode(fresh))
        found = [next(new) if x is None else x for x in found]
        self.known.update(zip(again, found, strict=True))
        for i, x in zip(lost, found, strict=True):
            out[i] = x
        return out

    def _cuts(self, column: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Places where a word begins, and the end."""
        cut = np.zeros(len(data) + 1, bool)
        if self.splits and len(data) > 1:
            pair = data[:-1].astype(np.uint16)
            pair <<= 8
            pair |= data[1:]
            border = BORDERS.take(pair)
            cut[:-2] = border == 1
            last = offsets[1:][offsets[1:] > 0] - 1
            cut[last] = False
            cut[1:-1] |= border == 2
            line = np.flatnonzero(border == 3)
            line = line[line > 0]
            cut[line[border[line - 1] == 2] + 1] = True
            for x in self.special:
                for i in np.flatnonzero(pc.fill_null(pc.match_substring(column, x), False).to_numpy(zero_copy_only=False)):
                    cut[offsets[i] : offsets[i + 1]] = False
        cut[offsets] = True
        return np.flatnonzero(cut)

    def ids(self, column: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts, each text's followed by ``end``, and their number per text."""
        data, offsets = text_buffer(column)
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        at = self._cuts(column, data, offsets)
        words = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
        held = self._stored(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        # the end is one more word
        held.append(b"" if end is None else np.array(end, "<u4").tobytes())
        word = np.insert(words.indices.to_numpy().astype(np.int64), np.searchsorted(at, offsets[1:]), len(held) - 1)
        counts = np.fromiter(map(len, held), np.int64, len(held)) // 4
        starts, number = np.cumsum(counts) - counts, counts[word]
        before = np.cumsum(number) - number
        place = np.repeat(starts[word] - before, number)
        place += np.arange(len(place))
        ids = np.frombuffer(b"".join(held), "<u4")[place]
        upto = np.append(before, len(ids))[np.searchsorted(at, offsets) + np.arange(len(offsets))]
        return ids, np.diff(upto)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        ids, lengths = self.ids(pa.array(texts, pa.string()))
        return np.split(ids, np.cumsum(lengths)[:-1]) if texts else []


@lru_cache(2)
def words_of(path: str) -> Words:
    return Words(path)


def pack(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One file: magic, counts, document ids, whether they are known, lengths, coded blocks."""
    head = MAGIC + struct.pack("<QQ", len(lengths), len(ids))
    known = np.array([x is not None for x in doc_ids], np.uint8).tobytes()
    return head + np.array([x or 0 for x in doc_ids], "<i8").tobytes() + known + lengths.astype("<u4").tobytes() + coder.encode(ids)


def unpack(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, lengths and all ids of a file."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    n, total = struct.unpack_from("<QQ", data, 8)
    at = 24
    doc_ids = np.frombuffer(data, "<i8", n, at)
    known = np.frombuffer(data, np.uint8, n, at + 8 * n)
    lengths = np.frombuffer(data, "<u4", n, at + 9 * n).astype(np.int64)
    ids = coder.decode(data[at + 13 * n :])
    if len(ids) != total or lengths.sum() != total:
        raise ValueError("a token file is damaged")
    return [int(x) if k else None for x, k in zip(doc_ids, known, strict=True)], lengths, ids


def _write(path: str, end: int, file_ids: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part_id, serial = words_of(path), TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        held: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        size = 0

        def file():
            return pa.RecordBatch.from_arrays([pa.array([part_id], pa.int32()), pa.array([serial], pa.int32()), pa.array([len(doc_ids)], pa.int64()), pa.array([size], pa.int64()), pa.array([pack(doc_ids, np.concatenate(counts), np.concatenate(held))], pa.binary())], names=["part", "serial", "n_docs", "n_ids", "data"])

        for part in pieces(parts, 1):
            docs = part.column(0).to_pylist()
            ids, lengths = words.ids(part.column(1), end)
            ends, i = np.cumsum(lengths), 0
            while i < len(docs):
                done = int(ends[i] - lengths[i])
                # a file ends with the document that fills it
                j = min(len(docs), int(np.searchsorted(ends, done + file_ids - size)) + 1)
                doc_ids += docs[i:j]
                held.append(ids[done : int(ends[j - 1])])
                counts.append(lengths[i:j])
                size, i = size + len(held[-1]), j
                if size >= file_ids:
                    yield file()
                    doc_ids, held, counts, size, serial = [], [], [], 0, serial + 1
        if doc_ids:
            yield file()

    return run


def write_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end: int = END, file_ids: int = FILE_IDS) -> DataFrame:
    """Table of files (part, serial, n_docs, n_ids, data), written to the shared folder; (part, serial) is the documents' order."""
    keyed = row_keyed(docs, id_col, text_col)
    ordered = keyed.repartitionByRange("_k").sortWithinPartitions("_k").select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return stored(ordered.mapInArrow(_write(path or tokenizer_path(), end, file_ids), "part int, serial int, n_docs long, n_ids long, data binary"))


def export_files(files: DataFrame, folder: str) -> None:
    """Every file as one of its own below a folder that all executors see."""

    def put(rows) -> None:
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            name = os.path.join(folder, f"tokens-{r.part:05d}-{r.serial:05d}.bin")
            with open(f"{name}.{os.getpid()}", "wb") as f:
                f.write(r.data)
            os.replace(f.name, name)

    files.select("part", "serial", "data").foreachPartition(put)


def _read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for data, start in zip(part.column(0), part.column(1).to_pylist(), strict=True):
            doc_ids, lengths, ids = unpack(data.as_py())
            ends = np.cumsum(lengths)
            crc = [zlib.crc32(ids[a:b]) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
            for i in range(0, len(ends), 20_000):
                j = min(len(ends), i + 20_000)
                lo = int(ends[i] - lengths[i])
                offsets = np.r_[0, ends[i:j] - lo].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids[lo : int(ends[j - 1])].view(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids[i:j], pa.int64()), pa.array(start + ends[i:j] - lengths[i:j]), pa.array(lengths[i:j]), pa.array(crc[i:j], pa.int64()), lists], names=["id", "start", "n_tokens", "ids_crc32", "ids"])


def read_tokens(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32, ids) of every document of the files."""
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select(F.col("part").alias("_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = W.partitionBy("part").orderBy("serial").rowsBetween(W.unboundedPreceding, -1)
    own = files.select(F.col("part").alias("_p"), F.col("serial").alias("_s"), F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("inner"))
    starts = own.join(parts, F.col("_p") == F.col("_part")).select("_p", "_s", (F.col("before") + F.col("inner")).alias("start"))
    # a row per file, so the files themselves stay where they are
    placed = files.join(F.broadcast(starts), (F.col("part") == F.col("_p")) & (F.col("serial") == F.col("_s"))).select("data", "start")
    return placed.mapInArrow(_read, "id long, start long, n_tokens long, ids_crc32 long, ids array<int>").withColumnRenamed("id", id_col)


def op6_token_files(spark: SparkSession, sf: str) -> DataFrame:
    return read_tokens(write_tokens(table(spark, sf, "documents"))).select("doc_id", "start", "n_tokens", "ids_crc32")
