"""SentencePiece encoding and decoding with a batched numpy Viterbi.

A text gets the dummy blank in front, blanks become ``▁``, and the pieces of
greatest total score that spell it are its tokens; among equal totals the one
whose last piece is longest, then the one before, and so on. Characters that no
piece covers cost more than any piece and are given as byte pieces. No piece of the model
has ``▁`` after another character, so a text falls apart into words that are
solved alone.

Distinct words of a batch are solved together, words of equal length at once:
polynomial hashes of all substrings that end at one place probe the sorted hashes
of the pieces, and vectorised maxima keep scores and backpointers. Every match is
then compared with its piece, so a collision cannot pass. Scores are the model
file's, taken as they are; a file trained for merges gives merge ranks here.

Defined cases: null text has no tokens and decodes to null; a literal ``▁`` reads
back as a blank, as in the format itself; empty text has no tokens
and decodes to the empty string; very long words are solved in pieces of memory
bounded by their length; unknown ids are an error of the caller.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmill.llm.common import U, pieces as text_pieces, spread, table

MODEL = "piece_bpe_32k.model"
BLANK = "▁"
BASE = 0x9E3779B97F4A7C15
CACHE = 400_000
GROUP_CELLS = 1 << 20


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """The normal pieces of a model: sorted hashes per length, ids, scores."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.byte = {}
        normal = []
        for i, p in enumerate(self.text):
            if sp.is_byte(i):
                self.byte[int(p[1:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) and p:
                normal.append(i)
        if len(self.byte) < 256:
            raise ValueError("the model has no byte pieces")
        if any(BLANK in self.text[i].lstrip(BLANK) for i in normal):
            raise ValueError("a piece crosses a word")
        self.longest = max(len(self.text[i]) for i in normal)
        self.unknown = min(sp.get_score(i) for i in normal) - 10.0
        self.tables = {}
        for n in range(1, self.longest + 1):
            own = [i for i in normal if len(self.text[i]) == n]
            if own:
                codes = np.array([[ord(c) for c in self.text[i]] for i in own], np.uint32)
                h = self.hash(codes)
                by = np.argsort(h)
                self.tables[n] = (h[by], np.array(own, np.int64)[by], np.array([sp.get_score(i) for i in own], np.float64)[by], codes[by])
        self.known: dict[str, bytes] = {}

    @staticmethod
    def hash(codes: np.ndarray) -> np.ndarray:
        h = np.zeros(len(codes), U)
        for j in range(codes.shape[1]):
            h = h * U(BASE) + codes[:, j].astype(U) + U(1)
        return h

    def solve(self, words: list[str]) -> list[np.ndarray]:
        """Tokens of words of one length, all advanced together."""
        n, m = len(words[0]), len(words)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(m, n)
        prefix = np.zeros((m, n + 1), U)
        for j in range(n):
            prefix[:, j + 1] = prefix[:, j] * U(BASE) + codes[:, j].astype(U) + U(1)
        best = np.full((m, n + 1), -np.inf)
        best[:, 0] = 0
        size = np.zeros((m, n + 1), np.int32)
        token = np.full((m, n + 1), -1, np.int64)
        rows = np.arange(m)
        for end in range(1, n + 1):
            top, step, piece = best[:, end - 1] + self.unknown, np.ones(m, np.int32), np.full(m, -1, np.int64)
            for width in range(1, min(end, self.longest) + 1):
                if width not in self.tables:
                    continue
                keys, ids, scores, spelled = self.tables[width]
                h = prefix[:, end] - prefix[:, end - width] * U(pow(BASE, width, 1 << 64))
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = np.flatnonzero(keys[at] == h)
                if not len(hit):
                    continue
                hit = hit[(spelled[at[hit]] == codes[hit, end - width : end]).all(1)]
                total = best[hit, end - width] + scores[at[hit]]
                better = total >= top[hit]
                hit, total = hit[better], total[better]
                top[hit], step[hit], piece[hit] = total, width, ids[at[hit]]
            best[:, end], size[:, end], token[:, end] = top, step, piece
        out: list[list[int]] = [[] for _ in range(m)]
        at = np.full(m, n)
        while (live := rows[at > 0]).size:
            for r, e, t in zip(live.tolist(), at[live].tolist(), token[live, at[live]].tolist(), strict=True):
                out[r].extend([t] if t >= 0 else [self.byte[b] for b in reversed(words[r][e - 1].encode("utf-8", "surrogatepass"))])
            at[live] -= size[live, at[live]]
        return [np.array(x[::-1], np.int32) for x in out]

    def learn(self, words: set[str]) -> None:
        """Solve words not yet known, by length; the store is emptied when full."""
        fresh = [w for w in words if w not in self.known]
        if len(self.known) + len(fresh) > CACHE:
            self.known.clear()
            fresh = list(words)
        by_length: dict[int, list[str]] = {}
        for w in fresh:
            by_length.setdefault(len(w), []).append(w)
        for n, group in by_length.items():
            step = max(1, GROUP_CELLS // (n + 1))
            for i in range(0, len(group), step):
                for w, ids in zip(group[i : i + step], self.solve(group[i : i + step]), strict=True):
                    self.known[w] = ids.tobytes()

    def words(self, text: str) -> list[str]:
        """Words of a text; blanks before a word belong to it."""
        parts = (BLANK + text.replace(" ", BLANK)).split(BLANK)
        # "▁▁a▁b▁" splits to "", "", "a", "b", "": every empty part lends its blank to the next one
        out, blanks = [], 1
        for p in parts[1:]:
            if p:
                out.append(BLANK * blanks + p)
                blanks = 1
            else:
                blanks += 1
        if blanks > 1:
            out.append(BLANK * (blanks - 1))
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [self.words(t) if t else [] for t in texts]
        self.learn({w for ws in split for w in ws})
        return [np.frombuffer(b"".join(map(self.known.__getitem__, ws)), np.int32) for ws in split]

    def decode(self, ids: np.ndarray) -> str:
        """The text again: pieces joined, byte pieces read as UTF-8, the dummy blank taken off."""
        if not len(ids):
            return ""
        table_ = self._bytes()
        whole = b"".join([table_[i] for i in ids.tolist()]).decode("utf-8", "surrogatepass")
        return whole[1:] if whole.startswith(" ") else whole

    def _bytes(self) -> list[bytes]:
        if not hasattr(self, "_table"):
            back = {i: bytes([b]) for b, i in self.byte.items()}
            self._table = [back.get(i) or p.replace(BLANK, " ").encode() for i, p in enumerate(self.text)]
        return self._table


@lru_cache(2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def _encode(path: str, check: bool):
    """Rows (key columns, text) to rows (key columns, ids, n_tokens, crc, decoded)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces_of(path)
        for part in text_pieces(parts, 1, 1 << 21):
            texts = part.column(1).to_pylist()
            ids = model.encode(texts)
            ends = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            null = np.array([t is None for t in texts], bool)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()), mask=pa.array(null))
            same = [t is None or model.decode(x) == t for t, x in zip(texts, ids, strict=True)] if check else [None] * len(texts)
            crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
            yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array([len(x) for x in ids], pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], names=["id", "ids", "n_tokens", "ids_crc32", "round_trip"])

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, check: bool = True) -> DataFrame:
    """(id, ids, n_tokens, ids_crc32, round_trip): tokens of every text, and whether they decode to it."""
    kind = dict(docs.dtypes)[id_col]
    source = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    out = source.mapInArrow(_encode(path or model_path(), check), f"id {kind}, ids array<int>, n_tokens long, ids_crc32 long, round_trip boolean")
    return out.withColumnRenamed("id", id_col)


def _decode(path: str):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces_of(path)
        for part in parts:
            texts = [None if x is None else model.decode(np.array(x, np.int32)) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return run


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id, text) of token lists."""
    kind = dict(tokens.dtypes)[id_col]
    out = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(_decode(path or model_path()), f"id {kind}, text string")
    return out.withColumnRenamed("id", id_col)


def op4_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    return encode(table(spark, sf, "documents")).select("doc_id", "n_tokens", "ids_crc32", "round_trip")
