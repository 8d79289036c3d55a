"""Secret scans with linking of multipart credentials.

Three strong kinds of spans count on their own: assigned values, access ids and
hexadecimal runs. Weak candidates say little alone: an account name, a token
without a keyword, a short password, a host. They are reported only where the
parts of one credential meet. A part's scope is its block of text (blocks end at
blank lines) within ``REACH`` code points; an identifier needs a secret in its
scope, a secret an identifier, an endpoint both.

Tasks scan texts and give one row per part. The interval join of parts and
scopes runs as a range frame over a text's parts in order, so each part meets
the kinds that co-occur with it and no pairs are made. A frame holds the parts
of a few hundred code points.

Defined cases: null and empty texts have no parts and their row; rows with equal
or null ids are documents each; spans are half-open and count code points; of a
weak candidate that meets a strong span the strong one stays; other columns are
not read; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from lexmill.llm.common import pieces, row_keyed, table

REACH = 300
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")

_GLUE = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = re.compile(r"[PpSsTtAa](?:(?<=[Pp])(?i:assw(?:or)?d)|(?<=[Ss])(?i:ecret)|(?<=[Tt])(?i:oken)|(?<=[Aa])(?i:pi_?key))" + _GLUE + r"([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so shorter ones fail as a whole

_IDENTIFIER = re.compile(r"[AaCcUuLl](?:(?<=[Aa])(?i:ccess_?(?:key_?)?id|ccount(?:_?(?:name|id))?|pp_?id)|(?<=[Cc])(?i:lient_?id)|(?<=[Uu])(?i:ser(?:_?(?:name|id))?)|(?<=[Ll])(?i:ogin))" + _GLUE + r"([A-Za-z0-9_.@+-]{3,})", re.ASCII)
_SHORT = re.compile(r"[PpSsAa](?:(?<=[Pp])(?i:ass(?:w(?:or)?d|phrase)?|wd|rivate_?key)|(?<=[Ss])(?i:ecret)|(?<=[Aa])(?i:uth(?:orization)?|pi_?key))" + _GLUE + r"([^\s\"']{4,})", re.ASCII)
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
_ADDRESS = re.compile(r"://[^\s\"'<>]+")
_SCHEME = re.compile(r"[a-z][a-z0-9+.-]{1,15}\Z")
_HOST = re.compile(r"[HhEeSs](?:(?<=[Hh])(?i:ost(?:name)?)|(?<=[Ee])(?i:ndpoint)|(?<=[Ss])(?i:erver))" + _GLUE + r"([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]+)?)", re.ASCII)
_BLANK_LINE = re.compile(r"\n[^\S\n]*\n")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the strong spans."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def _mixed(token: str) -> bool:
    return any(c.isdigit() for c in token) and token.lower() != token and token.upper() != token


def weak_spans(text: str, strong: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of parts that need company; none meets a strong span."""
    found = [(m.start(), 3, m.end()) for m in _IDENTIFIER.finditer(text)]
    found += [(m.start(), 4, m.end()) for m in _SHORT.finditer(text)]
    places = [(scheme.start(), 5, m.end()) for m in _ADDRESS.finditer(text) if (scheme := _SCHEME.search(text, max(0, m.start() - 16), m.start()))]
    places += [(m.start(), 5, m.end()) for m in _HOST.finditer(text)]
    taken = sorted((s, e) for s, _, e in strong)
    found = _clear(found + places, taken)
    named = sorted(taken + [(s, e) for s, _, e in found])
    tokens = [(m.start(), 4, m.end()) for m in _TOKEN.finditer(text) if _mixed(m.group())]
    return found + _clear(tokens, named)


def _clear(spans: list[tuple[int, int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Spans that meet none of the taken ones, which are in order."""
    starts: list[int] = []
    ends: list[int] = []
    for s, e in taken:
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return [(s, kind, e) for s, kind, e in spans if not (i := bisect_left(starts, e)) or ends[i - 1] <= s]


def _scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in pieces(parts, 2, 1 << 22):
        rows: list[tuple] = []
        for k, doc, text in zip(*[c.to_pylist() for c in part.columns], strict=True):
            strong = base_spans(text) if text else []
            spans = sorted(strong + weak_spans(text, strong)) if text else []
            if not spans:
                rows.append((k, doc, 0, None, None, None))
                continue
            scope, breaks = 0, _BLANK_LINE.finditer(text)
            edge = next(breaks, None)
            for start, kind, end in spans:
                while edge is not None and edge.start() < start:
                    scope, edge = scope + 1, next(breaks, None)
                rows.append((k, doc, scope, start, kind, end))
            if len(rows) > 100_000:
                yield _rows(rows)
                rows = []
        if rows:
            yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["k", "id", "scope", "start", "kind", "end"])


def linked_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """Rows (k, id, scope, start, kind, end, reported) of every part; a text without parts has one row of nulls."""
    keyed = row_keyed(docs, id_col, text_col)
    parts = keyed.select("_k", F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_scan, "k long, id long, scope int, start int, kind int, end int").repartition("k")
    near = W.partitionBy("k", "scope").orderBy("start").rangeBetween(-reach, reach)
    has = lambda *kinds: F.coalesce(F.max(F.col("kind").isin(*kinds)).over(near), F.lit(False))
    parts = parts.withColumns({"_id": has(1, 3), "_secret": has(0, 2, 4)})
    met = (F.col("kind") < 3) | ((F.col("kind") == 3) & F.col("_secret")) | ((F.col("kind") == 4) & F.col("_id")) | ((F.col("kind") == 5) & F.col("_id") & F.col("_secret"))
    return parts.withColumn("reported", F.coalesce(met, F.lit(False))).drop("_id", "_secret")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """One row per document: counts of the strong kinds, digest of their spans, all reported spans, counts of linked parts."""
    parts = linked_parts(docs, id_col, text_col, reach)
    names = F.array(*[F.lit(k) for k in KINDS])

    def listed(when):
        spans = F.array_sort(F.collect_list(F.when(when, F.struct("start", "kind", "end"))))
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    count = lambda kind: F.count(F.when(F.col("reported") & (F.col("kind") == KINDS.index(kind)), 1))
    out = parts.groupBy("k").agg(
        F.first("id").alias(id_col), *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(listed(F.col("kind") < 3).cast("binary"), 256).alias("base_sha256"), listed(F.col("reported")).alias("spans"))
    return out.drop("k")


def op13_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan(table(spark, sf, "documents"))
