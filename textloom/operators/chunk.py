"""Cutting texts to chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions.text import space_tokens

SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def word_windows(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """doc_id, chunk_no, start, chunk: windows of `size` words, each starting size - overlap after the last.

    Once a window reaches the end, ever shorter ones follow from `overlap` words before the end on.
    """
    step = max(size - overlap, 1)
    words = docs.select("doc_id", space_tokens(F.col("text")).alias("words")).where(F.size("words") > 0)
    n = F.size("words")
    last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / step) * step).cast("int")
    tail = F.greatest(last + 1, n - overlap)
    none = F.array().cast("array<int>")
    starts = F.concat(
        F.sequence(F.lit(0), last, F.lit(step)), F.when(tail <= n - 1, F.sequence(tail, n - 1)).otherwise(none)
    )
    cut = words.select("doc_id", "words", F.posexplode(starts).alias("chunk_no", "start"))
    chunk = F.array_join(F.slice("words", F.col("start") + 1, F.lit(size)), " ")
    return cut.select("doc_id", "chunk_no", "start", chunk.alias("chunk"))


def pieces(text: str, separator: str) -> list[str]:
    """The text cut before each separator, which stays at the start of what follows it."""
    if not separator:
        return list(text)
    first, *rest = text.split(separator)
    return [p for p in (first, *(separator + r for r in rest)) if p]


def packed(parts: list[str], size: int, overlap: int) -> Iterator[str]:
    """Chunks of consecutive parts of at most `size` characters, sharing up to `overlap` with the one before."""
    window: list[str] = []
    total = 0
    for part in parts:
        if total + len(part) > size and window:
            yield "".join(window)
            while total > overlap or (total and total + len(part) > size):
                total -= len(window.pop(0))
        window.append(part)
        total += len(part)
    if window:
        yield "".join(window)


def recursive(text: str, size: int = fixed.CHUNK_SIZE, overlap: int = fixed.CHUNK_OVERLAP, separators=SEPARATORS) -> list[str]:
    """Chunks cut at the coarsest separator that the text has; parts that stay too long are cut at finer ones."""
    use = next((k for k, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    out: list[str] = []
    short: list[str] = []

    def flush() -> None:
        out.extend(c for c in map(str.strip, packed(short, size, overlap)) if c)
        short.clear()

    for part in pieces(text, separators[use]):
        if len(part) < size:
            short.append(part)
            continue
        flush()
        finer = separators[use + 1 :]
        out.extend(recursive(part, size, overlap, finer) if finer else [part])
    flush()
    return out


_HEADER = re.compile("(" + "|".join(map(re.escape, sorted(fixed.SECTION_HEADERS, key=len, reverse=True))) + r")\s")


def sections(text: str) -> list[tuple[str, str]]:
    """(header, body) of every section; what stands before the first header is left out.

    A header stands at a line's start and white space follows it on the line.
    """
    found: list[tuple[str, list[str]]] = []
    for line in text.split("\n"):
        header = _HEADER.match(line)
        if header:
            found.append((header[1], [line[len(header[1]) :].strip()]))
        elif found:
            found[-1][1].append(line)
    return [(header, "\n".join(lines).strip()) for header, lines in found]


def by_sections(text: str, size: int = fixed.CHUNK_SIZE, overlap: int = fixed.CHUNK_OVERLAP) -> list[tuple[str, list[str], bool]]:
    """(chunk, headers in it, whether cut by sections). Neighbouring sections share a chunk while they fit in
    `size` together; texts with fewer than two sections are cut recursively."""
    found = sections(text)
    if len(found) < 2:
        return [(c, [], False) for c in recursive(text, size, overlap)]
    groups: list[list[tuple[str, str]]] = []
    room = -1
    for header, body in found:
        need = len(f"{header}\n{body}")
        if need > room:
            groups.append([])
            room = size
        groups[-1].append((header, body))
        room -= need
    return [("\n\n".join(f"{h}\n{b}" for h, b in g), [h.rstrip(":") for h, _ in g], True) for g in groups]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _recursive(texts: pd.Series, sizes: pd.Series, overlaps: pd.Series) -> pd.Series:
    return pd.Series([recursive(t or "", s, o) for t, s, o in zip(texts, sizes, overlaps, strict=True)])


_CHUNKS = T.ArrayType(
    T.StructType(
        [
            T.StructField("chunk", T.StringType()),
            T.StructField("headers", T.ArrayType(T.StringType())),
            T.StructField("by_sections", T.BooleanType()),
        ]
    )
)


@F.pandas_udf(_CHUNKS)
def _by_sections(texts: pd.Series) -> pd.Series:
    return pd.Series([[{"chunk": c, "headers": h, "by_sections": s} for c, h, s in by_sections(t or "")] for t in texts])


def recursive_chunks(docs: DataFrame, size: Column | int = fixed.CHUNK_SIZE, overlap: Column | int = fixed.CHUNK_OVERLAP) -> DataFrame:
    """doc_id, chunk_no, chunk."""
    cut = _recursive(F.col("text"), F.lit(size), F.lit(overlap))
    return docs.select("doc_id", F.posexplode(cut).alias("chunk_no", "chunk"))


def section_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, chunk_no, chunk, headers, by_sections."""
    cut = docs.select("doc_id", F.posexplode(_by_sections(F.col("text"))).alias("chunk_no", "c"))
    return cut.select("doc_id", "chunk_no", "c.*")
