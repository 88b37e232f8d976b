"""What built-in functions can't express: cursors, trees and greedy choices, as small functions behind Arrow UDFs and table functions."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S


def blocks(text: str, size: int = 10000, overlap: int = 200) -> list[str]:
    """Blocks of at most ``size`` characters that end at a paragraph or sentence where the last nine tenths have one."""
    text, out, start = (text or "").strip(), [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            cut = max(text.rfind(mark, start + size // 10, end) for mark in ("\n\n", ". ", "? ", "! "))
            if cut > 0:
                end = cut + (1 if text[cut] in ".?!" else 2)
        if block := text[start:end].strip():
            out.append(block)
        if end >= len(text):
            break
        start = max(end - overlap, start + 1)
    return out


@F.pandas_udf(S.ArrayType(S.StringType()))
def text_blocks(text: pd.Series) -> pd.Series:
    return text.map(blocks)


def first_json(text: str) -> str | None:
    """The first complete JSON object or array in a text, as text; null where there is none."""
    decoder = json.JSONDecoder()
    for i, c in enumerate(text or ""):
        if c in "{[":
            try:
                return json.dumps(decoder.raw_decode(text, i)[0], ensure_ascii=False)
            except ValueError:
                continue
    return None


@F.pandas_udf(S.StringType())
def embedded_json(text: pd.Series) -> pd.Series:
    return text.map(first_json)


def functions_of(source: str) -> list[tuple[str, int, int, str]]:
    """(name, first line, last line, docstring) of the functions at a module's top; none where it doesn't parse."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError):
        return []
    return [(n.name, n.lineno, n.end_lineno or n.lineno, ast.get_docstring(n) or "") for n in tree.body if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)]


_FUNCTION = S.StructType([S.StructField("name", S.StringType()), S.StructField("first_line", S.IntegerType()), S.StructField("last_line", S.IntegerType()), S.StructField("doc", S.StringType())])


@F.udtf(returnType=_FUNCTION)
class ModuleFunctions:
    def eval(self, source: str):
        yield from functions_of(source)


def diverse(rows: DataFrame, key: str, words: int = 500, likeness: float = 0.85) -> DataFrame:
    """Of each claim's candidates (key, id, text, similarity, vector) the most similar that differ from each other, within a number of words.

    A claim's candidates are the blocks of the few pages fetched for it.
    """

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf, taken, left = pdf.sort_values(["similarity", "id"], ascending=[False, True]), [], words
        vectors: list = []
        for row in pdf.itertuples():
            v = np.asarray(row.vector, dtype=float)
            v = v / max(float(np.linalg.norm(v)), 1e-12)
            if any(float(v @ u) > likeness for u in vectors):
                continue
            tokens = row.text.split()
            if len(tokens) > left:
                if left > 10:
                    taken.append((getattr(row, key), row.id, " ".join(tokens[:left]) + "..."))
                break
            taken.append((getattr(row, key), row.id, row.text))
            vectors.append(v)
            left -= len(tokens)
        return pd.DataFrame(taken, columns=[key, "id", "text"])

    kinds = dict(rows.dtypes)
    return rows.groupBy(key).applyInPandas(choose, f"{key} {kinds[key]}, id {kinds['id']}, text string")


def spliced(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced, from the last to the first; of spans that overlap the first holds."""
    out, limit, kept = text, 0, []
    for start, end, new in sorted(spans, key=lambda s: (s[0], -s[1])):
        if start >= limit and end <= len(text):
            kept.append((start, end, new))
            limit = end
    for start, end, new in reversed(kept):
        out = out[:start] + new + out[end:]
    return out


@F.pandas_udf(S.StringType())
def splice(text: pd.Series, spans: pd.Series) -> pd.Series:
    """``spans``: arrays of structs (start, end, text)."""
    return pd.Series([spliced(t or "", [(s["start"], s["end"], s["text"]) for s in (x if x is not None else [])]) for t, x in zip(text, spans, strict=True)])
