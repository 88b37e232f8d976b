"""Articles in XML: their parts as columns."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

_SECTION = S.StructType([S.StructField("section", S.StringType()), S.StructField("text", S.StringType())])
ARTICLE = S.StructType([S.StructField("title", S.StringType()), S.StructField("abstract", S.StringType()), S.StructField("sections", S.ArrayType(_SECTION))])


def _words(node: ET.Element | None) -> str:
    return re.sub(r"\s+", " ", " ".join(node.itertext())).strip() if node is not None else ""


def parts_of(xml: str | None) -> dict | None:
    """Title, abstract and titled sections of one article; a body without sections is one named Body. Null where it isn't XML."""
    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError:
        return None
    body = root.find(".//body")
    found = [{"section": _words(s.find("title")) or "Body", "text": " ".join(filter(None, (_words(p) for p in s.iter("p"))))} for s in (body.findall("sec") if body is not None else [])]
    if body is not None and not found:
        found = [{"section": "Body", "text": _words(body)}]
    return {"title": _words(root.find(".//article-title")), "abstract": _words(root.find(".//abstract")), "sections": [s for s in found if s["text"]]}


@F.pandas_udf(ARTICLE)
def article_parts(xml: pd.Series) -> pd.DataFrame:
    rows = [parts_of(x) or {"title": None, "abstract": None, "sections": None} for x in xml]
    return pd.DataFrame(rows, columns=["title", "abstract", "sections"])


_LISTS = ("authors", "mesh_terms")
_FIELDS = ("pmid", "pmcid", "doi", "title", "abstract", "journal", "publication_year", *_LISTS)
RECORD = S.StructType([*(S.StructField(c, S.ArrayType(S.StringType()) if c in _LISTS else S.StringType()) for c in _FIELDS), S.StructField("has_fulltext", S.BooleanType())])


def record_of(xml: str | None) -> dict | None:
    """One catalogued article: ids, names of authors (or of a group), distinct subject headings. Null where it isn't XML.

    Of several DOIs or PMC ids the first that isn't empty counts; a PMC id without its prefix gets it.
    """
    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError:
        return None
    said = lambda node, path: _words(node.find(path))
    names = [said(a, "CollectiveName") or " ".join(filter(None, (said(a, "ForeName"), said(a, "LastName")))) for a in root.findall(".//AuthorList/Author")]
    ids = {}
    for node in root.findall(".//PubmedData/ArticleIdList/ArticleId"):
        if value := _words(node):
            ids.setdefault(node.get("IdType"), value)
    pmc = ids.get("pmc")
    return {
        "pmid": said(root, ".//MedlineCitation/PMID"), "pmcid": pmc and (pmc if pmc.upper().startswith("PMC") else f"PMC{pmc}"), "doi": ids.get("doi"), "title": said(root, ".//ArticleTitle"),
        "abstract": "\n".join(filter(None, map(_words, root.findall(".//Abstract/AbstractText")))), "journal": said(root, ".//Journal/Title"),
        "publication_year": said(root, ".//PubDate/Year") or said(root, ".//PubDate/MedlineDate"), "authors": [n for n in names if n],
        "mesh_terms": list(dict.fromkeys(filter(None, map(_words, root.findall(".//MeshHeadingList/MeshHeading/DescriptorName"))))), "has_fulltext": bool(pmc),
    }


@F.pandas_udf(RECORD)
def article_record(xml: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([record_of(x) or dict.fromkeys(RECORD.names) for x in xml], columns=RECORD.names)


def article_records(spark: SparkSession, path: str) -> DataFrame:
    """A row for each article of catalogue files of any size: they are cut at the articles' end tags by the reader, so that a file is read by many tasks.

    Articles that don't parse have no row.
    """
    end = "</PubmedArticle>"
    pieces = spark.read.option("lineSep", end).text(path).select(F.regexp_extract("value", r"(?s)<PubmedArticle[\s>].*$", 0).alias("xml")).filter("xml <> ''")
    return pieces.select(article_record(F.concat("xml", F.lit(end))).alias("r")).select("r.*").filter("pmid IS NOT NULL")


def articles(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: its path, title, abstract and sections; files that don't parse have nulls."""
    files = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_name").alias("name"), article_parts("value").alias("a"))
    return files.select("name", "a.*")


def chunk_sections(rows: DataFrame, key: str, words: int = 250, overlap: int = 40) -> DataFrame:
    """Word windows of every section; a section without text keeps its number."""
    from factloom.functions.text import word_windows

    each = rows.select(F.col(key).alias("doc_id"), F.posexplode("sections").alias("sec", "s"))
    windows = each.select("doc_id", "sec", F.col("s.section").alias("section"), F.inline(word_windows("s.text", words, overlap)))
    return windows.select("doc_id", F.format_string("%s::chunk_%02d_%04d", F.col("doc_id").cast("string"), "sec", "k").alias("chunk_id"), "section", "text", F.col("start").alias("start_offset"), F.col("end").alias("end_offset"))
