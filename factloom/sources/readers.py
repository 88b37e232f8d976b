"""Readers and writers. Every reader declares or derives its schema without a pass over the data where it can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TRIPLE = (
    "doc_id string, chunk_id string, head string, head_type string, surface_relation string, normalized_relation string, "
    "tail string, tail_type string, confidence double, evidence string, source string, meta string"
)
CHUNK = "doc_id string, chunk_id string, title string, section string, text string, start_offset int, end_offset int"


def jsonl(spark: SparkSession, path: str, schema: StructType | str, tolerant: bool = False) -> DataFrame:
    """One object a line. A bad line fails the read, or is left out when ``tolerant``; unknown fields are not read."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def jsonl_or_empty(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """As ``jsonl``; a path that doesn't exist gives no rows."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    return jsonl(spark, path, schema) if found else spark.createDataFrame([], schema)


def json_document(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def triples(spark: SparkSession, path: str) -> DataFrame:
    """The known fields of triples, empty for missing, with ``seq`` from the rows' place in their files."""
    rows = jsonl(spark, path, TRIPLE)
    texts = {c: F.coalesce(c, F.lit("")) for c, kind in rows.dtypes if kind == "string" and c != "meta"}
    return rows.select("*", F.monotonically_increasing_id().alias("seq")).withColumns(texts | {"confidence": F.coalesce("confidence", F.lit(0.0))})


def table(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, or TSV by its suffix; all columns as text."""
    return spark.read.option("header", True).option("sep", "\t" if path.endswith(".tsv") else ",").option("multiLine", True).option("escape", '"').csv(path)


def choice_csv(spark: SparkSession, path: str, dataset: str, split: str = "test") -> DataFrame:
    """Questions with columns ``option N``; the answer is the text of the option it names."""
    rows = table(spark, path)
    options = sorted(c for c in rows.columns if c.lower().startswith("option "))
    by_name = F.map_from_arrays(F.array(*(F.lit(c.lower()) for c in options)), F.array(*(F.col(f"`{c}`") for c in options)))
    answer = F.try_element_at(by_name, F.concat(F.lit("option "), F.lower(F.trim("answer"))))
    return _items(rows.withColumn("_answer", F.coalesce(answer, F.col("answer"))), dataset, split, "question", "_answer")


def parquet_shards(spark: SparkSession, path: str, dataset: str, split: str = "train") -> DataFrame:
    """Question and answer of sharded Parquet; only these two columns are read."""
    rows = spark.read.parquet(path).select("question", "answer", F.col("_metadata.file_name").alias("shard"), F.col("_metadata.row_index").alias("row"))
    return _items(rows, dataset, split, "question", "answer", F.concat_ws(":", "shard", "row"))


def options_jsonl(spark: SparkSession, path: str, dataset: str, split: str = "test") -> DataFrame:
    """Questions with a map of options; the answer is the option that its label names, the image the first."""
    rows = jsonl(spark, path, "id string, question string, options map<string,string>, label string, images array<string>")
    answer = F.coalesce(F.try_element_at("options", F.col("label")), F.col("label"))
    return _items(rows.withColumn("_answer", answer), dataset, split, "question", "_answer", F.col("id"), F.get("images", F.lit(0)))


def language_json(spark: SparkSession, path: str, dataset: str, split: str = "test", language: str = "en") -> DataFrame:
    """A JSON array of questions in one language, or in none."""
    rows = json_document(spark, path, "qid string, question string, answer string, q_lang string, img_name string")
    return _items(rows.filter(F.lower(F.coalesce("q_lang", F.lit(""))).isin("", language)), dataset, split, "question", "answer", F.col("qid"), F.col("img_name"))


def choice_tsv(spark: SparkSession, path: str, dataset: str, split: str = "test") -> DataFrame:
    """Questions of a TSV table; columns that hold images are not kept."""
    rows = table(spark, path)
    return _items(rows.drop("image"), dataset, split, "question", "answer", F.col("index") if "index" in rows.columns else None)


def _items(rows: DataFrame, dataset: str, split: str, question: str, answer: str, key=None, image=None) -> DataFrame:
    images = [] if image is None else [image.alias("image")]
    return rows.select(
        F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), (F.monotonically_increasing_id() if key is None else key).cast("string").alias("question_id"),
        F.coalesce(question, F.lit("")).alias("question"), F.coalesce(answer, F.lit("")).alias("answer"), *images,
    )


#: Readers by the kind of their files.
READERS: dict[str, Callable[..., DataFrame]] = {"choice_csv": choice_csv, "parquet": parquet_shards, "options_jsonl": options_jsonl, "language_json": language_json, "choice_tsv": choice_tsv}


def read(spark: SparkSession, kind: str, path: str, dataset: str, **options) -> DataFrame:
    if kind not in READERS:
        raise ValueError(f"unknown reader {kind!r}; there are {', '.join(sorted(READERS))}")
    return READERS[kind](spark, path, dataset, **options)


def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes (id, data) and edges (head, tail, data) of a GraphML file, data as maps by key."""
    data = "array<struct<_key:string,_VALUE:string>>"
    as_map = F.map_from_entries(F.coalesce("data", F.array().cast(data)))
    reader = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    nodes = reader("node", f"_id string, data {data}").select(F.col("_id").alias("id"), as_map.alias("data"))
    edges = reader("edge", f"_source string, _target string, data {data}").select(F.col("_source").alias("head"), F.col("_target").alias("tail"), as_map.alias("data"))
    return nodes, edges


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Fixed columns; missing ones and nulls as empty."""
    df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns)).write.option("header", True).csv(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph as two Parquet tables, edges by relation."""
    nodes.write.parquet(f"{path}/nodes")
    edges.write.partitionBy("normalized_relation").parquet(f"{path}/edges")


def append_numbered(df: DataFrame, order: str, existing: int, prefix: str = "qg_") -> DataFrame:
    """Rows with ids that go on from ``existing``."""
    from factloom.plans.ranks import running_total

    return running_total(df.withColumn("_one", F.lit(1)), order, "_one", "_n").withColumn("sample_id", F.format_string(f"{prefix}%06d", F.col("_n") + existing + 1)).drop("_one", "_n")
