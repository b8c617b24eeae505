"""File sources and sinks: entry files, vector matrices with sidecars, spreadsheets, collections, reports."""

from __future__ import annotations

import io
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .sheets import read_workbook, rows_of


def parse_entries(lines: DataFrame, value: str = "value") -> DataFrame:
    """``(id, text)`` of tab-separated lines with at least two parts; further parts are joined by blanks."""
    parts = F.split(F.trim(F.regexp_replace(F.col(value), r"^\s+|\s+$", "")), "\t")
    return lines.select(parts.alias("p")).filter(F.size("p") > 1).select(
        F.col("p")[0].alias("id"), F.array_join(F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0))), " ").alias("text")
    )


def read_entries(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Entries of a text file, one a line.

    ``limit`` counts lines, also those that are no entry; the first lines are
    those of the file, so a limited read is of one file. Of a workbook the
    column ``question`` is read, with ids ``question_0`` and so on in row order.
    """
    if path.endswith(".xlsx"):
        rows = index_rows(read_workbook(spark, path, "question string").withColumn("_at", F.monotonically_increasing_id()), ["_at"], "i")
        rows = rows.filter(F.col("i") < limit) if limit is not None else rows
        return rows.select(F.concat(F.lit("question_"), F.col("i").cast("string")).alias("id"), F.col("question").alias("text"))
    lines = spark.read.text(path)
    return parse_entries(lines if limit is None else lines.limit(limit))


def read_sheet(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A question sheet: Parquet, CSV or JSON by Spark; of a workbook the columns of ``schema``, or else all as text."""
    if path.endswith(".xlsx"):
        if schema is None:
            content = spark.read.format("binaryFile").load(path).first()["content"]
            schema = ", ".join(f"`{n}` string" for n in next(rows_of(bytes(content)), []) if n is not None)
        return read_workbook(spark, path, schema)
    if path.endswith(".csv"):
        return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if path.endswith(".json"):
        return spark.read.option("multiLine", True).json(path)
    return spark.read.parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``(row, id, text)`` of a tab-separated sidecar, every line kept; a line without a tab has a null text.

    ``row`` is the line's number from 0: the vector of the matrix it belongs to.
    """
    lines = index_rows(spark.read.text(path).withColumn("_at", F.monotonically_increasing_id()), ["_at"], "row")
    parts = F.split("value", "\t", 2)
    return lines.select("row", parts[0].alias("id"), F.get(parts, F.lit(1)).alias("text"))


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """``(id, document, embedding)`` of all files of a collection folder; missing columns are an error."""
    return require_columns(spark.read.parquet(path), "id", "document", "embedding").select("id", "document", "embedding")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """``(question_id, record)`` of a JSON result file, the record as JSON text.

    The file is a list of records with a ``question_id``, a map by question id,
    or either under ``results``; records of a list without an id drop out. A
    file is one row of text, as its format demands.
    """
    text = spark.read.text(path, wholetext=True).select(F.col("value").alias("t"))
    text = text.select(F.coalesce(F.get_json_object("t", "$.results"), "t").alias("t")).select(F.trim("t", F.lit(" \t\r\n")).alias("t"))
    listed = text.filter(F.col("t").startswith("[")).select(F.explode(F.from_json("t", "array<string>")).alias("record"))
    listed = listed.select(F.get_json_object("record", "$.question_id").alias("question_id"), "record").filter("question_id is not null")
    named = text.filter(F.col("t").startswith("{")).select(F.explode(F.from_json("t", "map<string,string>")).alias("question_id", "record"))
    return listed.unionByName(named)


def read_paths(spark: SparkSession, path: str) -> DataFrame:
    """``(question_id, raw_paths, paths)`` of a JSON path file, both as lists of JSON text.

    A result that is text alone is its only path; a single value counts as a
    list of one, what is missing as the empty list.
    """
    rows = read_results(spark, path)
    plain = ~F.col("record").startswith("{")
    empty = F.array().cast("array<string>")

    def listed(name: str) -> Column:
        one = F.get_json_object("record", f"$.{name}")
        return F.when(one.isNull(), empty).when(one.startswith("["), F.coalesce(F.from_json(one, "array<string>"), F.array(one))).otherwise(F.array(one))

    return rows.select(
        "question_id", F.when(plain, empty).otherwise(listed("raw_paths")).alias("raw_paths"), F.when(plain, F.array("record")).otherwise(listed("paths")).alias("paths")
    )


def first_rows(df: DataFrame, order: list[str], n: int = 100) -> DataFrame:
    """The first ``n`` rows in ``order``: the limited mode for trying a run. Whole runs do without."""
    return df.orderBy(*order).limit(n)


def last_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row of each key, the last in ``order``; among equals the greatest row by the other columns."""
    rest = [c for c in df.columns if c not in key and c not in order]
    packed = df.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("_row"))
    return packed.select(*[F.col(c) if c in key else F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def id_page(ids: DataFrame, prefix: str = "", limit: int | None = None, page: int = 500) -> DataFrame:
    """``(id, page)`` of the distinct ids with ``prefix`` in order, cut at ``limit``, in pages of ``page``."""
    rows = index_rows(ids.select("id").filter(F.col("id").startswith(prefix)).distinct(), ["id"], "i")
    rows = rows if limit is None else rows.filter(F.col("i") < limit)
    return rows.select("id", F.floor(F.col("i") / page).cast("long").alias("page"))


def read_matrix(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, row, v array<float>)`` of NumPy matrix files; a file is read by one task, as the format demands."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                matrix = np.load(io.BytesIO(content), allow_pickle=False)
                for start in range(0, len(matrix), 4096):
                    part = matrix[start : start + 4096].astype(np.float32)
                    yield pd.DataFrame({"file": name, "row": np.arange(start, start + len(part)), "v": list(part)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, row bigint, v array<float>")


def chunk_number(name: str) -> int:
    """The number before a chunk file's extension; chunks are ordered by it, not by name."""
    found = re.search(r"(\d+)\.\w+$", name)
    if not found:
        raise ValueError(f"{name!r} has no chunk number")
    return int(found[1])


def read_chunks(spark: SparkSession, vectors: list[str], metadata: list[str]) -> DataFrame:
    """``(chunk, row, v, meta...)`` of chunked vectors and their JSON-lines metadata, paired by chunk number and row.

    File counts and the row counts of each pair must agree; a mismatch is an error.
    """
    if len(vectors) != len(metadata):
        raise ValueError("as many vector chunks as metadata chunks are needed")
    v_files = {chunk_number(p): p for p in vectors}
    m_files = {chunk_number(p): p for p in metadata}
    if v_files.keys() != m_files.keys():
        raise ValueError("vector and metadata chunks have different numbers")
    return _paired(spark, [(n, v_files[n], m_files[n]) for n in sorted(v_files)]).withColumnRenamed("part", "chunk")


def read_named(spark: SparkSession, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """``(part, row, v, meta...)`` of named pairs of matrix and JSON-lines metadata, ``part`` counting the pairs from 0.

    A file that is not there is a FileNotFoundError that names it; different lengths are an error.
    """
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    for name, files_ in pairs.items():
        for path in files_:
            p = fs.Path(path)
            if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
                raise FileNotFoundError(f"{name}: {path}")
    return _paired(spark, [(n, *pair) for n, pair in enumerate(pairs.values())])


def _paired(spark: SparkSession, parts: list[tuple[int, str, str]]) -> DataFrame:
    """Matrices and metadata by part and row. One scan of each side; lengths are compared by one aggregation."""
    name = lambda path: path.rsplit("/", 1)[-1]
    for at in (1, 2):
        if len({name(p[at]) for p in parts}) < len(parts):
            raise ValueError("the files of a side need different names")
    number = lambda at: F.create_map(*[x for part in parts for x in (F.lit(name(part[at])), F.lit(part[0]))])
    base = lambda c: F.regexp_extract(c, r"([^/]+)$", 1)
    v = read_matrix(spark, [p[1] for p in parts]).select(number(1)[base(F.col("file"))].alias("part"), "row", "v")
    lines = spark.read.json([p[2] for p in parts]).withColumns({"part": number(2)[base(F.col("_metadata.file_path"))], "_at": F.monotonically_increasing_id()})
    meta = index_rows(lines, ["part", "_at"], "_i")
    meta = meta.join(F.broadcast(meta.groupBy("part").agg(F.min("_i").alias("_first"))), "part").withColumn("row", F.col("_i") - F.col("_first")).drop("_i", "_first", "_at")
    lengths = v.groupBy("part").agg(F.count("*").alias("a")).join(meta.groupBy("part").agg(F.count("*").alias("b")), "part", "full")
    wrong = lengths.filter("a is distinct from b").orderBy("part").first()
    if wrong:
        raise ValueError(f"part {wrong['part']}: vectors and metadata have different lengths")
    return v.join(meta, ["part", "row"])


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """``df`` itself, or an error that names the missing columns."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def index_rows(df: DataFrame, order: list[str], name: str = "i") -> DataFrame:
    """Adds a gap-free row number from 0 in the order of ``order``, without a single sorting task.

    Rows are range-partitioned and sorted; the counts of the partitions, one
    number each, give every partition its offset. Rows equal in ``order`` are
    numbered in any order.
    """
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    part, at = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    counts = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    offsets, total = [], 0
    for p in sorted(counts):
        offsets.append((p, total))
        total += counts[p]
    schema = T.StructType([T.StructField("_p", T.LongType()), T.StructField("_o", T.LongType())])
    shift = df.sparkSession.createDataFrame(offsets, schema)
    joined = placed.withColumn("_p", part).join(F.broadcast(shift), "_p")
    return joined.withColumn(name, at + F.col("_o")).drop("_p", "_o", "_m")


def collection_rows(df: DataFrame, collection: str = "collection", order: str = "id") -> DataFrame:
    """Adds ``row_id``: ``<collection>_<i>``, i counting from 0 in each collection."""
    numbered = index_rows(df, [collection, order])
    first = numbered.groupBy(collection).agg(F.min("i").alias("first"))
    return numbered.join(first, collection).withColumn(
        "row_id", F.concat(collection, F.lit("_"), (F.col("i") - F.col("first")).cast("string"))
    ).drop("i", "first")


def write_collection(df: DataFrame, path: str, mode: str = "append") -> None:
    """Vectors to a collection folder: ``append`` adds to what is there, ``overwrite`` replaces it."""
    require_columns(df, "id", "embedding").write.mode(mode).parquet(path)


def upsert_collection(df: DataFrame, path: str) -> None:
    """Rows of ``df`` into a collection folder by id: new ids are added, known ones replaced; of several rows of an id one is kept.

    The merged collection is written beside the old one, which it then
    replaces, so a run that fails leaves the old one as it was.
    """
    spark = df.sparkSession
    fresh = require_columns(df, "id", "embedding").dropDuplicates(["id"])
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target, beside = hadoop.Path(path), hadoop.Path(f"{path.rstrip('/')}.{uuid.uuid4().hex}")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        kept = spark.read.parquet(path).join(fresh.select("id"), "id", "left_anti")
        fresh = kept.unionByName(fresh, allowMissingColumns=True)
    fresh.write.parquet(str(beside.toString()))
    fs.delete(target, True)
    if not fs.rename(beside, target):
        raise OSError(f"{beside.toString()} could not be renamed to {path}")


def write_matrix(df: DataFrame, folder: str, chunk_rows: int = 100_000, order: str = "id") -> int:
    """``(id, text, v)`` rows to matrix files with tab-separated sidecars, in ``order``; how many pairs of files were written.

    Each chunk of ``chunk_rows`` rows is written by one task to ``folder`` (a
    folder all workers share): ``embeddings_chunk_<n>.npy`` and
    ``embeddings_chunk_<n>.txt``. Tabs and line breaks in ids and texts become
    blanks, so a line is a row.
    """
    numbered = index_rows(df.select("id", "text", "v"), [order], "_i").withColumn("_n", F.floor(F.col("_i") / chunk_rows).cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["_n"].iloc[0])
        pdf = pdf.sort_values("_i")
        stem = f"{folder.rstrip('/')}/embeddings_chunk_{n}"
        os.makedirs(folder, exist_ok=True)
        clean = lambda c: pdf[c].fillna("").astype(str).str.replace(r"[\t\r\n]+", " ", regex=True)
        with open(f"{stem}.npy.part", "wb") as f:
            np.save(f, np.stack(pdf["v"].to_numpy()).astype(np.float32))
        with open(f"{stem}.txt.part", "w", encoding="utf-8") as f:
            f.writelines(f"{i}\t{t}\n" for i, t in zip(clean("id"), clean("text")))
        for end in ("npy", "txt"):  # a task that runs again replaces whole files
            os.replace(f"{stem}.{end}.part", f"{stem}.{end}")
        return pd.DataFrame({"n": [n]})

    return numbered.groupBy("_n").applyInPandas(run, "n int").count()


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def similarity_report(rows: DataFrame, key: str = "question_id") -> DataFrame:
    """``(key, report)``: a line ``- id: text (Score: 0.1234)`` for each ranked row (id, text, score, rank_no)."""
    line = F.format_string("- %s: %s (Score: %.4f)", F.col("id"), F.coalesce("text", F.lit("")), F.col("score"))
    pack = F.sort_array(F.collect_list(F.struct("rank_no", line.alias("t"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(pack, lambda s: s["t"]), "\n").alias("report"))


def write_report(rows: DataFrame, path: str, key: str = "question_id") -> None:
    """The report as text, a separator line between questions."""
    text = similarity_report(rows, key).select(F.concat(F.col(key), F.lit("\n"), "report", F.lit("\n" + "=" * 80)))
    text.write.mode("overwrite").text(path)
