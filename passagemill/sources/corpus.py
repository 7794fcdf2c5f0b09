"""Reading corpora, requests and golden sets; writing the store and results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill import schemas
from passagemill.functions.text import exclusion_patterns
from passagemill.session import stage_table

DEFAULT_EXCLUDES = ("**/MEMORY.md", "**/learning-log.md")


def resolve_excludes(extra: list[str] | None = None, use_defaults: bool = True) -> list[str]:
    return [*(DEFAULT_EXCLUDES if use_defaults else ()), *(extra or [])]


def is_excluded(path: Column, globs: list[str]) -> Column:
    out = F.lit(False)
    for pattern in exclusion_patterns(globs):
        out = out | path.rlike(pattern)
    return out


def read_corpus(spark: SparkSession, root: str, globs: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, failed) of all *.md under root: path_or_uri (relative) and content; failed has those that are no UTF-8. Line ends become \\n.

    Folders are listed and files read in tasks, so no list of files meets at the driver. Where pyarrow does not open the store, or root is a pattern, Spark's reader does both, and lists files at the driver.
    """
    excluded = resolve_excludes() if globs is None else globs
    place = _openable(spark, root)
    if place is None:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
        top = "/" + root.split("://", 1)[-1].strip("/") + "/"
        files = raw.select(F.expr(f"substring(path, instr(path, '{top}') + {len(top)})").alias("path_or_uri"), "content")
        files = files.filter(~is_excluded(F.col("path_or_uri"), excluded))
    else:
        names = list_files(spark, place).filter(F.col("path").endswith(".md")).withColumnRenamed("path", "path_or_uri")
        files = read_files(names.filter(~is_excluded(F.col("path_or_uri"), excluded)), place)
    text = F.expr("try_validate_utf8(cast(content AS string))")
    both = files.withColumn("text", text)
    good = both.filter("text IS NOT NULL").select("path_or_uri", F.regexp_replace("text", "\r\n?", "\n").alias("content"))
    return good, both.filter("text IS NULL").select("path_or_uri", F.lit("not UTF-8").alias("fault"))


def _openable(spark: SparkSession, root: str) -> str | None:
    """root as a URI that pyarrow opens and finds a folder at, else None."""
    if any(c in root for c in "*?[]{}%\\ "):
        return None
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    uri = uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri
    try:
        fs, top = pyarrow.fs.FileSystem.from_uri(uri)
        return uri if fs.get_file_info(top).type == pyarrow.fs.FileType.Directory else None
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return None


#: Rows and bytes of a batch of names or contents.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """path (relative to root) of every file under root. Each level of folders is listed in tasks, and is a table in the shared folder. Names that Spark's readers pass over (beginning with a dot or _) are passed over here too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pyarrow.fs.FileSystem.from_uri(root)
        top = top.rstrip("/")
        for b in batches:
            for folder in b.column(0).to_pylist():
                found = fs.get_file_info(pyarrow.fs.FileSelector(f"{top}/{folder}".rstrip("/")))
                found = [x for x in found if not x.base_name.startswith(".") and not (x.base_name.startswith("_") and "=" not in x.base_name) and not x.base_name.endswith("._COPYING_")]
                for i in range(0, len(found), BATCH_ROWS):
                    part = found[i : i + BATCH_ROWS]
                    paths = [f"{folder}/{x.base_name}".lstrip("/") for x in part]
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([x.type == pyarrow.fs.FileType.Directory for x in part], pa.bool_())], names=["path", "folder"])

    folders, files = spark.createDataFrame([("",)], "path string"), None
    while True:
        level = stage_table(folders.repartition("path").mapInArrow(run, "path string, folder boolean"), "corpus-folders")
        here = level.filter("NOT folder").select("path")
        files = here if files is None else files.unionByName(here)
        folders = level.filter("folder").select("path")
        if folders.isEmpty():
            return files


def read_files(files: DataFrame, root: str) -> DataFrame:
    """path_or_uri and content (bytes) of each of files (path_or_uri) under root, read in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pyarrow.fs.FileSystem.from_uri(root)
        top = top.rstrip("/")

        def out(names: list[str], contents: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["path_or_uri", "content"])

        for b in batches:
            names, contents, held = [], [], 0
            for name in b.column(0).to_pylist():
                with fs.open_input_stream(f"{top}/{name}", compression=None) as f:
                    contents.append(f.read())
                names.append(name)
                held += len(contents[-1])
                if len(names) == BATCH_ROWS or held >= BATCH_BYTES:
                    yield out(names, contents)
                    names, contents, held = [], [], 0
            yield out(names, contents)

    # Names are small, so one task would get many of them.
    return files.select("path_or_uri").repartition("path_or_uri").mapInArrow(run, "path_or_uri string, content binary")


def write_files(files: DataFrame, root: str) -> None:
    """Write each of files (path_or_uri, content as bytes) as a file under root, in tasks. A task that runs again writes the same files again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pyarrow.fs.FileSystem.from_uri(root)
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs.create_dir(f"{top}/{name}".rpartition("/")[0], recursive=True)
                with fs.open_output_stream(f"{top}/{name}") as f:
                    f.write(content)
            yield b.select(["path_or_uri"])

    files.select("path_or_uri", "content").mapInArrow(run, "path_or_uri string").write.format("noop").mode("overwrite").save()


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.INGEST_REQUESTS).json(path)


GOLDEN_ROWS = "path string, position int, query string, expect_path_or_uri array<string>, notes string, top_k int, threshold int, minimum_queries int, fault string"
GATE = ("top_k", "threshold", "minimum_queries")


def _is_text(x) -> bool:
    return isinstance(x, str) and x != ""


def _golden_rows(text: str) -> list[tuple]:
    """The entries of a golden file (YAML) as rows of GOLDEN_ROWS without the path. What is wrong with an entry stands in its fault; what is wrong with the file is one row at position -1."""

    def whole(fault: str) -> list[tuple]:
        return [(-1, None, None, None, None, None, None, fault)]

    try:
        doc = yaml.safe_load(text)
    except yaml.YAMLError as e:
        return whole(f"not YAML: {getattr(e, 'problem', None) or e}")
    if not isinstance(doc, dict):
        return whole("the top level must be a mapping")
    if doc.get("version") != 1:
        return whole("version must be 1")
    gate = doc.get("gate")
    bad = ["gate"] if not isinstance(gate, dict) else [f"gate.{k}" for k in GATE if type(gate.get(k)) is not int]
    if bad:
        return whole(f"{bad[0]} must be {'a mapping' if bad == ['gate'] else 'an integer'}")
    if not isinstance(doc.get("queries"), list):
        return whole("queries must be a list")
    rows = []
    for i, entry in enumerate(doc["queries"]):
        e = entry if isinstance(entry, dict) else {}
        want = e.get("expect_path_or_uri")
        want = [want] if isinstance(want, str) else want
        verdicts = (
            (isinstance(entry, dict), "must be a mapping"),
            (_is_text(e.get("query")) and e["query"].strip() != "", "query must be a text"),
            (isinstance(want, list) and want != [] and all(map(_is_text, want)), "expect_path_or_uri must be a path or a list of paths"),
            (e.get("notes") is None or isinstance(e["notes"], str), "notes must be a text"),
        )
        fault = next((f"queries[{i}]: {said}" for holds, said in verdicts if not holds), None)
        rows.append((i, *((e["query"], want, e.get("notes")) if fault is None else (None,) * 3), *(gate[k] for k in GATE), fault))
    return rows


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """The entries of all golden files (YAML, each read whole in a task) under path, one row each (GOLDEN_ROWS), with the gate of their file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in GOLDEN_ROWS.split(", ")]
        for b in batches:
            yield pd.DataFrame([(p, *row) for p, text in zip(b["path"], b["text"], strict=True) for row in _golden_rows(text)], columns=names).astype(dict.fromkeys(("position", *GATE), "Int32"))

    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).mapInPandas(run, GOLDEN_ROWS)


def load_golden(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """(gate, queries) of one golden file; the first fault raises and names the entry. A hand-made file of this kind is small and is read on the driver."""
    return check_golden(spark, "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def check_golden(spark: SparkSession, text: str) -> tuple[dict, DataFrame]:
    rows = _golden_rows(text)
    for row in rows:
        if row[-1]:
            raise ValueError(row[-1])
    gate = yaml.safe_load(text)["gate"]
    return {k: gate[k] for k in GATE}, spark.createDataFrame([row[1:4] for row in rows], schemas.GOLDEN)


def write_store(notes: DataFrame, passages: DataFrame, folder: str) -> None:
    """Parquet by tenant; only the tenants that are written are overwritten."""
    for name, df, order in (("notes", notes, ["id"]), ("passages", passages, ["note_id", "ordinal"])):
        df.repartition("client_name", order[0]).sortWithinPartitions(*order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("client_name").parquet(f"{folder}/{name}")


def read_store(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return tuple(spark.read.schema(s).parquet(f"{folder}/{n}") for n, s in (("notes", schemas.NOTES), ("passages", schemas.PASSAGES)))


def write_results(results: DataFrame, folder: str) -> None:
    """Search results or a summary, as JSON lines."""
    results.write.mode("overwrite").json(folder)
