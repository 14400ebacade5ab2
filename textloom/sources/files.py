"""Readers and writers of posts: JSON lines, zstd dumps, CSV sets, JSON arrays."""

from __future__ import annotations

import logging
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)
RAW = "id string, subreddit string, title string, selftext string, created_utc long"
USUAL = ("subreddit", "matched_bias_types", "matched_keywords", "created_dt", "created_utc", "clean_text", "id", "title", "selftext")


def paths_of(spark: SparkSession, glob: str) -> list[str]:
    """The files that a path or glob names, sorted; a folder names the files in it that aren't hidden."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(glob)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out, found = [], fs.globStatus(path) or []
    for status in found:
        inside = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
        out += [str(x.getPath().toString()) for x in inside if x.isFile() and x.getPath().getName()[0] not in "._"]
    return sorted(out)


def list_extracted(spark: SparkSession, folder: str) -> list[str]:
    """The JSON lines files of a folder, by name."""
    return [p.rsplit("/", 1)[-1] for p in paths_of(spark, f"{folder}/*.jsonl")]


def register(df: DataFrame, name: str) -> DataFrame:
    """df, which SQL can then name."""
    df.createOrReplaceTempView(name)
    return df


def read_jsonl(spark: SparkSession, path: str, schema: str = RAW, strict: bool = True) -> DataFrame:
    """JSON lines under a stated schema; strict fails on a bad line, otherwise it is dropped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def preview(spark: SparkSession, path: str, n: int = 10, schema: str = RAW) -> DataFrame:
    """The first n good lines, with created_dt from the epoch."""
    return read_jsonl(spark, path, schema, strict=False).limit(n).withColumn("created_dt", F.timestamp_seconds("created_utc"))


def read_json_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def _inflated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import io

    import zstandard
    from pyarrow import fs as pafs

    for batch in batches:
        for uri in batch.column(0).to_pylist():
            files, path = pafs.FileSystem.from_uri(uri)
            lines, size = [], 0
            with files.open_input_stream(path, compression=None) as raw, zstandard.ZstdDecompressor(max_window_size=1 << 31).stream_reader(raw, read_across_frames=True) as z:
                for line in io.TextIOWrapper(io.BufferedReader(z, 1 << 20), "utf-8", errors="replace", newline="\n"):
                    lines.append(line.rstrip("\n"))
                    size += len(line)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array([uri] * len(lines)), pa.array(lines)], names=["path", "value"])
                        lines, size = [], 0
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(lines)), pa.array(lines)], names=["path", "value"])


def read_zst_lines(spark: SparkSession, uris: Sequence[str], allow_empty: bool = False) -> DataFrame:
    """(path, value): the lines of zstd files of any window, inflated as they are read, about a task a file.

    A file without a line is an error unless allow_empty.
    """

    def inflated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                some = False
                for part in _inflated(iter([batch.select(["path"]).slice(i, 1)])):
                    some = True
                    yield part
                if not some and not allow_empty:
                    raise ValueError(f"nothing in {batch.column('path')[i].as_py()}")

    rows = spark.createDataFrame(list(enumerate(uris)), "i long, path string")
    return rows.repartitionByRange(max(1, len(uris)), "i").mapInArrow(inflated, "path string, value string")


def extract_zst(spark: SparkSession, uri: str, out: str, delete_source: bool = False, schema: str = RAW) -> DataFrame:
    """A zstd dump as JSON lines under out; then its preview. The source is only deleted when asked for, once out is whole."""
    read_zst_lines(spark, [uri]).select("value").write.mode("overwrite").text(out)
    if delete_source:
        path = spark._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)
    return preview(spark, out, schema=schema)


def jsonl_to_csv(spark: SparkSession, path: str, out: str, schema: str = RAW) -> None:
    """JSON lines as CSV with headers and created_dt from the epoch; bad lines are dropped, parts are committed whole."""
    rows = read_jsonl(spark, path, schema, strict=False)
    write_csv(rows.withColumn("created_dt", F.timestamp_seconds("created_utc")) if "created_utc" in rows.columns else rows, out)


def parse_lines(lines: DataFrame, schema: str = RAW, text_col: str = "value") -> DataFrame:
    """JSON objects of a text column; lines that aren't are dropped."""
    read = F.from_json(text_col, schema, {"mode": "PERMISSIVE"})
    return lines.select(read.alias("r")).where("r is not null").select("r.*").where("not (id is null and subreddit is null and title is null and selftext is null and created_utc is null)")


def read_csv_set(spark: SparkSession, glob: str, usual: Sequence[str] = USUAL) -> DataFrame:
    """All CSV files of a glob as text columns, put together by column name; columns that a file lacks are null in its rows.

    An empty cell is null, one of "" an empty text; white space stays.
    The usual columns are always there, and a null or empty subreddit is the file's name without _keyword_filtered. Files
    with one header are read as one set. A file that can't be read, or has no header, is left out with a
    warning; no file at all is an error, and so is none that can be read.
    """
    paths = paths_of(spark, glob)
    if not paths:
        raise FileNotFoundError(f"no files match {glob}")
    reader = spark.read.option("multiLine", True).option("escape", '"')
    sets: dict[tuple[str, ...], list[str]] = {}
    for path in paths:  # a header each: the rows stay where they are
        try:
            head = reader.csv(path).limit(1).collect()
        except Exception as e:
            log.warning("left out %s: %s", path, str(e)[:200])
            continue
        names = tuple(str(c) for c in head[0] if c is not None) if head else ()
        if names:
            sets.setdefault(names, []).append(path)
        else:
            log.warning("left out %s: no header", path)
    if not sets:
        raise RuntimeError(f"none of the files of {glob} could be read")
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:_keyword_filtered|_filtered_cleaned)?\.csv$", 1)
    out: DataFrame | None = None
    for names, some in sets.items():
        # Spark takes empty texts for nulls, unless what stands for null is something else; unquoted empty cells are null all the same.
        df = reader.option("header", True).option("nullValue", "\0null").schema(", ".join(f"`{n}` string" for n in names)).csv(some)
        df = df.withColumns({c: F.lit(None).cast("string") for c in usual if c not in df.columns})
        df = df.withColumn("subreddit", F.coalesce(F.nullif("subreddit", F.lit("")), F.url_decode(stem)))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; array columns become comma-separated text. Texts are kept as they are, empty ones (as "") and white space around them too. Parts are committed whole."""
    flat = [F.array_join(c, ", ").alias(c) if t.startswith("array") else F.col(f"`{c}`") for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').options(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_header(spark: SparkSession, columns: Sequence[str], path: str) -> None:
    """A CSV folder with one file of just a header."""
    head = ",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\n') else c for c in columns)
    spark.createDataFrame([(head,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, UTF-8."""
    df.write.mode("overwrite").json(path)


def write_json_array(df: DataFrame, path: str, indent: int = 2) -> None:
    """One JSON array, UTF-8, in one file, written as the rows arrive; no rows make []. For results that one file can hold.

    path: a URI that the driver can write to. It only appears once whole.
    """
    import json

    from pyarrow import fs as pafs

    files, at = pafs.FileSystem.from_uri(path)
    draft, pad = at + ".draft", " " * indent
    with files.open_output_stream(draft, compression=None) as out:
        some = False
        for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator():
            text = json.dumps(json.loads(r.j), ensure_ascii=False, indent=indent).replace("\n", "\n" + pad)
            out.write(((",\n" if some else "[\n") + pad + text).encode())
            some = True
        out.write(b"\n]" if some else b"[]")
    files.move(draft, at)


def sample_posts(spark: SparkSession, n: int, subreddits: Sequence[str] = ("aiArt", "technology_")) -> DataFrame:
    """n made-up posts in the raw columns, the same each time: for trials and tests."""
    i = F.col("id")
    name = F.get(F.array(*map(F.lit, subreddits)), (i % len(subreddits)).cast("int"))
    title = F.concat(F.lit("Sample post "), i, F.when(i % 3 == 0, " on generated portraits").otherwise(" on tools"))
    body = F.when(i % 5 == 4, "[deleted]").otherwise(F.concat(F.lit("See https://example.org/"), i, F.lit(" for <b>more</b>!")))
    return spark.range(n).select(F.concat(F.lit("s"), i).alias("id"), name.alias("subreddit"), title.alias("title"), body.alias("selftext"), (1640995200 + i * 86_400).alias("created_utc"))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
