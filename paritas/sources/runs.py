"""Sources and sinks: incidence, mechanism logs, runs, markers, ragged pairs, summaries."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paritas.operators.checks import check_incidence
from paritas.operators.incidence import Incidence, degree_stats, with_lambda
from paritas.operators.ranks import running_totals
from paritas.session import cut_lineage

# ---- incidence ------------------------------------------------------------------------------------

INCIDENCE_SCHEMAS = {
    "edges": "det bigint, fault bigint", "obs_edges": "obs bigint, fault bigint", "faults": "fault bigint, p double",
    "detectors": "det bigint, check bigint, round int, kind int"}


def write_incidence(inc: Incidence, path: str) -> None:
    """The four tables plus one statistics row."""
    for name, schema in INCIDENCE_SCHEMAS.items():
        columns = [part.split() for part in schema.split(", ")]
        getattr(inc, name).select(*[F.col(c).cast(kind) for c, kind in columns]).write.mode("overwrite").parquet(f"{path}/{name}")
    rows = degree_stats(inc.edges, inc.detectors, "det")
    columns = degree_stats(inc.edges, inc.faults, "fault")
    stats = rows.select(F.lit("row").alias("side"), "*").unionByName(columns.select(F.lit("column").alias("side"), "*"))
    stats.write.mode("overwrite").parquet(f"{path}/statistics")


def read_incidence(spark: SparkSession, path: str, verify: bool = True) -> Incidence:
    tables = {name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in INCIDENCE_SCHEMAS.items()}
    inc = Incidence(edges=tables["edges"], obs_edges=tables["obs_edges"], faults=with_lambda(tables["faults"]), detectors=tables["detectors"])
    if verify:
        broken = check_incidence(inc).limit(5).collect()  # five messages at most
        if broken:
            raise ValueError("inconsistent incidence: " + "; ".join(f"{r.code} {r.detail}" for r in broken))
    return inc


# ---- mechanism logs ---------------------------------------------------------------------------------

# Fixed formats: the detector and the observable targets of a flattened error line.
DETECTOR, OBSERVABLE = r"\bD(\d+)", r"\bL(\d+)"


def read_mechanisms(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(mechanisms, edges, obs_edges, malformed) of a log of flattened error lines.

    A line's components (separated by ^) combine by symmetric difference. Mechanisms are numbered
    in file and line order. Lines that are not errors (declarations, blanks) are passed over;
    error lines without a probability in [0, 1] are returned as malformed.

    Lines are neither sorted nor shuffled: a task numbers its good lines as it reads them, and one row per
    split of the files, counted from what was read, shifts them to their place in the log.
    """
    text = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    lines = text.where(F.ltrim("value").startswith("error"))
    p = F.expr("try_cast(regexp_extract(value, '^\\\\s*error\\\\(([^)]*)\\\\)', 1) as double)")
    parsed = lines.withColumn("p", p)
    good = F.coalesce((F.col("p") >= 0) & (F.col("p") <= 1), F.lit(False))
    # After the filter the ids of a task's rows have no gaps.
    named = parsed.where(good).select(
        F.monotonically_increasing_id().alias("_id"), "_file", "_block", "p", F.col("value").contains("^").alias("decomposed"),
        *[F.regexp_extract_all("value", F.lit(pattern), F.lit(1)).cast("array<bigint>").alias(c) for pattern, c in ((DETECTOR, "dets"), (OBSERVABLE, "obs"))])
    read = cut_lineage(named.withColumns({c: _odd_ones(c) for c in ("dets", "obs")}))
    splits = read.groupBy("_file", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = splits.select("_file", "_block", (before - F.col("_first")).alias("_shift"))
    numbered = read.join(F.broadcast(shifts), ["_file", "_block"]).withColumn("fault", F.col("_id") + F.col("_shift"))
    return (numbered.select("fault", "p", "decomposed"), numbered.select(F.explode("dets").alias("det"), "fault"),
            numbered.select(F.explode("obs").alias("obs"), "fault"), parsed.where(~good).select("value"))


def _odd_ones(name: str) -> Column:
    """The values that an array holds an odd number of times; they are compared in pairs only where one repeats."""
    values = F.array_distinct(name)
    counted = F.filter(values, lambda x: F.size(F.filter(name, lambda y: y == x)) % 2 == 1)
    return F.when(F.size(values) == F.size(name), F.col(name)).otherwise(counted)


# ---- runs -------------------------------------------------------------------------------------------

RUN_KEYS = ["arm", "chunk", "half"]
# The tables a run may hold.
RUN_TABLES = ("shots", "windows", "solutions", "supports", "commits", "confidence", "history")
# Fixed value: the neighbouring chunks that share a folder, and the name of its number.
CHUNKS_PER_BLOCK, BLOCK = 128, "chunk_block"


def write_run(tables: dict[str, DataFrame], path: str) -> None:
    """Each table partitioned by arm, half and block of chunks, its files in the order of the chunks.

    A file per chunk costs far more than its few rows. Rows are rebalanced on the folders, so a small
    one gets one file and one that holds much of the data is split over many tasks; inside a file the
    statistics of its pages lead to a chunk.
    """
    folders = ["arm", "half", BLOCK]
    for name, table in tables.items():
        if name not in RUN_TABLES:
            raise ValueError(f"unknown run table {name!r}")
        placed = table.withColumn(BLOCK, F.floor(F.col("chunk").cast("bigint") / CHUNKS_PER_BLOCK))
        balanced = placed.hint("rebalance", *[F.col(k) for k in folders]).sortWithinPartitions(*folders, "chunk")
        balanced.write.mode("overwrite").partitionBy(*folders).parquet(f"{path}/{name}")


def read_run(spark: SparkSession, path: str, table: str, names: Iterable[str], optional: Iterable[str] = ()) -> DataFrame:
    """A run table narrowed to its keys, ``names`` (an error lists those it lacks) and those of ``optional`` it has.

    Parquet reads no other column.
    """
    df = spark.read.parquet(f"{path}/{table}")
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{path}/{table} has no columns {missing}")
    wanted = [*names, *[c for c in optional if c in df.columns]]
    return df.select(*dict.fromkeys([*[k for k in RUN_KEYS if k in df.columns], *wanted]))


def load_campaign(spark: SparkSession, path: str, arm: str, names: Sequence[str], chunks: DataFrame, table: str = "shots",
                  optional: Sequence[str] = ()) -> DataFrame:
    """One arm's rows over its completed chunks, with the shot's number inside its chunk."""
    from paritas.operators.campaign import shot_in_chunk

    run = read_run(spark, path, table, ["shot", *names], optional).where(F.col("arm") == arm)
    return shot_in_chunk(run.withColumn("chunk", F.col("chunk").cast("bigint")).join(chunks.select("chunk"), "chunk", "left_semi"))


def partition_schemas(spark: SparkSession, path: str, table: str = "shots") -> DataFrame:
    """(arm, chunk, half, column, type) of every partition of a run table, from one file's footer each; no rows are decoded.

    The tasks cut the footers out of the files, so the driver asks for none however many chunks there are. A file's bytes
    pass through a task as one value.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{path}/{table}")
    first = files.select("path").first()
    if first and f"/{BLOCK}=" in first["path"]:
        return _block_schemas(spark, path, table, files)
    parts = [F.regexp_extract("path", f"/{k}=([^/]*)/", 1).alias(k) for k in RUN_KEYS]
    one = _footers(files, "path", *parts).groupBy(*RUN_KEYS).agg(F.min_by("footer", "path").alias("footer"))
    fields = F.udf(footer_fields, FIELDS)
    return one.select("arm", F.col("chunk").cast("bigint").alias("chunk"), "half", F.explode(fields("footer")).alias("f")).select("arm", "chunk", "half", "f.*")


FIELDS = "array<struct<column:string,type:string>>"


def _footers(files: DataFrame, *columns: Column | str) -> DataFrame:
    """(columns..., footer) of files, with its length and mark."""
    # The last eight bytes of a file are its footer's length, the lowest byte first, and the mark PAR1.
    size = F.expr("CAST(conv(regexp_replace(hex(substring(content, -8, 4)), '(..)(..)(..)(..)', '$4$3$2$1'), 16, 10) AS INT)")
    sized = files.select(*columns, size.alias("_size"), "content")
    return sized.select(*[c for c in sized.columns if c not in ("_size", "content")], F.expr("substring(content, -(_size + 8), _size + 8)").alias("footer"))


def _block_schemas(spark: SparkSession, path: str, table: str, files: DataFrame) -> DataFrame:
    """partition_schemas of a table that write_run wrote: its files hold many chunks, which only their chunk column tells.

    The column itself is left out, as a folder per chunk would have it.
    """
    file = F.col("_metadata.file_path").alias("_file")
    held = spark.read.schema("chunk bigint, arm string, half string").parquet(f"{path}/{table}").select("arm", "chunk", "half", file)
    one = held.groupBy(*RUN_KEYS).agg(F.min("_file").alias("_file"))
    fields = F.udf(footer_fields, FIELDS)
    columns = _footers(files, file).select("_file", F.explode(fields("footer")).alias("f")).where("f.column <> 'chunk'")
    return one.join(columns, "_file").select("arm", "chunk", "half", "f.*")


def footer_fields(footer: bytes) -> list[tuple[str, str]]:
    """(name, type) of the columns that a Parquet footer declares, its length and mark included."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyspark.sql.pandas.types import from_arrow_schema

    meta = pq.read_metadata(pa.BufferReader(b"PAR1" + footer))
    spark_schema = (meta.metadata or {}).get(b"org.apache.spark.sql.parquet.row.metadata")
    schema = T.StructType.fromJson(json.loads(spark_schema)) if spark_schema else from_arrow_schema(meta.schema.to_arrow_schema())
    return [(f.name, f.dataType.simpleString()) for f in schema.fields]


def check_schemas(schemas: DataFrame) -> DataFrame:
    """(arm, chunk, half, column, problem): how partitions differ from the first of their arm and half: lacking, extra or type.

    Chunks that were decoded with different options cannot be joined; halves may hold columns of their own.
    """
    first = schemas.groupBy("arm", "half").agg(F.min("chunk").alias("chunk"))
    model = schemas.join(first, ["arm", "half", "chunk"], "left_semi").select("arm", "half", "column", F.col("type").alias("wanted"))
    every = schemas.select("arm", "half", "chunk").distinct().join(model, ["arm", "half"])
    both = every.join(schemas, ["arm", "half", "chunk", "column"], "full_outer")
    problem = F.when(F.col("type").isNull(), "lacking").when(F.col("wanted").isNull(), "extra").when(F.col("type") != F.col("wanted"), "type")
    return both.select("arm", "chunk", "half", "column", problem.alias("problem")).where("problem IS NOT NULL")


# ---- markers ----------------------------------------------------------------------------------------

CHUNK_MARKER = "chunk bigint, shots bigint, seed bigint, sample_seconds double"
DONE_MARKER = "chunk bigint, arm string, shots bigint, failures bigint, converged bigint, elapsed_seconds double"


def read_markers(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Completion markers, one JSON object per line; an unreadable one is kept with readable = false."""
    corrupt = "_corrupt"
    df = spark.read.schema(f"{schema}, {corrupt} string").option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", corrupt).json(path)
    return df.withColumn("readable", F.col(corrupt).isNull() & F.col("chunk").isNotNull())


# ---- ragged pairs -----------------------------------------------------------------------------------


def rows_to_ragged(rows: DataFrame, keys: Sequence[str], values: str) -> tuple[DataFrame, DataFrame]:
    """rows(keys..., values array) -> pointers(keys..., begin, end) and data(position, value).

    Offsets run over the whole table in key order, so concatenated chunks shift by themselves.
    """
    sized = running_totals(rows.withColumn("_n", F.size(values).cast("bigint")), list(keys), {"end": "_n"})
    placed = sized.withColumn("begin", F.col("end") - F.col("_n"))
    data = placed.select("begin", F.posexplode(values).alias("_i", "value")).select(
        (F.col("begin") + F.col("_i")).alias("position"), "value")
    return placed.select(*keys, "begin", "end"), data


def ragged_to_rows(pointers: DataFrame, data: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., position, value) of every entry, by equi-join on the positions; no broadcast, as the unrolled rows are as many as the data."""
    spread = pointers.where(F.col("end") > F.col("begin")).select(
        *keys, F.explode(F.sequence("begin", F.col("end") - 1)).alias("position"))
    return spread.hint("merge").join(data, "position").select(*keys, "position", "value")


# ---- summaries --------------------------------------------------------------------------------------


def strict_json(df: DataFrame) -> DataFrame:
    """One JSON object per row; NaN and infinities become null, and nulls are written out."""
    safe = []
    for field in df.schema.fields:
        c = F.col(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        safe.append(c.alias(field.name))
    return df.select(F.to_json(F.struct(*safe), {"ignoreNullFields": "false"}).alias("value"))


def write_summary(df: DataFrame, path: str) -> None:
    strict_json(df).write.mode("overwrite").text(path)


def write_window_plan(tables: dict[str, DataFrame], spec: dict, path: str) -> None:
    """The plan's tables and, written last, its specification."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps(spec, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/spec")


def read_window_plan(spark: SparkSession, path: str, names: Sequence[str]) -> tuple[dict[str, DataFrame], dict]:
    spec = json.loads(spark.read.text(f"{path}/spec").first()["value"])
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}, spec
