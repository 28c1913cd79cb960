"""From rows of files to points of a store: SQL projections, identifiers, payloads, and a writer that paces itself and tries again."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

from tessera.sources.files import arrow_path, key_of
from tessera.sources.shipping import ship

#: Words for made-up payloads.
WORDS = ("amber", "basin", "cedar", "delta", "ember", "fjord", "grove", "harbour", "island", "juniper", "kelp", "lagoon", "meadow", "north", "orchard", "prairie", "quarry", "river", "summit", "tundra")
#: Names of distances, types, comparators and modifiers, and what they mean. Fixed values.
DISTANCES = {"cosine": "cosine", "dot": "dot", "euclid": "euclidean", "euclidean": "euclidean", "l2": "euclidean", "manhattan": "manhattan", "l1": "manhattan"}
DATATYPES = {"float32": "float32", "f32": "float32", "float16": "float16", "f16": "float16", "uint8": "uint8", "u8": "uint8"}
COMPARATORS = {"max_sim": "max_sim", "maxsim": "max_sim"}
MODIFIERS = {"none": "none", "idf": "idf"}
#: Answers of a store after which trying again is no use, by gRPC code, and those after which it is, by HTTP status. Fixed values.
FINAL_CODES = frozenset({3, 5, 7, 12, 16})
RETRY_STATUS = frozenset({429, 502, 503, 504})
_JSON = (StringType, LongType, IntegerType, DoubleType, FloatType, BooleanType)


def named(table: dict[str, str], value: str | None, default: str | None = None) -> str | None:
    """A name by a table of aliases, in any case; null is the default."""
    if value is None:
        return default
    if value.lower() not in table:
        raise ValueError(f"unknown name {value!r}, expected one of {', '.join(table)}")
    return table[value.lower()]


# --- projections ----------------------------------------------------------------------------------------------------
def register_functions(spark: SparkSession) -> None:
    """SQL functions for expressions of identifiers and payloads. Their names are fixed values: expressions of users have them."""
    words = ", ".join(f"'{w}'" for w in WORDS)
    for text in (
        "vf_uuid_from_hex(h STRING) RETURNS STRING RETURN regexp_replace(h, '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '$1-$2-$3-$4-$5')",
        "make_point_id(f STRING, r BIGINT) RETURNS STRING RETURN regexp_replace(md5(f || ':' || CAST(r AS STRING)), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '$1-$2-$3-$4-$5')",
        "vf_point_id(f STRING, r BIGINT) RETURNS STRING RETURN regexp_replace(md5(f || ':' || CAST(r AS STRING)), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '$1-$2-$3-$4-$5')",
        "random_choice(items ARRAY<STRING>) RETURNS STRING NOT DETERMINISTIC RETURN element_at(items, CAST(floor(rand() * size(items)) AS INT) + 1)",
        f"random_word() RETURNS STRING NOT DETERMINISTIC RETURN element_at(array({words}), CAST(floor(rand() * {len(WORDS)}) AS INT) + 1)",
        f"random_words(n INT) RETURNS STRING NOT DETERMINISTIC RETURN array_join(transform(CASE WHEN n > 0 THEN sequence(1, n) ELSE array() END, i -> element_at(array({words}), CAST(floor(rand() * {len(WORDS)}) AS INT) + 1)), ' ')",
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")


def points(rows: DataFrame, identifier: str = "uuid()", vectors: dict[str, str] | None = None, payload: dict[str, str] | None = None, shard_key: str | None = None, limit: int | None = None) -> DataFrame:
    """__id, __shard_key, vectors and payload by SQL expressions over the columns of ``rows``.

    All expressions see the columns as they are read: no name given here hides a column from another expression. Of a ``scan``,
    filename is the file's key. An identifier that is neither text nor a whole number is an error.
    """
    source = rows.withColumn("filename", key_of(F.col("filename"))) if "filename" in rows.columns else rows
    wanted = {"__id": identifier, **({"__shard_key": shard_key} if shard_key else {}), **(vectors or {}), **(payload or {})}
    if len(wanted) < 1 + bool(shard_key) + len(vectors or {}) + len(payload or {}):
        raise ValueError("vectors and payload fields have to differ in name")
    out = source.limit(limit) if limit is not None else source
    out = out.select(*[F.expr(e).alias(f"__new_{n}") for n, e in enumerate(wanted.values())]).toDF(*wanted)
    if out.schema["__id"].dataType.typeName() not in ("string", "long", "integer", "short", "byte"):
        raise ValueError("an identifier has to be text or a whole number")
    return out


def virtual_id(spark: SparkSession, filename: str, row: int, expression: str) -> str | int:
    """Value of an identifier expression over filename and file_row_number alone, without reading a file."""
    return spark.range(1).select(F.lit(filename).alias("filename"), F.lit(row).cast("long").alias("file_row_number")).select(F.expr(expression)).first()[0]


def identifier_text(field: StructField) -> Column:
    """An identifier as text: text and whole numbers, nothing else."""
    if field.dataType.typeName() not in ("string", "long", "integer", "short", "byte"):
        raise ValueError(f"identifiers of type {field.dataType.simpleString()} are not supported")
    return F.col(field.name).cast("string")


def payload_json(rows: DataFrame, *columns: str) -> Column:
    """Columns as a JSON object: texts, whole and finite numbers and truth values as they are, all else null."""
    fields = []
    for c in columns or rows.columns:
        kind = rows.schema[c].dataType
        value = F.col(c) if isinstance(kind, _JSON) else F.lit(None).cast("string")
        if isinstance(kind, (DoubleType, FloatType)):
            value = F.when(F.abs(value) < F.lit(float("inf")), value)
            value = F.when(~F.isnan(value), value)
        fields.append(value.alias(c))
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def resume_file(files: DataFrame, loaded: DataFrame, expression: str, identifier: str = "vec_id") -> int:
    """Number, in the order of ``path``, of the file to go on with: the last of the first files whose first row is in the store, which is
    loaded once more. ``expression`` is an identifier over filename and file_row_number."""
    from pyspark.sql import Window

    first = files.select("path", F.row_number().over(Window.orderBy("path")).alias("n"), F.col("path").alias("filename"), F.lit(0).cast("long").alias("file_row_number"))
    probed = first.select("n", F.expr(expression).alias("__id")).join(loaded.select(F.col(identifier).alias("__id"), F.lit(True).alias("held")).distinct(), "__id", "left")
    missing = probed.agg(F.min(F.when(F.col("held").isNull(), F.col("n"))).alias("m"), F.count(F.lit(1)).alias("n")).first()
    return max(0, (missing["m"] or missing["n"] + 1) - 2)


# --- embedding files ------------------------------------------------------------------------------------------------
KINDS = {"dense": "array<float>", "sparse": "struct<indices:array<int>,values:array<float>>", "multivector": "array<array<float>>"}


def write_embeddings(rows: DataFrame, outputs: dict[str, str], path: str, source: list[str], group_bytes: int | None = None, records: int | None = None) -> None:
    """Source columns and typed embedding columns (name -> dense, sparse or multivector; null embeddings keep their type) as Parquet.

    A name that is a source column too is an error. ``records`` is the most rows of a file.
    """
    if clash := sorted(set(outputs) & set(source)):
        raise ValueError(f"output columns {clash} are source columns too")
    typed = rows.select(*source, *[F.col(c).cast(KINDS[kind]).alias(c) for c, kind in outputs.items()])
    writer = typed.write.mode("overwrite").option("compression", "snappy")
    writer = writer.option("parquet.block.size", group_bytes) if group_bytes else writer
    (writer.option("maxRecordsPerFile", records) if records else writer).parquet(path)


def bucket_of(name: uuid.UUID, buckets: int) -> str:
    """A folder by the content: the first eight bytes of its hash modulo the number of folders, in three digits or more."""
    return f"{int.from_bytes(name.bytes[:8], 'big') % buckets:0{max(3, len(str(buckets - 1)))}d}"


def content_addressed(spark: SparkSession, path: str, buckets: int | None = None) -> list[str]:
    """Rename the Parquet files of a folder by their content (128-bit BLAKE2b as a UUID), into ``buckets`` folders if a number is given.

    Tasks hash the files piece by piece; the driver moves names, and no data, and returns the new ones. Equal files become one.
    """
    ship(spark)
    import pyarrow.fs

    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(s.getPath().toString() for s in fs.listStatus(fs_path(path)) if s.getPath().getName().endswith(".parquet"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name in batch.column(0).to_pylist():
                store, inner = pyarrow.fs.FileSystem.from_uri(arrow_path(name))
                digest = hashlib.blake2b(digest_size=16)
                with store.open_input_stream(inner) as f:
                    while piece := f.read(1 << 20):
                        digest.update(piece)
                out.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["name", "digest"])

    listing = spark.createDataFrame([(n,) for n in names], "name string").repartition(max(1, len(names)))
    moved = []
    for r in listing.mapInArrow(hashed, "name string, digest string").orderBy("name").toLocalIterator():  # a row for each file
        found = uuid.UUID(hex=r["digest"])
        folder = f"{path.rstrip('/')}/{bucket_of(found, buckets)}" if buckets else path.rstrip("/")
        fs.mkdirs(fs_path(folder))
        target = f"{folder}/{found}.parquet"
        if fs.exists(fs_path(target)):
            fs.delete(fs_path(r["name"]), False)
        else:
            fs.rename(fs_path(r["name"]), fs_path(target))
        moved.append(target)
    return moved


def write_series(samples: DataFrame, path: str, form: str = "csv") -> None:
    """Samples of a run in the order of t_s, with lists as texts in CSV."""
    rows = samples.repartitionByRange("t_s").sortWithinPartitions("t_s")
    if form == "csv":
        flat = [F.to_json(c).alias(c) if rows.schema[c].dataType.typeName() == "array" else F.col(c) for c in rows.columns]
        rows.select(*flat).write.mode("overwrite").option("header", True).csv(path)
    elif form == "jsonl":
        rows.write.mode("overwrite").json(path)
    else:
        raise ValueError("a series is written as csv or jsonl")


# --- the writer -----------------------------------------------------------------------------------------------------
def retryable(grpc: int | None = None, http: int | None = None) -> bool:
    """Whether a refused write may succeed later. Without a code or status the store was not reached, and it may."""
    if grpc is not None:
        return grpc not in FINAL_CODES
    return http is None or http in RETRY_STATUS


def backoff(attempt: int) -> float:
    """Seconds before attempt 1, 2 and so on: from a quarter second, doubled each time, at most 30."""
    return min(30.0, 0.25 * 2**attempt)


class Pace:
    """A bucket of tokens: ``per_second`` a second, as many at once."""

    def __init__(self, per_second: float, clock: Callable[[], float] = time.monotonic) -> None:
        self.rate, self.clock = per_second, clock
        self.tokens, self.at = per_second, clock()

    def wait(self, n: int) -> float:
        """Seconds to wait before n more."""
        now = self.clock()
        self.tokens = min(self.rate, self.tokens + (now - self.at) * self.rate) - n
        self.at = now
        return max(0.0, -self.tokens / self.rate)


_TOLD = "task int, batches bigint, points bigint, retries bigint, failed bigint, error string, lost string"


def pour(batched: DataFrame, send: Callable[[list[dict]], None], key: str, size: int, per_second: float | None = None, attempts: int = 5, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """task, batches, points, retries, failed, error, lost: send all rows of ``batched``, at most ``size`` of one key at a time.

    ``send`` writes a list of rows to a store by identifier, so that a task that runs again does no harm; an exception with
    ``retry = False`` fails the batch at once, another is tried again after ``backoff``. ``per_second`` is the rate of the whole job:
    each of the tasks that run at once gets its share. Rows are sorted by key within tasks and no batch mixes keys. A row for each
    task has its counters; and a row for each batch that failed has the error and the batch itself, as JSON, in ``lost``.
    """
    spark = batched.sparkSession
    ship(spark)
    share = per_second / max(1, min(spark.sparkContext.defaultParallelism, batched.rdd.getNumPartitions())) if per_second else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        task = context.partitionId() if context else 0
        pace, held = Pace(share) if share else None, []
        told = {"batches": 0, "points": 0, "retries": 0, "failed": 0}

        def flush() -> tuple | None:
            if pace and (wait := pace.wait(len(held))):
                sleep(wait)
            told["batches"] += 1
            for attempt in range(attempts):
                try:
                    send(list(held))
                    told["points"] += len(held)
                    break
                except Exception as e:
                    if not getattr(e, "retry", True) or attempt + 1 == attempts:
                        lost = (task, 0, 0, 0, 1, f"{type(e).__name__}: {e}", json.dumps(held, default=str))
                        held.clear()
                        return lost
                    told["retries"] += 1
                    sleep(backoff(attempt))
            held.clear()
            return None

        def row(values: tuple) -> pa.RecordBatch:
            kinds = [pa.int32(), *[pa.int64()] * 4, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [c.split()[0] for c in _TOLD.split(", ")])

        for batch in batches:
            for r in batch.to_pylist():
                if held and (len(held) == size or held[-1][key] != r[key]) and (lost := flush()):
                    yield row(lost)
                held.append(r)
        if held and (lost := flush()):
            yield row(lost)
        yield row((task, *told.values(), None, None))

    return batched.sortWithinPartitions(key).mapInArrow(run, _TOLD)


def lost_rows(told: DataFrame, schema: StructType | str) -> DataFrame:
    """The rows of failed batches, with their error; ``told`` is what ``pour`` returned, written to a table."""
    rows = told.filter(F.col("lost").isNotNull()).select("task", "error", F.explode(F.from_json("lost", f"array<{schema if isinstance(schema, str) else schema.simpleString()}>")).alias("r"))
    return rows.select("task", "error", "r.*")


class FolderSender:
    """Writes each batch of rows as a Parquet file in a folder, named by its content: sending a batch again changes nothing."""

    def __init__(self, folder: str) -> None:
        self.folder = arrow_path(folder)

    def __call__(self, rows: list[dict]) -> None:
        import pyarrow.fs
        import pyarrow.parquet as pq

        fs, root = pyarrow.fs.FileSystem.from_uri(self.folder)
        fs.create_dir(root, recursive=True)
        name = hashlib.blake2b(json.dumps(rows, sort_keys=True, default=str).encode(), digest_size=16).hexdigest()
        with fs.open_output_stream(f"{root}/{name}.parquet") as f:
            pq.write_table(pa.Table.from_pylist(rows), f)


def readable(spark: SparkSession, names: list[str], most_failed: int = 0) -> tuple[list[str], list[tuple[str, str]]]:
    """Parquet files whose footers can be read, and the others with their errors; more than ``most_failed`` of these are an error.

    Tasks open the files; what comes back is a row for each file that fails.
    """
    ship(spark)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs
        import pyarrow.parquet as pq

        for batch in batches:
            bad = []
            for name in batch.column(0).to_pylist():
                try:
                    store, inner = pyarrow.fs.FileSystem.from_uri(arrow_path(name))
                    with store.open_input_file(inner) as f:
                        pq.ParquetFile(f)
                except Exception as e:
                    bad.append((name, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array([b[i] for b in bad], pa.string()) for i in range(2)], ["name", "error"])

    listing = spark.createDataFrame([(n,) for n in names], "name string").repartition(max(1, min(len(names), 4 * spark.sparkContext.defaultParallelism)))
    bad = sorted((r["name"], r["error"]) for r in listing.mapInArrow(opened, "name string, error string").collect())
    if len(bad) > most_failed:
        raise ValueError(f"{len(bad)} of {len(names)} files cannot be read, {most_failed} may; first {bad[0][0]}: {bad[0][1]}")
    gone = {n for n, _ in bad}
    return [n for n in names if n not in gone], bad
