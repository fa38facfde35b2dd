"""Apply any model to every row, with failures kept as data."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paracorpus.functions import text as T


def batch_predict(
    df: DataFrame,
    make_predictor: Callable[[], Callable[[object], str]],
    column: str = "audio",
    out: str = "hypothesis",
    reference: str | None = None,
) -> DataFrame:
    """Add `out` (string, stripped) and `error` (string, null when the row went well).

    `make_predictor` runs once per task and returns the function for one value, so a model is
    loaded once. A row that raises gets its error and the batch goes on. With `reference`, rows
    whose reference is null or empty are dropped before the model sees them.
    """
    if reference:
        df = df.where(~T.is_blank(reference, stripped=False))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        predict = make_predictor()
        for batch in batches:
            texts, errors = [], []
            for value in batch:
                try:
                    texts.append(str(predict(value.as_py())).strip())
                    errors.append(None)
                except Exception as problem:  # one bad row must not end the run
                    texts.append(None)
                    errors.append(f"{type(problem).__name__}: {problem}")
            yield pa.StructArray.from_arrays(
                [pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["text", "error"]
            )

    # Only `column` travels to Python; the other columns stay as they are.
    predicted = F.arrow_udf(run, "struct<text:string,error:string>")(column)
    return (
        df.withColumn("_predicted", predicted)
        .withColumns({out: F.col("_predicted.text"), "error": F.col("_predicted.error")})
        .drop("_predicted")
    )


def slice_bounds(slices: int) -> list[tuple[int, int]]:
    """Ranges of 64-bit hashes, of equal width, that together are all of them."""
    edges = [(i << 64) // slices - (1 << 63) for i in range(slices + 1)]
    return [(lo, hi - 1) for lo, hi in zip(edges, edges[1:])]


def predict_in_slices(
    df: DataFrame,
    make_predictor: Callable[[], Callable[[object], str]],
    folder: str,
    column: str = "audio",
    out: str = "hypothesis",
    reference: str | None = None,
    slices: int = 16,
) -> DataFrame:
    """`batch_predict`, written slice by slice to `folder` and read from there: the model sees a row once.

    Rows are dealt to slices by a hash of all their columns (none may be a map) and written as `folder`/input, partitioned
    by slice, so that a slice reads only its own rows. Each slice is one committed write; what is complete in
    `folder` is not done again, so a run that was stopped goes on where it was.

    A row that raises gets its error. A row that takes the worker process with it (a crash, the memory)
    fails its slice's job; such a slice is halved by hash, and halved again, until the rows that cannot be done are alone.
    They get an error and a null `out`, all others are done: some 60 further jobs for each such row at
    most. Rows whose hashes are equal, as those of repeated rows, cannot be parted. A model that cannot be loaded
    stops the run before any row is tried.
    """
    spark = df.sparkSession
    if reference:
        df = df.where(~T.is_blank(reference, stripped=False))
    bounds = slice_bounds(slices)
    source = f"{folder}/input"
    if not _complete(spark, source):
        number = sum((F.col("_hash") >= lo).cast("int") for lo, _ in bounds[1:]) if slices > 1 else F.lit(0)
        keyed = df.withColumn("_hash", F.xxhash64(*df.columns)).withColumn("_slice", number)
        keyed.write.mode("overwrite").partitionBy("_slice").parquet(source)
    schema = _columns(df)
    rows = spark.read.schema(f"{schema}, _hash bigint, _slice int").parquet(source)
    columns = [*df.columns, out, "error"]
    written: list[str] = []

    def place(lo: int, hi: int) -> str:
        return f"{folder}/slices/{lo + (1 << 63):016x}-{hi + (1 << 63):016x}"

    def lost(part: DataFrame, problem: Exception) -> DataFrame:
        said = (str(problem).strip().splitlines() or [""])[0][:300]
        return part.withColumns({out: F.lit(None).cast("string"), "error": F.lit(f"{type(problem).__name__}: {said}")})

    def run(number: int, lo: int, hi: int) -> None:
        path = place(lo, hi)
        if _complete(spark, path):
            written.append(path)
            return
        part = rows.where((F.col("_slice") == number) & F.col("_hash").between(lo, hi))
        if not _exists(spark, f"{path}.halved"):
            plain = part.drop("_hash", "_slice")
            try:
                batch_predict(plain, make_predictor, column, out).select(*columns).write.mode("overwrite").parquet(path)
            except Exception as problem:
                if len(part.select("_hash").distinct().limit(2).collect()) < 2:
                    lost(plain, problem).select(*columns).write.mode("overwrite").parquet(path)
            if _complete(spark, path):
                written.append(path)
                return
            _mark(spark, f"{path}.halved")
        middle = (lo + hi) // 2
        run(number, lo, middle)
        run(number, middle + 1, hi)

    _load_once(spark, make_predictor)
    for number, (lo, hi) in enumerate(bounds):
        run(number, lo, hi)
    return spark.read.schema(f"{schema}, `{out}` string, error string").parquet(*written)


def _columns(df: DataFrame) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in df.dtypes)


def _load_once(spark: SparkSession, make_predictor: Callable[[], object]) -> None:
    """Raise what loading the model raises in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_predictor()
        yield from batches

    spark.range(1).mapInArrow(run, "id long").collect()


def _path(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _exists(spark: SparkSession, path: str) -> bool:
    system, place = _path(spark, path)
    return system.exists(place)


def _complete(spark: SparkSession, path: str) -> bool:
    return _exists(spark, f"{path}/_SUCCESS")


def _mark(spark: SparkSession, path: str) -> None:
    system, place = _path(spark, path)
    system.mkdirs(place)


def predictions(df: DataFrame, id_col: str = "id") -> DataFrame:
    """The prediction set: (id, reference, hypothesis, error)."""
    return df.select(F.col(id_col).alias("id"), "reference", "hypothesis", "error")
