"""Sources and sinks: quotes by instrument and day, parameter files, reports. Everything goes through Spark's readers and
writers, so any file system that Spark knows will do."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JSU_SCHEMA = "tte_ms double, a double, b double, loc double, scale double"
FOURIER_SCHEMA = "n_harmonics int, coef array<double>"
LEVEL1 = {"bid": "p_bid_0_price", "bid_size": "p_bid_0_size", "ask": "p_ask_0_price", "ask_size": "p_ask_0_size"}


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir. Where none is set a local master, as in
    tests, gets one of its own for the session; a cluster has to name one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("quantide.scratch.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("quantide.scratch.dir", root)
    return f"{root}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """df written once and read again, and where; the caller discards it when nothing reads it any more."""
    df.write.option("compression", "zstd").parquet(path := scratch(df.sparkSession))
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame) -> DataFrame:
    """df written once and read again, so that what follows doesn't compute it anew. It lives as long as the shared folder:
    a query's result reads it when it runs."""
    return written(df)[0]


def discard(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def read_level1(spark: SparkSession, path: str, start: str, end: str, instruments: list[str]) -> DataFrame:
    """Quotes of a table that write_level1() made; instruments and days prune folders, the times prune row groups."""
    day = F.col("day").between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))
    time = F.col("received_time").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))
    return spark.read.parquet(path).filter(F.col("inst").isin(instruments) & day & time).drop("day")


def write_level1(quotes: DataFrame, path: str) -> None:
    """One folder for each instrument and day, in one job. Rows of a day are dealt over a few tasks, so one busy
    instrument doesn't end in one file or task."""
    salt = F.pmod(F.xxhash64("received_time"), F.lit(8))
    own = quotes.withColumnsRenamed(LEVEL1).withColumn("day", F.to_date("received_time"))
    own.repartition("inst", "day", salt).sortWithinPartitions("inst", "day", "received_time").write.partitionBy("inst", "day").parquet(path)


def instruments(spark: SparkSession, inputs: dict[str, str]) -> DataFrame:
    """{prefix: path} of level-1 files as one long table; at least two."""
    if len(inputs) < 2:
        raise ValueError("at least two instruments are needed")
    parts = [spark.read.parquet(p).withColumn("inst", F.lit(k)) for k, p in inputs.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pull(spark: SparkSession, inputs: dict[str, str], path: str, at_once: int = 8) -> DataFrame:
    """Each input {instrument: path} read and written below `path` on its own, a few at once; a report of (inst, rows, error).

    A missing or corrupt input, or one without a column that is needed, is a row with its error, and the others go on."""
    from concurrent.futures import ThreadPoolExecutor

    needed = ["received_time", "event_id", *LEVEL1]

    def one(inst: str) -> tuple[str, int | None, str | None]:
        try:
            own = required(spark.read.parquet(inputs[inst]), needed).select(*needed)
            write_level1(own.withColumn("inst", F.lit(inst)), f"{path}/{inst}")
            return inst, spark.read.parquet(f"{path}/{inst}").count(), None
        except Exception as e:  # whatever an input's reader raises is its result
            return inst, None, f"{type(e).__name__}: {str(e).splitlines()[0][:300]}"

    with ThreadPoolExecutor(at_once) as pool:
        return spark.createDataFrame(list(pool.map(one, inputs)), "inst string, rows bigint, error string")


def read_jsu(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=JSU_SCHEMA)


def read_fourier(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema=FOURIER_SCHEMA, multiLine=True)


def found_mid(df: DataFrame, to: str = "mid_price") -> DataFrame:
    """df with the mid of whatever columns are called best_bid_price and best_ask_price, or else of the first ones whose names hold
    "bid" and "price", "ask" and "price", in any case; a table without such columns is an error."""
    names = {c.lower(): c for c in reversed(df.columns)}

    def column(side: str) -> str | None:
        return names.get(f"best_{side}_price") or next((c for c in df.columns if side in c.lower() and "price" in c.lower()), None)

    bid, ask = column("bid"), column("ask")
    if bid is None or ask is None:
        raise ValueError(f"no bid and ask price among: {', '.join(df.columns)}")
    return df.withColumn(to, (df[f"`{bid}`"] + df[f"`{ask}`"]) / 2)


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, or an error that names the columns that it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def horizon_seconds(label: str) -> int:
    """'15m' is 900."""
    unit = {"s": 1, "m": 60, "h": 3600, "d": 86400}
    if not label[:-1].isdigit() or label[-1] not in unit:
        raise ValueError(f"not a horizon: {label!r}")
    return int(label[:-1]) * unit[label[-1]]
