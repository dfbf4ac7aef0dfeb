"""Tables kept as snapshots: folders of rows by bucket, and a manifest whose last version names those that are valid."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def last_version(spark: SparkSession, path: str) -> int:
    """Number of the last manifest; 0 where there is none."""
    fs, at = _fs(spark, f"{path}/manifest")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return max((int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit()), default=0)


def entries(spark: SparkSession, path: str, version: int | None = None) -> list[dict]:
    """The folders of a version (the last one by default), with what was noted of them."""
    version = last_version(spark, path) if version is None else version
    return [json.loads(r["value"]) for r in spark.read.text(f"{path}/manifest/v{version}").collect()] if version else []


def commit(spark: SparkSession, path: str, made: list[dict], after: int) -> int:
    """Puts a manifest with the given folders in place as the version next to `after`. It is written aside and renamed, so readers see the old or the new one; if another writer came first, this fails."""
    aside = f"{path}/manifest/.new-{uuid.uuid4().hex}"
    spark.createDataFrame([(json.dumps(e),) for e in made], "value string").coalesce(1).write.text(aside)
    fs, source = _fs(spark, aside)
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/v{after + 1}")
    if fs.exists(target) or not fs.rename(source, target):
        raise RuntimeError(f"{path} has a version {after + 1} already; read it again and repeat")
    return after + 1


def read_snapshot(spark: SparkSession, path: str, version: int | None = None, **noted: object) -> DataFrame | None:
    """The rows of a version, of the folders with the given notes; None where there are none."""
    folders = [e["folder"] for e in entries(spark, path, version) if all(e.get(k) == v for k, v in noted.items())]
    return spark.read.parquet(*[f"{path}/{f}" for f in folders]) if folders else None


def bucket_of(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def read_filter(spark: SparkSession, path: str, version: int | None = None, **noted: object) -> tuple[DataFrame | None, int]:
    """The key filter of a version's folders with the given notes, whose parts are buckets, and the number of buckets; None where a folder has no filter."""
    mine = [e for e in entries(spark, path, version) if all(e.get(k) == v for k, v in noted.items())]
    if not mine or not all(e.get("filter") for e in mine):
        return None, 0
    return spark.read.parquet(*[f"{path}/{e['filter']}" for e in mine]), mine[0]["buckets"]


def upsert(new: DataFrame, path: str, key: str = "id", buckets: int = 64, filter_keys: dict[str, str] | None = None, **noted: object) -> int:
    """Puts rows over those of the same key in the snapshot at `path` (under the given notes) and returns its new version.

    Only buckets that hold a key of `new` are read and written again, in one job and one new folder a bucket; the others keep their files. The manifest is swapped at the end: a failure before
    that leaves the old snapshot as it was. Applying the same rows twice gives the same rows. Of several new rows of one key the least by all columns stays. The number of buckets is fixed by the first call.
    filter_keys: names and expressions of what rows are known by; each bucket then has a key filter over them beside its rows, written again with them.
    """
    from loomline.functions.scratch import stored
    from loomline.operators.index import upsert_by_id
    from loomline.operators.membership import key_filter

    spark = new.sparkSession
    version = last_version(spark, path)
    held = entries(spark, path, version)
    mine = {e["bucket"]: e for e in held if all(e.get(k) == v for k, v in noted.items())}
    buckets = next(iter(mine.values()))["buckets"] if mine else buckets
    rows = stored(new.withColumn("_bucket", bucket_of(key, buckets)), "upsert")
    touched = [r["_bucket"] for r in rows.select("_bucket").distinct().collect()]  # numbers of buckets
    if not touched:
        return version
    old = [f"{path}/{mine[b]['folder']}" for b in touched if b in mine]
    rows = upsert_by_id(spark.read.parquet(*old).withColumn("_bucket", bucket_of(key, buckets)), rows, key) if old else upsert_by_id(rows.limit(0), rows, key)
    run = f"data/{uuid.uuid4().hex}"
    rows.repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(f"{path}/{run}")
    changed = {b: {**noted, "bucket": b, "buckets": buckets, "folder": f"{run}/_bucket={b}"} for b in touched}
    if filter_keys:
        made = spark.read.parquet(f"{path}/{run}").selectExpr("_bucket", *[f"{e} AS {name}" for name, e in filter_keys.items()])
        key_filter(made, [*filter_keys], F.col("_bucket")).withColumn("_bucket", F.col("part")).repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(f"{path}/{run}-filter")
        keyed = {r["_bucket"] for r in spark.read.parquet(f"{path}/{run}-filter").select("_bucket").distinct().collect()}  # numbers of buckets
        for b in keyed:
            changed[b]["filter"] = f"{run}-filter/_bucket={b}"
    kept = [e for e in held if not (e.get("bucket") in changed and e in mine.values())]
    return commit(spark, path, kept + list(changed.values()), version)
