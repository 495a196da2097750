"""Tables of releases as files: bucketed by their key, and named by a manifest that is switched as a whole."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.tables import forget

#: Buckets of a written table, where no number is given; and the rows of a bucket that buckets_for reckons with.
BUCKETS = 64
BUCKET_ROWS = 50_000
_MANIFEST = "no long, name string, system string, version string, folder string, key string, buckets int, rows long, schema string"


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the last manifest that was written whole; none before the first."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    whole = [int(f.getPath().getName()) for f in fs.listStatus(fs_path) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))] if fs.exists(fs_path) else []
    return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest/{max(whole)}") if whole else spark.createDataFrame([], _MANIFEST)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, system, version, folder, key, buckets, rows) of what a path holds."""
    return _manifest(spark, path).drop("no", "schema")


def buckets_for(rows: int, least: int = 8) -> int:
    """Buckets of tables of so many rows in all: a task reads one bucket of all of them, so their number grows with the rows."""
    return max(least, -(-rows // BUCKET_ROWS))


def write_tables(tables: dict[str, DataFrame], path: str, system: str, version: str, keys: dict[str, str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Writes the tables of one version of a system below path and returns its manifest rows (name, rows).

    Each table goes to a folder of its own, in buckets of its key (code, ancestor, parent or source, where keys
    name no other) that are sorted by it; rows are counted as they are written. A new manifest then
    names the new folders instead of the version's earlier ones: other systems and versions are not touched,
    a reader sees the old tables or the new ones, and a write that fails changes nothing. Of two writers at once, the
    one that is later to write its manifest fails. See drop_unlisted for folders that no manifest names any more.
    """
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        key = (keys or {}).get(name) or next((c for c in ("code", "ancestor", "parent", "source") if c in df.columns), df.columns[0])
        folder = f"{path}/{name}/{uuid.uuid4().hex}"
        counted = Observation()
        entry = f"written_{uuid.uuid4().hex}"
        # dealt as the buckets are, so that each is one file
        dealt = df.observe(counted, F.count(F.lit(1)).alias("rows")).repartition(buckets, key)
        dealt.write.format("parquet").option("path", folder).bucketBy(buckets, key).sortBy(key).saveAsTable(entry)
        spark.sql(f"DROP TABLE {entry}")  # the files stay: the table is external
        rows.append((name, system, version, folder, key, buckets, counted.get["rows"], df.schema.json()))
    held = [tuple(r) for r in _manifest(spark, path).collect()]  # a row a table and version
    kept = [r[1:] for r in held if (r[2], r[3]) != (system, version) or r[1] not in tables]
    no = max((r[0] for r in held), default=0) + 1
    spark.createDataFrame([(no, *r) for r in [*kept, *rows]], _MANIFEST).coalesce(1).write.mode("error").parquet(f"{path}/manifest/{no}")
    return spark.createDataFrame([(r[0], r[6]) for r in rows], "name string, rows long")


def read_tables(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of all systems and versions that path holds, with the columns _system and _version.

    It is read in the buckets that it was written in, so that joins and groupings by its key need no exchange on its side. Versions
    written with other columns, another key or other buckets are read as well, but then without that.
    """
    parts = [r for r in _manifest(spark, path).filter(F.col("name") == name).collect()]
    if not parts:
        raise ValueError(f"{path} holds no table {name}")
    shapes: dict[tuple, list] = {}
    for r in parts:
        shapes.setdefault((r["schema"], r["key"], r["buckets"]), []).append(r)
    out = None
    for (schema, key, buckets), rows in shapes.items():
        entry = f"read_{uuid.uuid4().hex}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in T.StructType.fromJson(json.loads(schema)))
        literal = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
        spark.sql(f"CREATE TABLE {entry} ({columns}, _system STRING, _version STRING) USING parquet PARTITIONED BY (_system, _version) CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION {literal(f'{path}/{name}')}")
        for r in rows:
            spark.sql(f"ALTER TABLE {entry} ADD PARTITION (_system = {literal(r['system'])}, _version = {literal(r['version'])}) LOCATION {literal(r['folder'])}")
        df = spark.table(entry)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def drop_unlisted(spark: SparkSession, path: str, name: str) -> int:
    """Deletes the folders of a table that the manifest does not name, when no reader needs them any more; how many there were."""
    listed = {r["folder"].rsplit("/", 1)[1] for r in _manifest(spark, path).filter(F.col("name") == name).collect()}
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    found = [f.getPath() for f in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
    gone = [p for p in found if p.getName() not in listed]
    for p in gone:
        forget(spark, p.toString())
    return len(gone)
