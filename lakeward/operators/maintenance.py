"""Rewrites, compaction, snapshots and materialized views of catalog tables.

There is one kind of table: a Parquet table of the catalog, whoever made it.
Appends add files to it. A rewrite writes new files beside the old ones and then
points the table, or only the partitions it touched, at them (``ALTER TABLE ..
SET LOCATION``), so the input of a rewrite is never overwritten, a query that is
running keeps its files, and properties, partitions, buckets and sort order of
the table stay. Files that no longer belong to a table are kept for running
queries and snapshots until they are expired.

The unit of a rewrite is the partition: an update or delete writes the
partitions that hold matching rows, and a table without partitions as a whole.
Pointing is one step per table or partition, so a rewrite of several partitions
becomes visible partition by partition.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from lakeward.session import delete_path
from lakeward.sources.files import file_sizes
from lakeward.sources.tables import quoted

TARGET_FILE_BYTES = 128 * 1024 * 1024
SNAPSHOT_SUFFIX = "_snapshots"
_REFRESHED, _SUPERSEDED = "lakeward.refreshed", "lakeward.superseded"
_LOCAL = "^file:/+"  # local files are written with one slash or three
_NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"
_PARTITION_FOLDERS = re.compile(r"(/[^/=]+=[^/]*)+/?$")


def text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def named(table: str) -> str:
    """A table name with every part quoted for SQL; quoted parts stay as they are."""
    parts = re.findall(r"`(?:[^`]|``)*`|[^.`]+", table)
    return ".".join(p if p.startswith("`") else quoted(p) for p in parts)


# ---------------------------------------------------------------- layout


@dataclass(frozen=True)
class Layout:
    """How the files of a table are laid out."""

    partition_by: tuple[str, ...] = ()
    buckets: int = 0
    bucket_by: tuple[str, ...] = ()
    sort_by: tuple[str, ...] = ()

    def writer(self, df: DataFrame):
        writer = df.write
        if self.partition_by:
            writer = writer.partitionBy(*self.partition_by)
        if self.buckets:
            writer = writer.bucketBy(self.buckets, *self.bucket_by)
            if self.sort_by:
                writer = writer.sortBy(*self.sort_by)
        return writer


def _details(spark: SparkSession, table: str) -> dict[str, str]:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {named(table)}").collect()
    start = next((i for i, r in enumerate(rows) if r.col_name == "# Detailed Table Information"), len(rows))
    return {r.col_name: r.data_type for r in rows[start + 1 :]}


def layout_of(spark: SparkSession, table: str) -> Layout:
    """Partition, bucket and sort columns of a table."""
    found = _details(spark, table)

    def listed(key: str) -> tuple[str, ...]:
        return tuple(re.findall(r"`((?:[^`]|``)*)`", found.get(key, "")))

    return Layout(
        tuple(c.name for c in spark.catalog.listColumns(named(table)) if c.isPartition),
        int(found.get("Num Buckets", 0)),
        listed("Bucket Columns"),
        listed("Sort Columns"),
    )


def location_of(spark: SparkSession, table: str) -> str:
    return _details(spark, table)["Location"]


def table_property(spark: SparkSession, table: str, key: str) -> str | None:
    found = spark.sql(f"SHOW TBLPROPERTIES {named(table)}").filter(F.col("key") == key).first()
    return found.value if found else None


def set_properties(spark: SparkSession, table: str, properties: Mapping[str, str]) -> None:
    if properties:
        pairs = ", ".join(f"{text(k)} = {text(v)}" for k, v in properties.items())
        spark.sql(f"ALTER TABLE {named(table)} SET TBLPROPERTIES ({pairs})")


def plain_path(uri: str) -> str:
    """A file's path as file systems know it, from Spark's encoded form."""
    return unquote(re.sub(_LOCAL, "file:/", uri))


def listed_path(path: str) -> str:
    """The same for a path that a listing gave, which is not encoded."""
    return re.sub(_LOCAL, "file:/", path)


def data_files(spark: SparkSession, table: str) -> dict[str, int]:
    """Files that belong to a table now, as ``file_path`` names them, with their lengths.

    File names are metadata: their number follows the files, not the rows.
    """
    files = {plain_path(f): re.sub(_LOCAL, "file:/", f) for f in spark.table(named(table)).inputFiles()}
    folders = sorted({f.rsplit("/", 1)[0] for f in files})
    if not folders:
        return {}
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folders)
    lengths = {listed_path(r.path): r.length for r in listing.select("path", "length").toLocalIterator()}
    return {uri: lengths[f] for f, uri in files.items() if f in lengths}


def _values_of(path: str, columns: Sequence[str]) -> tuple[str | None, ...]:
    """Partition values in the path of a file, as text."""
    found = dict(re.findall(r"([^/=]+)=([^/]*)(?=/)", path))
    values = [unquote(found[c]) for c in columns]
    return tuple(None if v == _NULL_PARTITION else v for v in values)


# ---------------------------------------------------------------- writing


def publish(
    df: DataFrame,
    name: str,
    partition_by: Sequence[str] = (),
    properties: Mapping[str, str] | None = None,
    layout: Layout | None = None,
) -> str:
    """Make ``df`` the content of the table ``name``; returns the location of its files.

    An existing table keeps its properties, and its layout unless another one
    is given. Where columns or layout change, the catalog entry is replaced;
    otherwise only its location is, and readers see the old or the new rows.
    The frame may read the table itself.
    """
    spark = df.sparkSession
    if not spark.catalog.tableExists(named(name)):
        (layout or Layout(tuple(partition_by))).writer(df).saveAsTable(named(name))
        set_properties(spark, name, properties or {})
        return location_of(spark, name)
    old, gone = layout_of(spark, name), _own_folders(spark, name)
    # A layout by columns that the new rows do not have cannot stay.
    fits = {*old.partition_by, *old.bucket_by, *old.sort_by} <= set(df.columns)
    wanted = layout or (Layout(tuple(partition_by)) if partition_by else old if fits else Layout())
    target = _write_aside(df, name, wanted)
    columns = [(f.name.lower(), f.dataType) for f in spark.table(named(name)).schema.fields]
    if wanted != old or columns != _stored(df, wanted):
        kept = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {named(name)}").collect()}
        _forget(spark, name)
        _entry(spark, df, name, wanted, target)
        properties = {**{k: v for k, v in kept.items() if not k.startswith("spark.")}, **(properties or {})}
    elif old.partition_by:
        _point_partitions(spark, name, old, _partitions(spark, name), target)
    else:
        spark.sql(f"ALTER TABLE {named(name)} SET LOCATION {text(target)}")
    set_properties(spark, name, properties or {})
    _remember(spark, name, gone)
    return target


def _stored(df: DataFrame, layout: Layout) -> list:
    """Names and types in the order of a stored table: partition columns last."""
    fields = {f.name: (f.name.lower(), f.dataType) for f in df.schema.fields}
    last = [fields[c] for c in layout.partition_by if c in fields]
    return [v for n, v in fields.items() if n not in layout.partition_by] + last


def _write_aside(df: DataFrame, name: str, layout: Layout) -> str:
    """Write files for a table beside its present ones."""
    spark = df.sparkSession
    base = re.sub(r"__[0-9a-f]{12}$", "", location_of(spark, name).rstrip("/"))
    target, entry = f"{base}__{uuid.uuid4().hex[:12]}", f"{_namespace(name)}aside_{uuid.uuid4().hex[:12]}"
    # A table with a path of its own is external: dropping its entry leaves the files.
    layout.writer(df).option("path", target).saveAsTable(named(entry))
    spark.sql(f"DROP TABLE {named(entry)}")
    return target


def _entry(spark: SparkSession, df: DataFrame, name: str, layout: Layout, target: str) -> None:
    """Create the catalog entry for files that are there."""
    columns = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in df.schema.fields)
    clauses = ""
    if layout.partition_by:
        clauses += f" PARTITIONED BY ({', '.join(quoted(c) for c in layout.partition_by)})"
    if layout.buckets:
        order = f" SORTED BY ({', '.join(quoted(c) for c in layout.sort_by)})" if layout.sort_by else ""
        clauses += f" CLUSTERED BY ({', '.join(quoted(c) for c in layout.bucket_by)}){order} INTO {layout.buckets} BUCKETS"
    spark.sql(f"CREATE TABLE {named(name)} ({columns}) USING parquet{clauses} LOCATION {text(target)}")
    if layout.partition_by:
        spark.sql(f"MSCK REPAIR TABLE {named(name)}")


def _forget(spark: SparkSession, name: str) -> None:
    """Drop a catalog entry but none of its files: it points nowhere when it goes."""
    nowhere = f"{location_of(spark, name).rstrip('/')}__nowhere_{uuid.uuid4().hex[:12]}"
    columns = layout_of(spark, name).partition_by
    for values in _partitions(spark, name) if columns else ():
        spark.sql(f"ALTER TABLE {named(name)} PARTITION ({_spec(columns, values)}) SET LOCATION {text(nowhere)}")
    spark.sql(f"ALTER TABLE {named(name)} SET LOCATION {text(nowhere)}")
    spark.sql(f"DROP TABLE {named(name)}")


def _namespace(name: str) -> str:
    return name.rpartition(".")[0] + "." if "." in name else ""


def _partitions(spark: SparkSession, name: str) -> list[tuple[str | None, ...]]:
    """Values of all partitions, as text."""
    columns = layout_of(spark, name).partition_by
    return [_values_of(f"/{r.partition}/", columns) for r in spark.sql(f"SHOW PARTITIONS {named(name)}").collect()]


def _folder(base: str, columns: Sequence[str], values: Sequence[str | None]) -> str:
    """Folder of a partition, with the characters encoded that a folder's name cannot have."""
    shown = (_NULL_PARTITION if v is None else quote(v, safe=" !$&()+,-.;<>@_`|~") for v in values)
    return base + "".join(f"/{c}={v}" for c, v in zip(columns, shown))


def _spec(columns: Sequence[str], values: Sequence[str | None]) -> str:
    return ", ".join(f"{quoted(c)} = {'null' if v is None else text(v)}" for c, v in zip(columns, values))


def _point_partitions(
    spark: SparkSession, name: str, layout: Layout, touched: Sequence[tuple[str | None, ...]], target: str
) -> None:
    """Point partitions at the folders written below ``target``; those without one are empty, new ones come."""
    columns, before = layout.partition_by, set(_partitions(spark, name))
    folders = {
        _values_of(p, columns): p.rsplit("/", 1)[0]
        for p in (listed_path(r.path) for r in file_sizes(spark, target).select("path").toLocalIterator())
    }
    for values in touched:
        # A partition without rows points at a folder that is not there: dropping
        # it would delete the files of queries and snapshots, and an append would
        # find the old files under its usual place.
        folder = folders.get(values) or _folder(target, columns, values)
        spark.sql(f"ALTER TABLE {named(name)} PARTITION ({_spec(columns, values)}) SET LOCATION {text(folder)}")
    for values, folder in folders.items():
        if values in touched:
            continue
        if values not in before:
            spark.sql(f"ALTER TABLE {named(name)} ADD IF NOT EXISTS PARTITION ({_spec(columns, values)}) LOCATION {text(folder)}")
        else:  # rows moved into a partition that was not touched
            order = spark.table(named(name)).columns
            rows = spark.read.option("basePath", target).schema(spark.table(named(name)).schema).parquet(folder)
            rows.select(*[quoted(c) for c in order]).write.insertInto(named(name))


def _own_folders(spark: SparkSession, name: str) -> list[str]:
    """Folders that hold files of a table, its partition folders taken together."""
    files = [plain_path(f) for f in spark.table(named(name)).inputFiles()]
    return sorted({_PARTITION_FOLDERS.sub("", f.rsplit("/", 1)[0]) for f in files} | {listed_path(location_of(spark, name))})


def _remember(spark: SparkSession, name: str, gone: Sequence[str]) -> None:
    """Note the folders that a rewrite has left, at least in part."""
    before = json.loads(table_property(spark, name, _SUPERSEDED) or "[]")
    set_properties(spark, name, {_SUPERSEDED: json.dumps(sorted({*before, *gone}))})
    spark.sql(f"REFRESH TABLE {named(name)}")


def expire_versions(spark: SparkSession, name: str) -> list[str]:
    """Delete the files that rewrites left and no snapshot refers to, once their readers are done.

    Returns the folders that were deleted, or thinned out where present files
    of the table or of a snapshot still lie in them.
    """
    left = json.loads(table_property(spark, name, _SUPERSEDED) or "[]")
    used = {plain_path(f) for f in spark.table(named(name)).inputFiles()}
    here = listed_path(location_of(spark, name))
    snapshots = f"{name}{SNAPSHOT_SUFFIX}"
    if spark.catalog.tableExists(named(snapshots)):
        paths = spark.table(named(snapshots)).where("path is not null").select("path").distinct()
        used |= {plain_path(r.path) for r in paths.toLocalIterator()}
    done, remaining = [], []
    for folder in left:
        if not _exists(spark, folder):
            continue
        files = [listed_path(r.path) for r in file_sizes(spark, folder).select("path").toLocalIterator()]
        stale = [f for f in files if f not in used]
        if len(stale) == len(files) and folder != here:
            delete_path(spark, folder)
            done.append(folder)
        else:
            for f in stale:
                delete_path(spark, f)
            if stale:
                done.append(folder)
            remaining.append(folder)
    set_properties(spark, name, {_SUPERSEDED: json.dumps(remaining)})
    return sorted(done)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


# ---------------------------------------------------------------- update and delete


def _in_partitions(schema: T.StructType, columns: Sequence[str], touched: Sequence[Sequence[str | None]]) -> Column:
    """Whether a row lies in one of the partitions; a filter that prunes."""
    inside = F.lit(False)
    for values in touched:
        each = F.lit(True)
        for c, v in zip(columns, values):
            each &= F.col(quoted(c)).isNull() if v is None else F.col(quoted(c)) == F.lit(v).cast(schema[c].dataType)
        inside |= each
    return inside


def _rewrite(spark: SparkSession, name: str, affected: Column, change: Callable[[DataFrame], DataFrame]) -> int:
    """Write the partitions with matching rows anew; returns how many rows match."""
    layout = layout_of(spark, name)
    columns = layout.partition_by
    if not columns:
        seen = Observation()
        rows = spark.table(named(name)).observe(seen, F.count_if(affected).alias("affected"))
        publish(change(rows), name)
        return seen.get["affected"]
    table = spark.table(named(name))
    # One row per partition with matching rows.
    counted = (
        table.filter(affected).groupBy(*[F.col(quoted(c)).cast("string").alias(f"_p{i}") for i, c in enumerate(columns)])
        .agg(F.count(F.lit(1)).alias("_n")).collect()
    )
    if counted:
        touched = [tuple(r)[:-1] for r in counted]
        _replace_partitions(spark, name, layout, touched, change(table.filter(_in_partitions(table.schema, columns, touched))))
    return sum(r["_n"] for r in counted)


def _replace_partitions(
    spark: SparkSession, name: str, layout: Layout, touched: Sequence[tuple[str | None, ...]], rows: DataFrame
) -> None:
    gone = _own_folders(spark, name)
    _point_partitions(spark, name, layout, touched, _write_aside(rows, name, layout))
    _remember(spark, name, gone)


def replace_partition(df: DataFrame, name: str, values: Mapping[str, str]) -> None:
    """Make ``df`` the content of one partition of a partitioned table, by the names of columns."""
    spark = df.sparkSession
    layout = layout_of(spark, name)
    key = tuple(values[c] for c in layout.partition_by)
    columns = [F.col(quoted(c)) for c in spark.table(named(name)).columns]
    touched = [key] if key in _partitions(spark, name) else []
    _replace_partitions(spark, name, layout, touched, df.select(columns))


def update_rows(spark: SparkSession, name: str, where: Column, values: Mapping[str, Column]) -> int:
    """``UPDATE name SET ... WHERE ...``; rows where the condition is null stay.

    Writes the partitions with matching rows (a table without partitions as a
    whole), so collect many changes into one condition; returns the number of
    rows changed.
    """
    types = {f.name: f.dataType for f in spark.table(named(name)).schema.fields}

    def change(rows: DataFrame) -> DataFrame:
        return rows.withColumns(
            {n: F.when(where, v.cast(types[n])).otherwise(F.col(quoted(n))) for n, v in values.items()}
        )

    return _rewrite(spark, name, where, change)


def delete_rows(spark: SparkSession, name: str, where: Column) -> int:
    """``DELETE FROM name WHERE ...``; rows where the condition is null stay."""
    return _rewrite(spark, name, where, lambda rows: rows.filter(~F.coalesce(where, F.lit(False))))


# ---------------------------------------------------------------- compaction


def packed(sizes: Iterable[int], target: int) -> int:
    """Files that are left when files of these sizes are packed up to the target, largest first."""
    bins, room = 0, 0
    for size in sorted(sizes, reverse=True):
        if size > room:
            bins, room = bins + 1, target
        room -= size
    return bins


def compact(spark: SparkSession, name: str, target_bytes: int = TARGET_FILE_BYTES) -> bool:
    """Merge small files of a table into files of about ``target_bytes``.

    False, without a rewrite, where packing whole files saves none. Of a
    partitioned table only the partitions in which it does are written. A table
    without partitions needs no shuffle: the scan packs its files into splits
    and every task writes one. Bucketed tables are left alone, their number of
    files is part of their layout.
    """
    layout = layout_of(spark, name)
    if layout.buckets:
        return False
    sizes = data_files(spark, name)
    if not layout.partition_by:
        if packed(sizes.values(), target_bytes) >= len(sizes):
            return False
        publish(_packing_session(spark, max(target_bytes, *sizes.values())).table(named(name)), name)
        spark.sql(f"REFRESH TABLE {named(name)}")  # this session remembers the old files
        return True
    by_partition: dict[tuple[str | None, ...], list[str]] = {}
    for uri in sizes:
        by_partition.setdefault(_values_of(plain_path(uri), layout.partition_by), []).append(uri)
    touched = [v for v, files in by_partition.items() if packed([sizes[f] for f in files], target_bytes) < len(files)]
    if not touched:
        return False
    placed = [(f, b) for v in touched for f, b in _bins(by_partition[v], sizes, target_bytes).items()]
    table = spark.table(named(name))
    bins = spark.createDataFrame(placed, "_f string, _bin int")  # a row per file
    rows = table.filter(_in_partitions(table.schema, layout.partition_by, touched))
    # A left join: whatever a file is called, its rows are written.
    rows = rows.withColumn("_f", F.regexp_replace("_metadata.file_path", _LOCAL, "file:/")).join(bins, "_f", "left")
    # All rows of a bin meet in one task, which writes one file for it.
    count = len({(_values_of(plain_path(f), layout.partition_by), b) for f, b in placed})
    dealt = rows.repartition(count, *[quoted(c) for c in layout.partition_by], "_bin").select(*[quoted(c) for c in table.columns])
    _replace_partitions(spark, name, layout, touched, dealt)
    return True


def _bins(files: Sequence[str], sizes: Mapping[str, int], target: int) -> dict[str, int]:
    """The bin of each file, as ``packed`` counts them."""
    out, at, room = {}, -1, 0
    for f in sorted(files, key=lambda f: (-sizes.get(f, 0), f)):
        if sizes.get(f, 0) > room:
            at, room = at + 1, target
        room -= sizes.get(f, 0)
        out[f] = at
    return out


def _packing_session(spark: SparkSession, target_bytes: int) -> SparkSession:
    """A session with the running one's settings in which a scan packs files up to a size."""
    packer = spark.newSession()
    for row in spark.sql("SET").collect():
        if packer.conf.isModifiable(row.key):
            packer.conf.set(row.key, row.value)
    packer.conf.set("spark.sql.files.maxPartitionBytes", str(target_bytes))
    packer.conf.set("spark.sql.files.openCostInBytes", "0")
    packer.conf.set("spark.sql.files.minPartitionNum", "1")
    return packer


# ---------------------------------------------------------------- snapshots


def snapshot(spark: SparkSession, namespace: str, at: dt.datetime) -> list[str]:
    """Note the files of every table of a namespace under the given time.

    A snapshot refers to files, which no operation here changes, and copies
    nothing; per file one line holds its rows and length, and a line without a
    path stands for the snapshot itself. A rerun for the same time replaces it.
    """
    stamp = f"{at:%Y%m%d_%H%M%S}"
    done = []
    for table in spark.catalog.listTables(quoted(namespace)):
        if table.isTemporary or table.tableType == "VIEW" or table.name.endswith(SNAPSHOT_SUFFIX):
            continue
        name, target = f"{namespace}.{table.name}", f"{namespace}.{table.name}{SNAPSHOT_SUFFIX}"
        rows = (
            spark.table(named(name))
            .groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("length"))
            .agg(F.count(F.lit(1)).alias("rows"))
            .unionByName(spark.createDataFrame([(None, 0, 0)], "path string, length bigint, rows bigint"))
            .withColumn("snapshot_ts", F.lit(stamp))
        )
        # Few lines beside the data: one file.
        lines = rows.hint("rebalance")
        if spark.catalog.tableExists(named(target)):
            spark.sql(f"ALTER TABLE {named(target)} DROP IF EXISTS PARTITION (snapshot_ts = {text(stamp)})")
            lines.write.insertInto(named(target))
        else:
            lines.write.partitionBy("snapshot_ts").saveAsTable(named(target))
        done.append(table.name)
    return sorted(done)


def read_snapshot(spark: SparkSession, table: str, stamp: str) -> DataFrame:
    """The rows that a table had at a snapshot, by the names of its present columns.

    Columns added later are null; a column whose type has changed is an error.
    """
    noted = spark.table(named(f"{table}{SNAPSHOT_SUFFIX}")).where((F.col("snapshot_ts") == stamp) & F.col("path").isNotNull())
    folders: dict[str, list[str]] = {}
    for row in noted.select("path").toLocalIterator():
        path = plain_path(row.path)
        folders.setdefault(_PARTITION_FOLDERS.sub("", path.rsplit("/", 1)[0]), []).append(path)
    now = spark.table(named(table)).schema
    out = spark.createDataFrame([], now)
    for base, files in sorted(folders.items()):
        part = spark.read.option("basePath", base).parquet(*sorted(files))
        held = {f.name.lower(): f for f in part.schema.fields}
        partitions = {c.lower() for c in layout_of(spark, table).partition_by}
        columns = []
        for f in now.fields:
            old = held.get(f.name.lower())
            if old is not None and old.dataType != f.dataType and f.name.lower() not in partitions:
                raise ValueError(f"{f.name} was {old.dataType.simpleString()} and is {f.dataType.simpleString()}")
            value = F.lit(None) if old is None else F.col(quoted(old.name))
            columns.append(value.cast(f.dataType).alias(f.name))
        out = out.unionByName(part.select(*columns))
    return out


def history(spark: SparkSession, table: str) -> DataFrame:
    """Snapshots of a table with their row counts, newest first."""
    lines = spark.table(named(f"{table}{SNAPSHOT_SUFFIX}"))
    counted = lines.groupBy("snapshot_ts").agg(F.sum("rows").alias("rows"))
    return counted.orderBy(F.col("snapshot_ts").desc_nulls_last())


def expire_snapshots(spark: SparkSession, table: str, as_of: dt.datetime, older_than: str = "7d") -> list[str]:
    """Drop snapshots older than the interval, never the newest; returns their times.

    ``expire_versions`` then deletes the files that only they referred to.
    """
    target = named(f"{table}{SNAPSHOT_SUFFIX}")
    stamps = sorted(
        row.partition.partition("=")[2] for row in spark.sql(f"SHOW PARTITIONS {target}").collect()
    )
    border = f"{as_of - interval(older_than):%Y%m%d_%H%M%S}"
    expired = [stamp for stamp in stamps[:-1] if stamp < border]
    for stamp in expired:
        spark.sql(f"ALTER TABLE {target} DROP IF EXISTS PARTITION (snapshot_ts = {text(stamp)})")
    return expired


# ---------------------------------------------------------------- views and namespaces


def interval(text: str) -> dt.timedelta:
    """``'30s'``, ``'15m'``, ``'1h'`` or ``'7d'`` as a time span."""
    match = re.fullmatch(r"(\d+)\s*([smhd])", text.strip())
    if not match:
        raise ValueError(f"not an interval: {text!r}")
    unit = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days"}[match[2]]
    return dt.timedelta(**{unit: int(match[1])})


def refresh_view(
    spark: SparkSession,
    name: str,
    build: Callable[[], DataFrame],
    as_of: dt.datetime,
    refresh_interval: str = "1h",
) -> bool:
    """Materialize a query under a name; False while the last refresh is recent enough.

    A table that was never refreshed is due.
    """
    if spark.catalog.tableExists(named(name)):
        last = table_property(spark, name, _REFRESHED)
        if last and as_of - dt.datetime.fromisoformat(last) < interval(refresh_interval):
            return False
    publish(build(), name, properties={_REFRESHED: as_of.isoformat()})
    expire_versions(spark, name)
    return True


def materialize(df: DataFrame, name: str, kind: str) -> None:
    """A staging model becomes a temporary view, a mart a table."""
    if kind == "view":
        df.createOrReplaceTempView(name)
    elif kind == "table":
        publish(df, name)
    else:
        raise ValueError(f"unknown materialization {kind!r}")


def namespace_of(tenant_id: str) -> str:
    """A legal namespace for any tenant id; different ids have different namespaces.

    Letters, digits and single underscores stay; any other character becomes
    its code point between double underscores. Upper case is written that way
    too, as catalogs ignore case.
    """
    return "tenant_" + re.sub(r"[^a-z0-9]", lambda m: f"__{ord(m[0]):x}__", tenant_id)


def create_namespace(spark: SparkSession, name: str, location: str | None = None) -> None:
    """Create a namespace if it is absent."""
    where = f" LOCATION {text(location)}" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {quoted(name)}{where}")


def drop_namespace(spark: SparkSession, name: str) -> None:
    """Drop a namespace with all its tables, snapshots and the files that rewrites left."""
    if not spark.catalog.databaseExists(quoted(name)):
        return
    location = next(
        (r.info_value for r in spark.sql(f"DESCRIBE DATABASE {quoted(name)}").collect() if r.info_name == "Location"), None
    )
    spark.sql(f"DROP DATABASE IF EXISTS {quoted(name)} CASCADE")
    if location and name != "default":
        delete_path(spark, location)


def mart_namespace(base: str, custom: str | None) -> str:
    """Namespace of a model: the base, or base and custom name joined."""
    return base if custom is None else f"{base}_{custom.strip()}"
