"""Table formats with metadata of their own, committed by the driver after Spark has written the data files.

Iceberg v1 and Paimon append-only tables: unpartitioned, one snapshot. What the driver handles is one line for each data
file. Readers follow the metadata, so that only committed files are read.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.sources import avro

ICEBERG_TYPES = {"bigint": "long", "int": "int", "double": "double", "float": "float", "string": "string", "boolean": "boolean", "date": "date", "timestamp": "timestamptz", "timestamp_ntz": "timestamp"}
PAIMON_TYPES = {"bigint": "BIGINT", "int": "INT", "double": "DOUBLE", "float": "FLOAT", "string": "STRING", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP(6)", "timestamp_ntz": "TIMESTAMP(6)"}


def _field(name: str, kind, number: int | None = None) -> dict:
    return {"name": name, "type": kind} | ({} if number is None else {"field-id": number})


# Field names, types, order and numbers of the formats' metadata: fixed values of the public specifications.
ICEBERG_DATA_FILE = {
    "type": "record",
    "name": "r2",
    "fields": [
        _field("file_path", "string", 100),
        _field("file_format", "string", 101),
        _field("partition", {"type": "record", "name": "r102", "fields": []}, 102),
        _field("record_count", "long", 103),
        _field("file_size_in_bytes", "long", 104),
        _field("block_size_in_bytes", "long", 105),
    ],
}
ICEBERG_ENTRY = {"type": "record", "name": "manifest_entry", "fields": [_field("status", "int", 0), _field("snapshot_id", ["null", "long"], 1), _field("data_file", ICEBERG_DATA_FILE, 2)]}
ICEBERG_MANIFEST = {
    "type": "record",
    "name": "manifest_file",
    "fields": [
        _field("manifest_path", "string", 500),
        _field("manifest_length", "long", 501),
        _field("partition_spec_id", "int", 502),
        _field("added_snapshot_id", ["null", "long"], 503),
        _field("added_data_files_count", ["null", "int"], 504),
        _field("added_rows_count", ["null", "long"], 512),
    ],
}
PAIMON_DATA_FILE = {
    "type": "record",
    "name": "DataFileMetadata",
    "fields": [
        _field("fileName", "string"),
        _field("fileSize", "long"),
        _field("level", "int"),
        _field("minKey", ["null", "bytes"]),
        _field("maxKey", ["null", "bytes"]),
        _field("minColumnStats", ["null", "bytes"]),
        _field("maxColumnStats", ["null", "bytes"]),
        _field("nullCounts", ["null", "bytes"]),
        _field("rowCount", "long"),
        _field("sequenceNumber", "long"),
        _field("fileSource", "string"),
        _field("schemaId", "long"),
    ],
}
PAIMON_ENTRY = {
    "type": "record",
    "name": "ManifestEntry",
    "fields": [_field("_KIND", "int"), _field("_PARTITION", "bytes"), _field("_BUCKET", "int"), _field("_TOTAL_BUCKETS", "int"), _field("_FILE", PAIMON_DATA_FILE)],
}
PAIMON_MANIFEST = {
    "type": "record",
    "name": "ManifestFileMeta",
    "fields": [
        _field("_FILE_NAME", "string"),
        _field("_FILE_SIZE", "long"),
        _field("_NUM_ADDED_FILES", "long"),
        _field("_NUM_DELETED_FILES", "long"),
        _field("_PARTITION_STATS", ["null", "bytes"]),
        _field("_SCHEMA_ID", "long"),
    ],
}
#: A row without columns in the format's binary form.
EMPTY_ROW = b"\x04\x00\x00\x00"
PAIMON_OPTIONS = "table.type=APPEND_ONLY\ndata-files.format=parquet\nbucket=-1\n"


def file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def put(spark: SparkSession, path: str, data: bytes) -> int:
    fs, p = file_system(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(data))
    out.close()
    return len(data)


def get(spark: SparkSession, path: str) -> bytes:
    fs, p = file_system(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def type_names(df: DataFrame, types: dict[str, str], what: str) -> list[str]:
    """Each column's type in the format; decimals keep their text. A type that the format lacks is an error."""
    own = [f.dataType.simpleString() for f in df.schema]
    unknown = [f.name for f, t in zip(df.schema, own, strict=True) if t not in types and not t.startswith("decimal")]
    if unknown:
        raise ValueError(f"no {what} type for {unknown}")
    return [types.get(t, t.upper() if what == "Paimon" else t) for t in own]


def _write_files(df: DataFrame, path: str, compression: str, rows_per_file: int) -> list[tuple[str, int, int]]:
    """(path, bytes, rows) of the data files. Rows come from the files' footers: the count reads no column."""
    spark = df.sparkSession
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).option("compression", compression).parquet(path)
    files = spark.read.schema(df.schema).parquet(path).groupBy(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("s")).count()
    return [(r["f"], r["s"], r["count"]) for r in files.orderBy("f").collect()]


def _clear(spark: SparkSession, path: str) -> None:
    """Overwriting starts a table anew, so that no metadata of an earlier one stays."""
    fs, p = file_system(spark, path)
    if fs.exists(p):
        fs.delete(p, True)


def write_iceberg(df: DataFrame, path: str, compression: str = "zstd", rows_per_file: int = 10_000_000) -> None:
    """Data files, then manifest, manifest list, metadata and version hint; one append snapshot."""
    spark, kinds = df.sparkSession, type_names(df, ICEBERG_TYPES, "Iceberg")
    _clear(spark, path)
    files = _write_files(df, f"{path}/data", compression, rows_per_file)
    snapshot, now, total = int(time.time() * 1e6), int(time.time() * 1000), sum(r for _, _, r in files)
    fields = [{"id": i + 1, "name": f.name, "required": False, "type": t} for i, (f, t) in enumerate(zip(df.schema, kinds, strict=True))]
    schema = {"type": "struct", "schema-id": 0, "fields": fields}
    entries = []
    for name, size, rows in files:
        one = {"file_path": name, "file_format": "PARQUET", "partition": {}, "record_count": rows, "file_size_in_bytes": size, "block_size_in_bytes": 64 << 20}
        entries.append({"status": 1, "snapshot_id": snapshot, "data_file": one})
    manifest = f"{path}/metadata/{uuid.uuid4()}-m0.avro"
    about = {"schema": json.dumps(schema), "partition-spec": "[]", "partition-spec-id": "0", "format-version": "1"}
    size = put(spark, manifest, avro.container(ICEBERG_ENTRY, entries, about))
    row = {"manifest_path": manifest, "manifest_length": size, "partition_spec_id": 0, "added_snapshot_id": snapshot, "added_data_files_count": len(files), "added_rows_count": total}
    manifests = f"{path}/metadata/snap-{snapshot}-1-{uuid.uuid4()}.avro"
    put(spark, manifests, avro.container(ICEBERG_MANIFEST, [row]))
    summary = {"operation": "append", "added-data-files": str(len(files)), "added-records": str(total), "total-records": str(total)}
    meta = {
        "format-version": 1,
        "table-uuid": str(uuid.uuid4()),
        "location": path,
        "last-updated-ms": now,
        "last-column-id": len(fields),
        "schema": schema,
        "schemas": [schema],
        "current-schema-id": 0,
        "partition-spec": [],
        "partition-specs": [{"spec-id": 0, "fields": []}],
        "default-spec-id": 0,
        "last-partition-id": 999,
        "sort-orders": [{"order-id": 0, "fields": []}],
        "default-sort-order-id": 0,
        "properties": {},
        "current-snapshot-id": snapshot,
        "snapshots": [{"snapshot-id": snapshot, "timestamp-ms": now, "manifest-list": manifests, "summary": summary}],
        "snapshot-log": [{"snapshot-id": snapshot, "timestamp-ms": now}],
        "metadata-log": [],
    }
    put(spark, f"{path}/metadata/v1.metadata.json", json.dumps(meta, indent=1).encode())
    put(spark, f"{path}/metadata/version-hint.text", b"1")


def iceberg_files(spark: SparkSession, path: str) -> list[str]:
    """Data files of the current snapshot."""
    version = get(spark, f"{path}/metadata/version-hint.text").decode()
    meta = json.loads(get(spark, f"{path}/metadata/v{version}.metadata.json"))
    lists = [s["manifest-list"] for s in meta["snapshots"] if s["snapshot-id"] == meta["current-snapshot-id"]]
    manifests = [r["manifest_path"] for x in lists for r in avro.read_container(get(spark, x))[1]]
    return [e["data_file"]["file_path"] for m in manifests for e in avro.read_container(get(spark, m))[1] if e["status"] != 2]


def write_paimon(df: DataFrame, path: str, compression: str = "zstd", rows_per_file: int = 10_000_000) -> None:
    """Options, schema, data files of one bucket, manifest, manifest list, snapshot and its hints."""
    spark, kinds = df.sparkSession, type_names(df, PAIMON_TYPES, "Paimon")
    _clear(spark, path)
    put(spark, f"{path}/OPTIONS", PAIMON_OPTIONS.encode())
    fields = [{"id": i, "name": f.name, "type": t} for i, (f, t) in enumerate(zip(df.schema, kinds, strict=True))]
    put(spark, f"{path}/schema/schema-0", json.dumps({"fields": fields, "primaryKeys": [], "partitionKeys": [], "options": {}}, indent=2).encode())
    staged, entries, total = f"{path}/.staged", [], 0
    fs, _ = file_system(spark, path)
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs.mkdirs(new(f"{path}/bucket-0"))
    for i, (name, size, rows) in enumerate(_write_files(df, staged, compression, rows_per_file)):
        target = f"data-{uuid.uuid4()}-{i}.parquet"
        fs.rename(new(name), new(f"{path}/bucket-0/{target}"))
        one = {"fileName": target, "fileSize": size, "level": 0, "rowCount": rows, "sequenceNumber": 0, "fileSource": "APPEND", "schemaId": 0}
        one |= dict.fromkeys(("minKey", "maxKey", "minColumnStats", "maxColumnStats", "nullCounts"))
        entries.append({"_KIND": 0, "_PARTITION": EMPTY_ROW, "_BUCKET": 0, "_TOTAL_BUCKETS": -1, "_FILE": one})
        total += rows
    fs.delete(new(staged), True)
    manifest, listed = f"manifest-{uuid.uuid4()}-0", f"manifest-list-{uuid.uuid4()}-0"
    size = put(spark, f"{path}/manifest/{manifest}", avro.container(PAIMON_ENTRY, entries))
    row = {"_FILE_NAME": manifest, "_FILE_SIZE": size, "_NUM_ADDED_FILES": len(entries), "_NUM_DELETED_FILES": 0, "_PARTITION_STATS": None, "_SCHEMA_ID": 0}
    put(spark, f"{path}/manifest/{listed}", avro.container(PAIMON_MANIFEST, [row]))
    snapshot = {
        "version": 3,
        "id": 1,
        "schemaId": 0,
        "baseManifestList": None,
        "deltaManifestList": listed,
        "changelogManifestList": None,
        "indexManifest": None,
        "commitUser": str(uuid.uuid4()),
        "commitIdentifier": (1 << 63) - 1,
        "commitKind": "APPEND",
        "timeMillis": int(time.time() * 1000),
        "logOffsets": {},
        "totalRecordCount": total,
        "deltaRecordCount": total,
        "changelogRecordCount": 0,
        "watermark": -(1 << 63),
        "statistics": None,
    }
    put(spark, f"{path}/snapshot/snapshot-1", json.dumps(snapshot, indent=2).encode())
    for hint in ("EARLIEST", "LATEST"):
        put(spark, f"{path}/snapshot/{hint}", b"1")


def paimon_files(spark: SparkSession, path: str) -> list[str]:
    """Data files of the latest snapshot."""
    latest = get(spark, f"{path}/snapshot/LATEST").decode()
    snapshot = json.loads(get(spark, f"{path}/snapshot/snapshot-{latest}"))
    manifests = [r["_FILE_NAME"] for r in avro.read_container(get(spark, f"{path}/manifest/{snapshot['deltaManifestList']}"))[1]]
    found = [e for m in manifests for e in avro.read_container(get(spark, f"{path}/manifest/{m}"))[1]]
    return [f"{path}/bucket-{e['_BUCKET']}/{e['_FILE']['fileName']}" for e in found if e["_KIND"] == 0]
