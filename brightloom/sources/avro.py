"""Avro object containers for table metadata: values are encoded and read by their schema, without compression."""

from __future__ import annotations

import io
import json
import struct
import uuid

from brightloom.functions.codecs import avro_bytes, zigzag

MAGIC = b"Obj\x01"
#: Records of a block.
BLOCK = 1_000


def encode(schema, value) -> bytes:
    """A value's bytes; a union takes its null branch for None and else the first other one."""
    if isinstance(schema, list):
        at = next(i for i, s in enumerate(schema) if (s == "null") == (value is None))
        return zigzag(at) + encode(schema[at], value)
    kind = schema["type"] if isinstance(schema, dict) else schema
    if kind == "record":
        return b"".join(encode(f["type"], value.get(f["name"]) if "default" in f else value[f["name"]]) for f in schema["fields"])
    if kind == "array":
        return (zigzag(len(value)) + b"".join(encode(schema["items"], v) for v in value) if value else b"") + zigzag(0)
    if kind == "map":
        return (zigzag(len(value)) + b"".join(avro_bytes(k) + encode(schema["values"], v) for k, v in value.items()) if value else b"") + zigzag(0)
    if kind == "null":
        return b""
    if kind in ("int", "long"):
        return zigzag(value)
    if kind in ("string", "bytes"):
        return avro_bytes(value)
    if kind == "boolean":
        return bytes([bool(value)])
    if kind in ("float", "double"):
        return struct.pack("<f" if kind == "float" else "<d", value)
    raise ValueError(f"no Avro encoding for {kind!r}")


def read_long(data: io.BytesIO) -> int:
    n = shift = 0
    while True:
        b = data.read(1)[0]
        n |= (b & 0x7F) << shift
        shift += 7
        if not b & 0x80:
            return (n >> 1) ^ -(n & 1)


def decode(schema, data: io.BytesIO):
    """The next value of a schema."""
    if isinstance(schema, list):
        return decode(schema[read_long(data)], data)
    kind = schema["type"] if isinstance(schema, dict) else schema
    if isinstance(kind, (dict, list)):
        return decode(kind, data)
    if kind == "record":
        return {f["name"]: decode(f["type"], data) for f in schema["fields"]}
    if kind in ("array", "map"):
        out: list = []
        while n := read_long(data):
            if n < 0:
                n, _ = -n, read_long(data)
            out += [decode(schema["items"], data) if kind == "array" else (decode("string", data), decode(schema["values"], data)) for _ in range(n)]
        return out if kind == "array" else dict(out)
    if kind in ("int", "long"):
        return read_long(data)
    if kind in ("string", "bytes"):
        raw = data.read(read_long(data))
        return raw.decode() if kind == "string" else raw
    if kind == "boolean":
        return data.read(1) == b"\x01"
    if kind in ("float", "double"):
        return struct.unpack("<f" if kind == "float" else "<d", data.read(4 if kind == "float" else 8))[0]
    if kind == "null":
        return None
    raise ValueError(f"no Avro decoding for {kind!r}")


def container(schema: dict, records: list[dict], meta: dict[str, str] | None = None) -> bytes:
    """Magic, metadata with the schema, sync marker, and blocks of records; no block if there are none."""
    sync = uuid.uuid4().bytes
    entries = {"avro.schema": json.dumps(schema), "avro.codec": "null"} | (meta or {})
    out = [MAGIC, encode({"type": "map", "values": "bytes"}, {k: v.encode() for k, v in entries.items()}), sync]
    for at in range(0, len(records), BLOCK):
        part = records[at : at + BLOCK]
        body = b"".join(encode(schema, r) for r in part)
        out += [zigzag(len(part)), zigzag(len(body)), body, sync]
    return b"".join(out)


def read_container(raw: bytes) -> tuple[dict[str, str], list]:
    """(metadata, records) of a container without compression."""
    data = io.BytesIO(raw)
    if data.read(4) != MAGIC:
        raise ValueError("not an Avro object container")
    meta = {k: v.decode() for k, v in decode({"type": "map", "values": "bytes"}, data).items()}
    if meta.get("avro.codec", "null") != "null":
        raise ValueError(f"unknown codec {meta['avro.codec']!r}")
    schema, sync, out = json.loads(meta["avro.schema"]), data.read(16), []
    while data.tell() < len(raw):
        n, _ = read_long(data), read_long(data)
        out += [decode(schema, data) for _ in range(n)]
        if data.read(16) != sync:
            raise ValueError("a block ends without the sync marker")
    return meta, out
