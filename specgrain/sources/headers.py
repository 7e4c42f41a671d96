"""Binary package headers (version 3, as package lists chain them) as relations."""

from __future__ import annotations

import gzip
import lzma
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"\x8e\xad\xe8\x01"
#: Tag numbers of the header format.
TAGS = {
    1000: "name", 1001: "version", 1002: "release", 1003: "epoch", 1004: "summary", 1009: "size", 1022: "arch", 1044: "source_rpm",
    1047: "providename", 1112: "provideflags", 1113: "provideversion", 1049: "requirename", 1048: "requireflags", 1050: "requireversion",
    1054: "conflictname", 1053: "conflictflags", 1055: "conflictversion", 1090: "obsoletename", 1114: "obsoleteflags", 1115: "obsoleteversion",
    1116: "dirindexes", 1117: "basenames", 1118: "dirnames", 1027: "oldfilenames",
}
#: Bits of a dependency's flags.
LESS, GREATER, EQUAL = 2, 4, 8
KINDS = (("provides", "provide"), ("requires", "require"), ("conflicts", "conflict"), ("obsoletes", "obsolete"))
_CAP = "kind:string,name:string,op:string,epoch:int,version:string,release:string"
HEADER = f"name string, epoch int, version string, release string, arch string, summary string, size_installed long, source_rpm string, caps array<struct<{_CAP}>>, files array<string>"
#: A decompressed list beyond this is refused.
LIMIT = 4 << 30


class Broken(ValueError):
    pass


def one_header(data: bytes, at: int) -> tuple[dict, int]:
    """The tags of the header at a place, and the place after it."""
    if data[at : at + 4] != MAGIC or at + 16 > len(data):
        raise Broken(f"no header at {at}")
    count, size = struct.unpack_from(">II", data, at + 8)
    store = at + 16 + 16 * count
    end = store + size
    if end > len(data):
        raise Broken(f"truncated header at {at}")
    out: dict = {}
    for i in range(count):
        tag, kind, offset, n = struct.unpack_from(">IIII", data, at + 16 + 16 * i)
        name = TAGS.get(tag)
        if name is None or offset >= size:
            continue
        p = store + offset
        if kind == 4:
            if p + 4 * n > end:
                raise Broken(f"tag {tag} leaves its store")
            out[name] = list(struct.unpack_from(f">{n}I", data, p))
        elif kind in (6, 8, 9):
            texts = []
            for _ in range(1 if kind == 6 else n):
                q = data.find(b"\0", p, end)
                if q < 0:
                    raise Broken(f"tag {tag} leaves its store")
                texts.append(data[p:q].decode("utf-8", "replace"))
                p = q + 1
            out[name] = texts
    return out, end


def headers(data: bytes) -> Iterator[dict]:
    """A chain of headers; zero bytes may pad between them."""
    at = 0
    while at < len(data):
        if data[at] == 0:
            at += 1
            continue
        tags, at = one_header(data, at)
        yield tags


def unpacked(data: bytes) -> bytes:
    """gzip, xz (any number of streams) or plain bytes."""
    if data[:2] == b"\x1f\x8b":
        out = gzip.decompress(data)
    elif data[:6] == b"\xfd7zXZ\0":
        out = lzma.decompress(data)
    elif data[:3] == b"BZh":
        raise Broken("bzip2 isn't supported")
    else:
        return data
    if len(out) > LIMIT:
        raise Broken("too large")
    return out


def _capability(kind: str, name: str, flags: int, evr: str) -> dict:
    op = {LESS: "LT", GREATER: "GT", EQUAL: "EQ", LESS | EQUAL: "LE", GREATER | EQUAL: "GE"}.get(flags & (LESS | GREATER | EQUAL))
    if op is None or not evr:
        return {"kind": kind, "name": name, "op": "NONE", "epoch": None, "version": None, "release": None}
    head, _, rest = evr.partition(":") if ":" in evr and evr.split(":", 1)[0].isdigit() else ("0", "", evr)
    version, _, release = rest.rpartition("-") if "-" in rest else (rest, "", "")
    return {"kind": kind, "name": name, "op": op, "epoch": int(head), "version": version, "release": release}


def package(tags: dict) -> dict | None:
    """A row of HEADER; None without a name and version."""
    one = lambda k: (tags.get(k) or [None])[0]
    if not one("name") or not one("version"):
        return None
    caps = []
    for kind, stem in KINDS:
        names = tags.get(f"{stem}name", [])
        flags, versions = tags.get(f"{stem}flags", [0] * len(names)), tags.get(f"{stem}version", [""] * len(names))
        caps += [_capability(kind, *x) for x in zip(names, flags, versions, strict=False)]
    dirs = tags.get("dirnames", [])
    files = [dirs[i] + b for i, b in zip(tags.get("dirindexes", []), tags.get("basenames", []), strict=False) if i < len(dirs)]
    return {
        "name": one("name"), "epoch": one("epoch") or 0, "version": one("version"), "release": one("release") or "", "arch": one("arch"), "summary": one("summary"),
        "size_installed": one("size"), "source_rpm": one("source_rpm"), "caps": caps, "files": files or tags.get("oldfilenames", []),
    }


def read_package_lists(spark: SparkSession, path: str, repo_id: str) -> DataFrame:
    """Packages (repo_id and HEADER) of package lists: files of chained headers, packed or not. A broken list is an error, not a short table."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(HEADER))

    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows = []
                for tags in headers(unpacked(data)):
                    row = package(tags)
                    if row:
                        rows.append(row)
                    if len(rows) >= 2_000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, HEADER).select(F.lit(repo_id).alias("repo_id"), "*")
