"""WARC derivatives: responses become linked metadata and plain-text conversion records."""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import itertools
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

_PAIRS = "array<struct<name:string,value:string>>"
#: payload: the HTTP body as it was stored; source_headers: what the WARC record says of itself. Both lists of headers keep order and repeats.
RESPONSE = f"record_id string, target_uri string, date string, status int, http_headers {_PAIRS}, payload binary, source_headers {_PAIRS}"
RECORD = (
    "warc_type string, record_id string, refers_to string, target_uri string, date string, content_type string, "
    f"content_length long, block_digest string, source_digest string, headers {_PAIRS}, block string"
)

_DROPPED = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|title)\b[^<>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BLOCK = re.compile(
    r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|tr|ul)\b[^<>]*>",
    re.I,
)
_CELL = re.compile(r"</?(?:td|th)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[a-z!?][^<>]*>", re.I)
_BLANKS = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")
_TITLE = re.compile(r"<title\b[^<>]*>(.*?)</title\s*>", re.S | re.I)
_LINK = re.compile(r"<a\b[^<>]*?\bhref\s*=\s*(?:\"([^\"<>]*)\"|'([^'<>]*)'|([^\s\"'<>]+))", re.I)


def plain_text(page: str) -> str:
    """The visible text: scripts, styles, comments and tags go, block elements end lines, entities are decoded, white space is folded."""
    t = _TAG.sub("", _CELL.sub(" ", _BLOCK.sub("\n", _DROPPED.sub(" ", page))))
    return _LINES.sub("\n", _BLANKS.sub(" ", html.unescape(t))).strip()


def digest(data: bytes) -> str:
    """A labelled digest as WARC files have it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """A record id that is the same whenever the record is built again."""
    h = hashlib.sha256("\0".join(parts).encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-a{h[17:20]}-{h[20:32]}>"


_META_CHARSET = re.compile(rb"<meta\b[^<>]*?\bcharset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)
#: Codings of content and transfer that the standard library undoes.
_INFLATE = {"gzip": 47, "x-gzip": 47, "deflate": 47}


def unchunked(body: bytes) -> bytes:
    """The body of a chunked transfer; a body that isn't chunked, as many crawlers store it, comes back as it is, and a cut one as far as it goes."""
    out, at = [], 0
    while at < len(body):
        line = body[at : at + 1024].partition(b"\r\n")
        try:
            size = int(line[0].partition(b";")[0], 16)
        except ValueError:
            return b"".join(out) if out else body
        if not size:
            break
        at += len(line[0]) + 2
        out.append(body[at : at + size])
        at += size + 2
    return b"".join(out)


def _inflated(body: bytes) -> bytes:
    for bits in (47, -15):
        part = zlib.decompressobj(bits)
        try:
            return part.decompress(body) + part.flush()
        except zlib.error:
            continue
    return body


def decoded(payload: bytes, http: dict[str, str]) -> str:
    """The text of a payload (http: headers by lower-case name): transfer and content codings undone, then decoded by a byte order mark, the header's charset, that of a
    meta tag in the first 1024 bytes, or UTF-8 if it is that and Windows-1252 otherwise. Unknown codings are left as they are; what can't be decoded becomes U+FFFD."""
    if "chunked" in http.get("transfer-encoding", "").lower():
        payload = unchunked(payload)
    for coding in reversed(http.get("content-encoding", "").lower().split(",")):
        if coding.strip() in _INFLATE:
            payload = _inflated(payload)
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if payload.startswith(mark):
            return payload[len(mark) :].decode(name, "replace")
    said = re.search(r"charset\s*=\s*[\"']?\s*([\w.:-]+)", http.get("content-type", ""), re.I)
    meta = None if said else _META_CHARSET.search(payload[:1024])
    for name in ([said[1]] if said else []) + ([meta[1].decode("ascii", "replace")] if meta else []):
        try:
            return payload.decode("windows-1252" if name.lower() in ("iso-8859-1", "latin-1", "latin1", "us-ascii", "ascii") else name, "replace")
        except LookupError:
            continue
    try:
        return payload.decode()
    except UnicodeDecodeError:
        return payload.decode("windows-1252", "replace")


def derive(source: dict) -> list[dict]:
    """The metadata and the conversion record of a response (keys of RESPONSE)."""
    payload, uri, rid = source["payload"] or b"", source["target_uri"] or "", source["record_id"]
    pairs = [(h["name"], h["value"]) for h in source["http_headers"] or [] if h and h["name"] is not None and h["value"] is not None]
    own_headers = [(h["name"], h["value"]) for h in source["source_headers"] or [] if h and h["name"] is not None and h["value"] is not None]
    said = {k.lower(): v for k, v in own_headers}
    rid = rid or record_id("response", uri, digest(payload))
    origin = said.get("warc-payload-digest") or digest(payload)
    page = decoded(payload, {k.lower(): v for k, v in pairs})
    title = _TITLE.search(page)
    fields = [("title", _BLANKS.sub(" ", html.unescape(title[1]).replace("\n", " ")).strip())] if title else []
    if source["status"] is not None:
        fields.append(("http-status", str(source["status"])))
    fields += [(f"http-{k.lower()}", _BLANKS.sub(" ", v.replace("\n", " "))) for k, v in pairs]
    fields += [(f"source-{k.lower()}", _BLANKS.sub(" ", v.replace("\n", " "))) for k, v in own_headers]
    fields += [("outlink", html.unescape(next(filter(None, m.groups()), "")).replace("\n", " ")) for m in _LINK.finditer(page)]
    out = []
    for kind, mime, block in (
        ("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields)),
        ("conversion", "text/plain; charset=utf-8", plain_text(page)),
    ):
        body = block.encode("utf-8", "replace")
        own, sha = record_id(kind, rid), digest(body)
        headers = [
            ("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", rid), ("WARC-Target-URI", uri), ("WARC-Date", source["date"] or ""),
            ("WARC-Refers-To-Payload-Digest", origin), ("WARC-Refers-To-Block-Digest", said.get("warc-block-digest", "")), ("WARC-IP-Address", said.get("warc-ip-address", "")),
            ("WARC-Block-Digest", sha), ("Content-Type", mime), ("Content-Length", str(len(body))),
        ]
        headers[7:7] = [("WARC-Concurrent-To", v) for k, v in own_headers if k.lower() == "warc-concurrent-to"]
        out.append(
            {
                "warc_type": kind, "record_id": own, "refers_to": rid, "target_uri": uri, "date": source["date"], "content_type": mime,
                "content_length": len(body), "block_digest": sha, "source_digest": origin,
                "headers": [{"name": k, "value": v} for k, v in headers if v], "block": body.decode(),
            }
        )
    return out


def derivatives(responses: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Two records (RECORD) for each row of responses (RESPONSE), in one pass without a shuffle; the columns `keep` of a response go with them (one named like a column of
    RECORD as source_<name>).

    WARC-Refers-To is the response's id; WARC-Refers-To-Payload-Digest is the source's own payload digest, or that of the stored bytes where it has none; its block
    digest, address and concurrent records are carried over. The metadata block keeps the title, the HTTP status, all HTTP headers and all of the source's WARC headers, in order
    and with repeats, and all outlinks. Text is taken from the bytes with their transfer and content codings undone, by their charset (decoded).

    A null payload or URI counts as empty; a null record id is made from URI and payload digest, so derivatives of equal responses are equal; null headers, status
    and date are left out. Broken markup never fails: an unclosed comment or script runs to the end. A very long payload is held by one task, alone in its turn. Repeated
    rows give repeated records; extra columns are ignored; an empty table gives no rows.
    """
    taken = [c.split()[0] for c in RECORD.split(", ")]
    name = {c: f"source_{c}" if c in taken else c for c in keep}
    ddl = ", ".join([*(f"`{name[c]}` {responses.schema[c].dataType.simpleString()}" for c in keep), RECORD])
    schema = arrow_schema(ddl)
    given = [x.split()[0] for x in RESPONSE.split(", ")]

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                kept = [part.column(len(given) + k).to_pylist() for k in range(len(keep))]
                rows = []
                for k, x in enumerate(part.select(range(len(given))).to_pylist()):
                    rows += [r | {name[c]: v[k] for c, v in zip(keep, kept, strict=True)} for r in derive(x)]
                yield pa.RecordBatch.from_pylist(rows, schema)

    return responses.select(*given, *(F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep))).mapInArrow(run, ddl)


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def page_responses(pages: DataFrame, date: str | None = None) -> DataFrame:
    """Rows of RESPONSE, with page_id, for a table of pages (page_id, url, html)."""
    uri, body = F.coalesce(F.col("url"), F.lit("")), F.coalesce(F.col("html"), F.lit(""))
    h = F.sha2(F.concat_ws("\x00", F.coalesce(F.col("page_id").cast("string"), F.lit("")), uri), 256)
    part = [F.substring(h, *x) for x in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    rid = F.concat(F.lit("<urn:uuid:"), part[0], F.lit("-"), part[1], F.lit("-5"), part[2], F.lit("-a"), part[3], F.lit("-"), part[4], F.lit(">"))
    # A page comes as text: these say how its bytes are read, and are the only headers made up.
    pair = lambda k, v: F.struct(F.lit(k).alias("name"), v.alias("value"))
    headers = F.array(pair("Content-Type", F.lit("text/html; charset=utf-8")), pair("Content-Length", F.octet_length(body).cast("string")))
    return pages.select(
        "page_id", rid.alias("record_id"), uri.alias("target_uri"), F.lit(date).cast("string").alias("date"), F.lit(200).alias("status"),
        headers.alias("http_headers"), body.cast("binary").alias("payload"), F.lit(None).cast(_PAIRS).alias("source_headers"),
    )


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as it stands in a WARC file, a gzip member of its own."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", mtime=0)


def _fields(lines: list[str]) -> list[tuple[str, str]]:
    """Name and value of header lines; a line that begins with white space continues the one before it."""
    out: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            k, _, v = line.partition(":")
            out.append((k.strip(), v.strip()))
    return out


def parse_records(pieces: Iterator[bytes]) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """Headers and block of each record, from the pieces that a WARC file falls into at every `\\r\\n\\r\\nWARC/1.`. A block that has that within goes over several pieces; a cut last record is left out."""
    head, block, left = None, [], 0
    for piece in pieces:
        if head is not None and left > len(_SEPARATOR):  # the record before goes on
            block.append(_SEPARATOR + piece)
            left -= len(_SEPARATOR) + len(piece)
        else:
            first, _, body = piece.partition(b"\r\n\r\n")
            lines = first.decode("utf-8", "replace").split("\r\n")
            head = _fields(lines[1:])
            n = next((v for k, v in head if k.lower() == "content-length"), "0")
            size = int(n) if n.isdigit() else 0
            block, left = [body], size - len(body)
        if left <= 0:
            yield head, b"".join(block)[:size]
            head = None


_SEPARATOR = b"\r\n\r\nWARC/1."


def response_of(head: list[tuple[str, str]], block: bytes) -> dict | None:
    """A row of RESPONSE of a response record."""
    h = {k.lower(): v for k, v in head}
    if h.get("warc-type") != "response":
        return None
    top, _, body = block.partition(b"\r\n\r\n")
    first, *lines = top.decode("latin-1").split("\r\n")
    code = first.split(" ")[1] if first.count(" ") else ""
    pairs = lambda x: [{"name": k, "value": v} for k, v in x]
    return {
        "record_id": h.get("warc-record-id"), "target_uri": h.get("warc-target-uri"), "date": h.get("warc-date"), "status": int(code) if code.isdigit() else None,
        "http_headers": pairs(_fields(lines)), "payload": body, "source_headers": pairs(head),
    }


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Rows of RESPONSE from the response records of WARC files, gzipped (one member a record, or one in all) or plain.

    Spark reads the files record by record: a file is never one value, whatever its size. A gzipped file is one task, as it can't be entered in the middle; a large plain one
    is split between records. A block that holds a separator itself is put together again, unless a split falls just there: that record is then left out.
    """
    schema = arrow_schema(RESPONSE)

    def run(batches):
        def pieces():
            for batch in batches:
                for i in range(batch.num_rows):
                    yield batch.column(1)[i].as_py(), batch.column(0)[i].as_py()

        rows, size = [], 0
        for _, of_file in itertools.groupby(pieces(), key=lambda x: x[0]):
            for head, block in parse_records(p for _, p in of_file):
                row = response_of(head, block)
                if row:
                    rows.append(row)
                    size += len(block)
                if size > 4_000_000:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    lines = spark.read.option("lineSep", _SEPARATOR.decode()).option("wholetext", False).text(path)
    return lines.select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file")).mapInArrow(run, RESPONSE)


def write_records(records: DataFrame, path: str) -> None:
    """Each partition's records (RECORD) as gzip members in the rows of a Parquet column `warc`: concatenated they are a .warc.gz file."""

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            out = [record_bytes([(h["name"], h["value"]) for h in r["headers"]], (r["block"] or "").encode()) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r["record_id"] for r in rows], pa.string()), pa.array(out, pa.binary())], ["record_id", "warc"])

    records.select("record_id", "headers", "block").mapInArrow(run, "record_id string, warc binary").write.parquet(path)


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(page_responses(table(spark, sf_dir, "pages")), keep=("page_id",))
