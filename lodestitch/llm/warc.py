"""WARC archives: written by Spark's text writer, read back record by record, assembled into transactions.

A record is a row of text, and what stands between records, an empty line, is the writer's line separator;
so archives are plain text tables with a separator of their own, on any store that Spark writes to,
gzipped as a stream or not. The reader takes the end of a record with the start of the next as its separator and splits
large plain files like any text (one that a split tears is read whole instead, see ``_untorn``); else nothing is held whole but single records. A payload may hold that separator itself
(an archive in an archive): a piece that is shorter than its Content-Length marks its file, and in marked files the
pieces are chained by their lengths and joined again. Marked files are counted first. Files are plain or gzipped.

Writing. Rows with equal payloads (by SHA-256) share one response record, that of the largest id; the others are
revisits that refer to it. Each capture also gets a request and a metadata record, which name the capture's record as
concurrent. Only one payload of each kind is shuffled, after a map-side pass that drops repeats; all else moves digests.

Reading. ``index_archive`` makes a row per record, without the payload of responses but with its length and its
recomputed digest. ``assemble`` joins requests and metadata to captures through their WARC-Concurrent-To, in either direction and,
for metadata, also by way of the request, and gives one nested row per capture; ``resolve`` joins revisits to what they
refer to. A payload that a million revisits refer to is one hot key of narrow rows, which adaptive execution splits.

Defined results. A null payload is empty; empty payloads are equal payloads. A null id is smaller than any other. Of rows with equal id, url
and payload one may be the response and the others revisit it. Of several requests or metadata records of a
capture the one with the smallest record id is nested, ``requests`` and ``metadatas`` count them, and
``unclaimed`` lists all records that no capture nests. A url with blanks or control characters is percent-encoded in headers, and as it is in the
metadata. A revisit whose original isn't there has null ``payload_bytes`` and ``refers_to``. Empty tables give empty archives.
"""

from __future__ import annotations

from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestitch.plans.materialize import stored

#: Fixed by the format.
LINE, BLANK = "\r\n", "\r\n\r\n"
VERSION = "WARC/1.1"
BETWEEN = BLANK + "WARC/1."
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURES = ("response", "revisit", "resource")
#: Marked files whose names go into a filter; more are joined.
MOST_FILTERED = 1000
#: Plain files that may be read whole.
MOST_NAMES = 100_000


def base32(digest_hex: Column) -> Column:
    """RFC 4648 base32 of a hex SHA-1: five hex digits are four base-32 ones."""
    groups = [F.lpad(F.conv(F.substring(digest_hex, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: str, block: Column, *headers: tuple[str, Column]) -> Column:
    """The bytes of a record up to its closing empty line; headers that are null are left out."""
    named = [("WARC-Type", F.lit(kind)), *headers, ("Content-Length", F.octet_length(block).cast("string"))]
    head = F.concat_ws("", F.lit(VERSION), *[F.concat(F.lit(f"{LINE}{n}: "), v) for n, v in named], F.lit(BLANK))
    return F.concat(head.cast("binary"), block.cast("binary"))


def write_archive(
    pages: DataFrame,
    folder: str,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    date: str = "2000-01-01T00:00:00Z",
    compression: str = "gzip",
    least_revisit_bytes: int = 0,
) -> None:
    """A request, a response or revisit, and a metadata record for every row, as WARC files below ``folder``.

    Payloads of fewer than ``least_revisit_bytes`` bytes are written out each time.
    """
    payload = F.col(payload_col)
    payload = F.coalesce(payload if dict(pages.dtypes)[payload_col] == "binary" else F.encode(payload.cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.sha2(payload, 256).alias("same"), payload.alias("payload")
    )
    described = rows.select("id", "url", "same", base32(F.sha1("payload")).alias("digest"), F.octet_length("payload").cast("long").alias("bytes"))
    kinds = stored(described.groupBy("id", "url", "same", "digest", "bytes").agg(F.count("*").alias("copies")))
    own = F.struct("id", "url")
    leaders = kinds.groupBy("same").agg(F.max(own).alias("leader"))
    copy = F.explode(F.sequence(F.lit(1).cast("long"), "copies"))
    captures = kinds.join(leaders, "same").withColumn("copy", copy)
    name = lambda s, copy: _urn(s.getField("id").cast("string"), F.coalesce(F.sha2(s.getField("url"), 256), F.lit("")), F.col("same"), copy)
    first = (F.col("copy") == 1) & own.eqNullSafe(F.col("leader"))
    uri = F.when(F.col("url").rlike(r"[\x00-\x20\x7F]"), F.url_encode("url")).otherwise(F.col("url"))
    captures = captures.select(
        "*",
        ((F.col("bytes") < least_revisit_bytes) | first).alias("whole"),
        name(own, F.col("copy").cast("string")).alias("capture"),
        name(F.col("leader"), F.lit("1")).alias("original"),
        uri.alias("uri"),
        F.concat(F.lit("sha1:"), "digest").alias("sha1"),
    )
    when, at = ("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("uri"))
    ok = F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: ")
    http = F.concat(ok, F.col("bytes").cast("string"), F.lit(BLANK))
    target = F.coalesce(F.regexp_extract("uri", r"^[^:]*://[^/?#]*([^#]+)", 1), F.lit(""))
    asked = F.concat_ws("", F.lit("GET "), F.when(target == "", "/").otherwise(target), F.lit(f" HTTP/1.1{LINE}Host: "), F.regexp_extract(F.coalesce("uri", F.lit("")), r"://([^/?#]*)", 1), F.lit(BLANK))
    about = F.concat_ws("", *[F.concat(F.lit(f"{k}: "), v, F.lit(LINE)) for k, v in (("id", F.col("id").cast("string")), ("url", F.to_json(F.struct("url"))))])
    with_capture = lambda kind: (("WARC-Record-ID", _urn(F.col("capture"), F.lit(kind))), when, at, ("WARC-Concurrent-To", F.col("capture")))
    http_type = lambda kind: ("Content-Type", F.lit(f"application/http; msgtype={kind}"))
    sides = F.array(
        _record("request", asked, *with_capture("request"), http_type("request")),
        _record("metadata", about, *with_capture("metadata"), ("Content-Type", F.lit("application/warc-fields"))),
        F.when(
            ~F.col("whole"),
            _record("revisit", http, ("WARC-Record-ID", F.col("capture")), when, at, ("WARC-Payload-Digest", F.col("sha1")), ("WARC-Refers-To", F.col("original")), ("WARC-Profile", F.lit(SAME_PAYLOAD)), http_type("response")),
        ),
    )
    bodies = rows.groupBy("same").agg(F.any_value("payload").alias("payload"))
    response = _record(
        "response", F.concat(http.cast("binary"), F.col("payload")), ("WARC-Record-ID", F.col("capture")), when, at, ("WARC-Payload-Digest", F.col("sha1")), http_type("response")
    )
    records = captures.select(F.explode(F.filter(sides, lambda x: x.isNotNull())).alias("value"))
    records = records.unionByName(captures.where("whole").join(bodies, "same").select(response.alias("value")))
    records.select(F.col("value").cast("string")).write.options(lineSep=BLANK, compression=compression).option("zlib.compress.level", "BEST_SPEED").text(folder)


# ---- reading ------------------------------------------------------------------------------


def _header(head: Column, name: str) -> Column:
    found = F.regexp_extract(head, rf"(?im)^{name}:[ \t]*(.*?)[ \t]*$", 1)
    return F.nullif(found, F.lit(""))


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    """file, block, at, value and sizes: what stands between separators; (block, at) is the order inside a file."""
    text = spark.read.option("lineSep", BETWEEN).text(folder)
    return text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("file_size"),
        F.monotonically_increasing_id().alias("at"),
        "value",
    )


def _with_head(pieces: DataFrame) -> DataFrame:
    """Pieces with their header text, the bytes of what follows, and the Content-Length."""
    head = F.substring_index("value", BLANK, 1)
    return pieces.withColumn("head", head).select(
        "*",
        (F.octet_length("value") - F.octet_length("head") - len(BLANK)).cast("long").alias("room"),
        _header(F.col("head"), "Content-Length").cast("long").alias("length"),
    )


def _marked(pieces: DataFrame) -> DataFrame:
    """file, short, torn: files with a piece shorter than its Content-Length; split files whose pieces do not add up to the file."""
    short = F.coalesce(F.col("room") < F.col("length"), F.lit(True))
    sizes = F.sum(F.octet_length("value") + len(BETWEEN)) - len(BETWEEN)
    torn = (F.max("block") > 0) & (sizes != F.max("file_size"))
    return _with_head(pieces).groupBy("file").agg(F.bool_or(short).alias("short"), torn.alias("torn")).where("short or torn")


def _untorn(spark: SparkSession, files: list[str]) -> DataFrame:
    """The pieces of files read whole.

    Where a split ends in part of a separator, Hadoop's reader of lines may take one piece twice or leave one out. This happens to
    plain files only, since gzipped ones are not split, and is seen from the sizes. One byte is one Latin-1 character here.
    """
    whole = spark.read.format("binaryFile").load(files)
    parts = F.posexplode(F.split(F.decode("content", "ISO-8859-1"), r"\r\n\r\nWARC/1\.", -1))
    cut = whole.select(F.col("path").alias("file"), F.lit(0).cast("long").alias("block"), F.col("length").alias("file_size"), parts.alias("at", "part"))
    return cut.select("file", "block", "file_size", F.col("at").cast("long").alias("at"), F.encode("part", "ISO-8859-1").cast("string").alias("value"))


def _chained(files: pd.DataFrame) -> pd.DataFrame:
    """For the pieces of one file, by their lengths: the number of the record that each belongs to."""
    files = files.sort_values(["block", "at"], ignore_index=True)
    record, got, need, out = -1, 0, 0, []
    for size, head, length in zip(files["size"], files["head_bytes"], files["length"], strict=True):
        if got >= need:
            record, got = record + 1, int(size)
            need = 0 if pd.isna(length) else int(length) + int(head) + len(BLANK)
        else:
            got += len(BETWEEN) + int(size)
        out.append(record)
    return files[["file", "block", "at"]].assign(record=out)


def _joined(pieces: DataFrame) -> DataFrame:
    """Whole records of files in which a payload holds the separator."""
    sizes = _with_head(pieces).select("file", "block", "at", F.octet_length("value").alias("size"), F.octet_length("head").alias("head_bytes"), "length")
    numbered = sizes.groupBy("file").applyInPandas(_chained, "file string, block long, at long, record long")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "value"))), lambda p: p["value"])
    together = pieces.join(numbered, ["file", "block", "at"]).groupBy("file", "record").agg(parts.alias("parts"), F.min("block").alias("block"), F.min("at").alias("at"))
    return together.select("file", "block", "at", F.array_join("parts", BETWEEN).alias("value"))


def _records(pieces: DataFrame) -> DataFrame:
    """The columns of a record; ``whole``: whether the block has the length that its header says."""
    df = _with_head(pieces)
    block = F.substring(F.col("value").cast("binary"), F.octet_length("head") + len(BLANK) + 1, F.col("length").cast("int"))
    concurrent = F.regexp_extract_all("head", F.lit(r"(?im)^WARC-Concurrent-To:[ \t]*(.*?)[ \t]*$"), 1)
    return df.select(
        "file",
        "block",
        "at",
        _header(F.col("head"), "WARC-Record-ID").alias("record_id"),
        F.lower(_header(F.col("head"), "WARC-Type")).alias("record_type"),
        concurrent.alias("concurrent_to"),
        _header(F.col("head"), "WARC-Target-URI").alias("uri"),
        _header(F.col("head"), "WARC-Date").alias("date"),
        _header(F.col("head"), "WARC-Refers-To").alias("refers_to_record"),
        F.regexp_replace(_header(F.col("head"), "WARC-Payload-Digest"), "^[^:]*:", "").alias("stated_digest"),
        _header(F.col("head"), "Content-Type").alias("content_type"),
        (F.col("room") >= F.col("length")).alias("whole"),
        block.alias("content"),
    )


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """A row per record, its block in ``content``. Gzipped files are one streaming task each, plain ones as many as their size asks for."""
    pieces = _pieces(spark, folder)
    marked = stored(_marked(pieces))
    torn = [r["file"] for r in marked.where("torn").select("file").limit(MOST_NAMES + 1).collect()]
    if len(torn) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} plain files that splits tear; gzip them")
    if torn:
        pieces = pieces.where(~F.col("file").isin(torn)).unionByName(_untorn(spark, torn))
    count = marked.count()
    if not count:
        return _records(pieces)
    if count <= MOST_FILTERED:
        among = F.col("file").isin([r["file"] for r in marked.select("file").collect()])
        return _records(pieces.where(~among)).unionByName(_records(_joined(pieces.where(among))))
    files = marked.select("file")
    return _records(pieces.join(files, "file", "left_anti")).unionByName(_records(_joined(pieces.join(files, "file", "left_semi"))))


def with_payload(records: DataFrame) -> DataFrame:
    """Records with ``http`` (the header of an HTTP message) and ``payload``: what follows it, else the whole block."""
    is_http = F.coalesce(F.col("content_type").startswith("application/http"), F.lit(False))
    http = F.when(is_http, F.substring_index(F.col("content").cast("string"), BLANK, 1))
    rest = F.substring(F.col("content"), F.octet_length("http") + len(BLANK) + 1, 2**31 - 1)
    return records.withColumn("http", http).withColumn("payload", F.when(F.col("http").isNotNull(), rest).otherwise(F.col("content"))).drop("content")


def index_archive(records: DataFrame) -> DataFrame:
    """A stored row per record: headers, the payload's length and recomputed digest, and the payload itself of all but captures."""
    df = with_payload(records)
    small = F.when(~F.col("record_type").isin(*CAPTURES), F.col("payload"))
    return stored(df.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "digest": base32(F.sha1("payload")), "payload": small}))


# ---- transactions -------------------------------------------------------------------------


def owners(index: DataFrame) -> DataFrame:
    """record_id, capture: the capture that a request or metadata record belongs to; of several the smallest."""
    is_capture = F.col("record_type").isin(*CAPTURES)
    named = index.select("record_id", is_capture.alias("is_capture"), F.col("record_type").alias("kind"), F.explode("concurrent_to").alias("other"))
    ids = index.select(F.col("record_id").alias("other"), is_capture.alias("other_is_capture"), F.col("record_type").alias("other_kind"))
    links = named.join(ids, "other")
    down = links.where("not is_capture and other_is_capture").select("record_id", F.col("other").alias("capture"))
    up = links.where("is_capture and not other_is_capture").select(F.col("other").alias("record_id"), F.col("record_id").alias("capture"))
    direct = down.unionByName(up).groupBy("record_id").agg(F.min("capture").alias("capture"))
    through = links.where("kind = 'metadata' and other_kind = 'request'").select("record_id", "other")
    further = through.join(direct.withColumnRenamed("record_id", "other"), "other").groupBy("record_id").agg(F.min("capture").alias("by_request"))
    both = direct.join(further, "record_id", "full_outer")
    return both.select("record_id", F.coalesce("capture", "by_request").alias("capture"))


def _side(index: DataFrame, owned: DataFrame, kind: str, fields: dict[str, Any], count: str) -> DataFrame:
    inside = F.struct(F.col("record_id"), *[F.col(v).alias(k) for k, v in fields.items()])
    own = index.where(F.col("record_type") == kind).join(owned, "record_id")
    return own.groupBy("capture").agg(F.min_by(inside, "record_id").alias(kind), F.count("*").alias(count))


def assemble(index: DataFrame) -> DataFrame:
    """A row per capture: record_id, uri, date, request, response, metadata (structs), requests, metadatas."""
    owned = stored(owners(index))
    requests = _side(index, owned, "request", {"http": "http"}, "requests")
    metadata = _side(index, owned, "metadata", {"fields": "payload"}, "metadatas")
    response = F.struct("record_type", "http", "payload_bytes", "digest", "stated_digest", "refers_to_record", "whole")
    captures = index.where(F.col("record_type").isin(*CAPTURES)).select("record_id", "uri", "date", response.alias("response"))
    joined = captures.join(requests.withColumnRenamed("capture", "record_id"), "record_id", "left").join(metadata.withColumnRenamed("capture", "record_id"), "record_id", "left")
    none = F.lit(0).cast("long")
    return joined.withColumns({"requests": F.coalesce("requests", none), "metadatas": F.coalesce("metadatas", none)})


def unclaimed(index: DataFrame, captures: DataFrame) -> DataFrame:
    """Records that no row of ``captures`` nests: strays, and all but the first request and metadata record of a capture."""
    nested = captures.select(F.explode(F.array("record_id", "request.record_id", "metadata.record_id")).alias("record_id"))
    return index.join(nested, "record_id", "left_anti")


def metadata_field(name: str) -> Column:
    """A field of the nested metadata record."""
    return F.nullif(F.regexp_extract(F.col("metadata.fields").cast("string"), rf"(?im)^{name}:[ \t]*(.*?)[ \t]*$", 1), F.lit(""))


def resolve(captures: DataFrame) -> DataFrame:
    """page_id, uri, payload_bytes, payload_digest, record_type, refers_to, sound: captures with what revisits refer to.

    ``sound``: the digest recomputed from the payload (of a revisit: of the response that it refers to) is the stated one.
    """
    flat = captures.select(
        metadata_field("id").cast("long").alias("page_id"), "record_id", "uri", "response.record_type", "response.payload_bytes", "response.digest", "response.stated_digest", "response.refers_to_record"
    )
    revisit = F.col("record_type") == "revisit"
    originals = flat.where(~revisit).select(
        F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("full_bytes"), F.col("digest").alias("full_digest")
    )
    own = flat.where(~revisit).select(
        "page_id", "uri", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"),
        (F.coalesce("stated_digest", "digest") == F.col("digest")).alias("sound"),
    )
    again = flat.where(revisit).drop("payload_bytes", "digest").join(originals, "refers_to_record", "left").select(
        "page_id", "uri", F.col("full_bytes").alias("payload_bytes"), F.coalesce("full_digest", "stated_digest").alias("payload_digest"), "record_type", "refers_to",
        F.coalesce(F.col("stated_digest") == F.col("full_digest"), F.lit(False)).alias("sound"),
    )
    return own.unionByName(again)
