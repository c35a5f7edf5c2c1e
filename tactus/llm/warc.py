"""Operator 2: resolution of not-modified revisits in WARC captures.

``read_warc`` parses WARC files (plain, or gzip with a member per record or not) to one row per
record; ``resolve`` joins every revisit as of its time with the latest earlier full response
of the same canonical URL, checks validators and merges the headers a 304 may update.

Files are cut at record boundaries by Spark's line reader, which streams and decompresses them
and splits plain ones: a task holds some records at a time, never a file.

The as-of join is a union and a running ``last`` within (URL, time slice); slices are cut at
quantiles of time, and each starts from the last response of the slices before it, found over
one row per slice.  So a URL that holds a third of all captures is dealt over the slices.
Payloads never move: the result names the record that holds the payload.

Defined results: a revisit without an earlier response is 'unresolved'; a null URL never
resolves; a response without time answers no revisit, and a revisit without time is
'unresolved'; at equal times a response comes before a revisit, and of responses the larger id
is later; null headers are empty; repeated rows each give a row; an empty table gives none.  A
record whose length is missing or no number has ``problem`` 'length' and all bytes to the next
record as payload; one shorter than its length, as where a payload holds what looks like the
next record's start, has 'truncated'.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tactus.llm.storage import staged

#: Header fields that a 304 response updates in the stored one; all others stay as stored.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
#: Query parameters that don't name another resource.
TRACKING = ["fbclid", "gclid", "ref", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term"]


def canonical_url(url) -> F.Column:
    """Scheme and leading www. or m. dropped, host lower-cased, default port, fragment, tracking
    parameters and trailing slash dropped, parameters sorted."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    bare = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), r"^(www|m)\.|:(80|443)$", "")
    host = F.regexp_replace(host, r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(TRACKING)))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))


SCHEMA = "record_id string, kind string, url string, ts timestamp, status int, headers map<string,string>, payload binary, problem string"
#: What stands between two records, with the start of the next.
BETWEEN = "\r\n\r\nWARC/1."


def parse(raw: bytes) -> dict | None:
    """A record from its version line on (its start, as far as the digit after 'WARC/1.', may be cut off).
    Header names in lower case, HTTP headers of response and revisit records."""
    f = io.BytesIO(raw)
    if not f.readline().strip():
        return None
    head = _headers(f)
    rest = f.read()
    length = head.get("content-length", "")
    problem = None if length.isdecimal() else "length"
    if problem is None:
        problem = "truncated" if len(rest) < int(length) else None
        rest = rest[: int(length)]
    body, status, http = rest, None, {}
    if body.startswith(b"HTTP/"):
        b = io.BytesIO(body)
        parts = b.readline().split()
        status = int(parts[1]) if len(parts) > 1 and parts[1].isdigit() and len(parts[1]) < 10 else None
        http, body = _headers(b), b.read()
    return {"record_id": head.get("warc-record-id"), "kind": head.get("warc-type"), "url": head.get("warc-target-uri"), "ts": head.get("warc-date"), "status": status, "headers": list(http.items()), "payload": body, "problem": problem}


def _headers(f: io.BytesIO) -> dict[str, str]:
    out: dict[str, str] = {}
    while (line := f.readline().strip()) != b"":
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the WARC files at ``path`` (gzip by the extension .gz)."""
    kind = pa.schema([("record_id", pa.string()), ("kind", pa.string()), ("url", pa.string()), ("ts", pa.string()), ("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("problem", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = [x for raw in rows.column(0) if (x := parse(raw.as_py())) is not None]
            if found:
                yield pa.RecordBatch.from_pylist(found, kind)

    records = spark.read.option("lineSep", BETWEEN).text(path).select(F.col("value").cast("binary").alias("raw"))
    return records.mapInArrow(run, SCHEMA.replace("ts timestamp", "ts string")).withColumn("ts", F.try_to_timestamp("ts"))


def resolve(captures: DataFrame, slices: int = 64) -> DataFrame:
    """Revisits of ``captures`` (record_id, kind 'response' or 'revisit', url, ts, headers) with the
    response each stands for: record_id, canonical, resolved_id, outcome, headers.

    outcome: 'etag' or 'last-modified' if that validator of the revisit equals the response's (an
    ETag decides where both have one, weak comparison); 'mismatch' if it differs (no payload is
    taken); 'no validator' if none can be compared (the latest response is taken on time alone);
    'unresolved' without an earlier response.  headers: the response's with the permitted fields
    of the revisit over them; for a mismatch or an unresolved revisit its own.
    """
    empty = F.create_map().cast("map<string,string>")
    own = captures.where(F.col("kind").isin("response", "revisit")).select("record_id", "kind", canonical_url(F.col("url")).alias("canonical"), "ts", F.coalesce("headers", empty).alias("headers"))
    own = staged(own, "captures")
    at = F.col("ts").cast("double")
    cuts = own.agg(F.percentile_approx(at, [k / slices for k in range(1, slices)], 10_000)).first()[0] if slices > 1 else None
    cuts = sorted(set(cuts or []))
    slice_ = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= at)) if cuts else F.lit(0)
    sliced = own.where("kind = 'revisit' or ts is not null").withColumn("slice", F.when(F.col("ts").isNotNull(), slice_))
    full = F.when(F.col("kind") == "response", F.struct("ts", "record_id", "headers"))
    by_slice = sliced.where("kind = 'response' and canonical is not null").groupBy("canonical", "slice").agg(F.max_by(F.struct("ts", "record_id", "headers"), F.struct("ts", "record_id")).alias("latest"))
    # the last response of each slice stands at the start of the next slices' rows
    needed = sliced.where("canonical is not null").select("canonical", "slice").distinct().join(by_slice, ["canonical", "slice"], "left")
    before = needed.select("canonical", "slice", F.last("latest", True).over(Window.partitionBy("canonical").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    joined = sliced.join(before, ["canonical", "slice"], "left")
    run = Window.partitionBy("canonical", "slice").orderBy("ts", F.col("kind") == "revisit", "record_id").rowsBetween(Window.unboundedPreceding, 0)
    found = joined.withColumn("full", F.coalesce(F.last(full, True).over(run), "carried")).where("kind = 'revisit'")
    found = found.withColumn("full", F.when(F.col("canonical").isNotNull() & F.col("ts").isNotNull(), F.col("full")))
    bare = lambda h: F.regexp_replace(h["etag"], "^W/", "")
    old, new = F.col("full.headers"), F.col("headers")
    outcome = (
        F.when(F.col("full").isNull(), "unresolved")
        .when(bare(old).isNotNull() & bare(new).isNotNull(), F.when(bare(old) == bare(new), "etag").otherwise("mismatch"))
        .when(old["last-modified"].isNotNull() & new["last-modified"].isNotNull(), F.when(old["last-modified"] == new["last-modified"], "last-modified").otherwise("mismatch"))
        .otherwise("no validator")
    )
    permitted = F.map_filter(new, lambda k, _: k.isin(PERMITTED))
    stays = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(permitted), k))
    return found.withColumn("outcome", outcome).select(
        "record_id",
        "canonical",
        F.when(~F.col("outcome").isin("unresolved", "mismatch"), F.col("full.record_id")).alias("resolved_id"),
        F.col("full.record_id").alias("latest_id"),
        "outcome",
        F.when(F.col("outcome").isin("unresolved", "mismatch"), new).otherwise(F.map_concat(stays, permitted)).alias("headers"),
    )
