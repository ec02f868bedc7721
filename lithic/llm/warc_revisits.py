"""Operator 7, not-modified revisits of web archives: as-of join by canonical URL.

Records are sorted by canonical URL and time over ranges, so a URL with very many records spreads over several
partitions. Each partition is walked once with the latest full response at hand; what a partition hands to the next is
one row, and only these rows, as many as there are partitions, are seen by the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled

#: What a 304 response may replace in the stored headers; query parameters that do not choose a page.
PERMITTED = frozenset("cache-control content-location date etag expires last-modified vary".split())
TRACKING = r"^(ref|fbclid|gclid|utm_[a-z]+)(=.*)?$"


def canonical_url(url: Column) -> Column:
    """Without scheme, fragment, www. or m., default port, tracking parameters and last slash; host in lower case, parameters sorted."""
    rest = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), "#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^[^/?]*", 0)), "^(www|m)\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(F.lit("")))


def merged_headers(stored: dict[str, str], revisit: dict[str, str]) -> dict[str, str]:
    return stored | {k: v for k, v in revisit.items() if k in PERMITTED}


def _lower(headers) -> dict[str, str]:
    return {str(k).lower(): v for k, v in headers or [] if v is not None}


def validated(stored: dict[str, str], revisit: dict[str, str]) -> bool:
    """Every validator that the revisit names is the stored one (ETags compared weakly), and it names at least one."""
    weak = lambda v: v.removeprefix("W/")
    named = [k for k in ("etag", "last-modified") if k in revisit]
    return bool(named) and all(k in stored and weak(stored[k]) == weak(revisit[k]) for k in named)


def _walk(batch: pa.RecordBatch, at: tuple) -> Iterator[tuple]:
    """Each row with the latest full response of its URL before it: (row, response or None, state after it)."""
    columns = [batch.column(k) for k in range(batch.num_columns)]
    for row in zip(*(c.to_pylist() for c in columns), strict=True):
        url, kind = row[1], row[4]
        if at[0] != url:
            at = (url, None)
        yield row, at[1], at
        if kind == "response":
            at = (url, (row[2], _lower(row[5])))
            yield None, None, at


def _last_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a partition: its number, its last URL, that URL's latest full response in it, and whether it has but one URL."""
    at, first, pid = (None, None), None, None
    for batch in batches:
        if batch.num_rows and pid is None:
            pid, first = batch.column(0)[0].as_py(), batch.column(1)[0].as_py()
        for _, _, state in _walk(batch, at):
            at = state
    if pid is not None:
        known = at[1] or (None, {})
        yield pa.record_batch(
            [pa.array([pid], pa.int32()), pa.array([first]), pa.array([at[0]]), pa.array([known[0]], pa.int64()), pa.array([list(known[1].items())], pa.map_(pa.string(), pa.string())), pa.array([at[1] is not None])],
            ["pid", "first_url", "url", "id", "headers", "known"],
        )


def resolve_revisits(records: DataFrame) -> DataFrame:
    """From records (record_id long, url, ts long, kind, headers map), one row per revisit:
    record_id, canonical, resolved_id, status, headers.

    kind is "response" (full) or "revisit"; others are passed over. A revisit belongs to the latest full response of its
    canonical URL with an earlier ts; of several at one ts, the one with the largest record_id. status: "resolved" with merged
    headers; "validator_mismatch" if a named validator differs or none is named; "no_response" if nothing precedes it.
    Unresolved revisits keep their own headers, and resolved_id is null. A null url is the empty URL, a null ts the
    earliest; null headers are none; header names compare in lower case. Repeated rows are each resolved. Other columns
    are ignored, whatever their names. Very long URLs and headers are kept whole. No rows: no rows.
    """
    order = F.when(F.col("kind") == "response", 1).otherwise(0)  # at one ts, a response comes after the revisits
    rows = records.where(F.col("kind").isin("response", "revisit")).select(
        canonical_url(F.col("url")).alias("canonical"), F.coalesce(F.col("ts"), F.lit(-(1 << 62))).alias("ts"), order.alias("o"), F.col("record_id").cast("long").alias("record_id"), "kind", "headers"
    )
    rows = rows.repartitionByRange("canonical", "ts", "o", "record_id").sortWithinPartitions("canonical", "ts", "o", "record_id")
    rows = settled(rows.select(F.spark_partition_id().alias("pid"), "canonical", "record_id", "ts", "kind", "headers"))
    ends = rows.mapInArrow(_last_states, "pid int, first_url string, url string, id long, headers map<string,string>, known boolean").collect()
    carried, state = {}, (None, None)
    for e in sorted(ends, key=lambda e: e.pid):
        carried[e.pid] = state
        if e.known:
            state = (e.url, (e.id, dict(e.headers)))
        elif state[0] != e.url:
            state = (e.url, None)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            out = []
            if at is None and batch.num_rows:
                at = carried[batch.column(0)[0].as_py()]
            for row, response, state in _walk(batch, at):
                at = state
                if row is None or row[4] != "revisit":
                    continue
                own = _lower(row[5])
                if response is None:
                    out.append((row[2], row[1], None, "no_response", list(own.items())))
                elif validated(response[1], own):
                    out.append((row[2], row[1], response[0], "resolved", list(merged_headers(response[1], own).items())))
                else:
                    out.append((row[2], row[1], None, "validator_mismatch", list(own.items())))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()))
            yield pa.record_batch([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["record_id", "canonical", "resolved_id", "status", "headers"])

    return rows.mapInArrow(each, "record_id long, canonical string, resolved_id long, status string, headers map<string,string>")


def capture_log(pages: DataFrame) -> DataFrame:
    """A crawl of ``pages``: records for resolve_revisits, two with each page's own URL and one with a URL that eight pages share.

    Page p is fetched in full at 10p, with an ETag of its content, and asked for again later; the answer is "not modified",
    for the content first seen. The section of page p, one URL for eight pages but for a tracking parameter, is asked for at
    10p + 5: first by a revisit that nothing precedes, then it is fetched in full, met again unchanged and with another
    validator, fetched anew, and met again with the old, with the new (weak) and without a validator. Rows without an id
    are passed over.
    """
    text = lambda c: c.cast("string")
    place = F.pmod(F.col("page_id"), F.lit(8))
    group = ((F.col("page_id") - place) / 8).cast("long")
    version = lambda n: F.concat(F.lit('"s'), text(group), F.lit(f'-{n}"'))
    etag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce(F.col("html"), F.lit("")).cast("binary")), 1, 16), F.lit('"'))
    again = 10 * F.col("page_id") + 1 + 20 * (F.length(F.coalesce(F.col("url"), F.lit(""))) % 64)
    size = text(F.octet_length(F.coalesce("html", F.lit(""))))

    def record(k: int, url, ts, kind, tag, length):
        headers = F.map_filter(F.create_map(F.lit("ETag"), tag, F.lit("Content-Length"), length, F.lit("Date"), text(ts)), lambda _, v: v.isNotNull())
        return F.struct((4 * F.col("page_id") + k).alias("record_id"), url.alias("url"), ts.alias("ts"), kind.alias("kind"), headers.alias("headers"))

    full = place.isin(1, 4)
    tag = F.when(place.isin(0, 1, 2, 5), version(1)).when(place == 3, version(0)).when(place == 4, version(2)).when(place == 6, F.concat(F.lit("W/"), version(2)))
    section = F.concat(F.lit("https://www.example.org/section/"), text(group), F.lit("?ref="), text(F.col("page_id")))
    records = F.array(
        record(0, F.col("url"), 10 * F.col("page_id"), F.lit("response"), etag, size),
        record(1, F.col("url"), again, F.lit("revisit"), etag, F.lit("0")),
        record(2, section, 10 * F.col("page_id") + 5, F.when(full, "response").otherwise("revisit"), tag, F.when(full, size).otherwise("0")),
    )
    return pages.where("page_id IS NOT NULL").select(F.explode(records).alias("r")).select("r.*")


SQL = r"""
WITH p AS (
  SELECT page_id, regexp_replace(regexp_replace(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS rest,
         '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS etag, strlen(coalesce(html, '')) AS size, 10 * page_id + 1 + 20 * (length(coalesce(url, '')) % 64) AS ts
  FROM pages WHERE page_id IS NOT NULL),
q AS (
  SELECT page_id, etag, size, ts, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), '^(www|m)\.', ''), ':(80|443)$', '') AS host,
         regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/$', '') AS path,
         list_sort([x FOR x IN string_split(regexp_extract(rest, '\?(.*)$', 1), '&') IF x <> '' AND NOT regexp_matches(x, '^(ref|fbclid|gclid|utm_[a-z]+)(=.*)?$')]) AS params
  FROM p),
c AS (SELECT page_id, etag, size, ts, host || path || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canonical,
             'example.org/section/' || (page_id // 8) AS section, '"s' || (page_id // 8) || '-' AS of FROM q),
f AS (
  SELECT 4 * page_id AS record_id, canonical, 10 * page_id AS ts, etag, size FROM c
  UNION ALL SELECT 4 * page_id + 2, section, 10 * page_id + 5, of || CASE page_id % 8 WHEN 1 THEN '1"' ELSE '2"' END, size FROM c WHERE page_id % 8 IN (1, 4)),
r AS (
  SELECT 4 * page_id + 1 AS record_id, canonical, ts, etag FROM c
  UNION ALL SELECT 4 * page_id + 2, section, 10 * page_id + 5, CASE page_id % 8 WHEN 3 THEN of || '0"' WHEN 6 THEN 'W/' || of || '2"' WHEN 7 THEN NULL ELSE of || '1"' END
  FROM c WHERE page_id % 8 NOT IN (1, 4)),
j AS (SELECT r.*, f.record_id AS found, f.size, coalesce(f.etag = replace(r.etag, 'W/', ''), FALSE) AS fits FROM r ASOF LEFT JOIN f ON r.canonical = f.canonical AND f.ts < r.ts)
SELECT record_id, canonical, CASE WHEN fits THEN CAST(found AS STRING) END AS resolved_id, CASE WHEN found IS NULL THEN 'no_response' WHEN fits THEN 'resolved' ELSE 'validator_mismatch' END AS status,
       'content-length: ' || CASE WHEN fits THEN size ELSE 0 END || chr(10) || 'date: ' || ts || coalesce(chr(10) || 'etag: ' || etag, '') AS headers
FROM j
"""
