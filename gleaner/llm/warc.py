"""WARC archives with payload deduplication and an externally merged capture index.

Writing: every page becomes a WARC/1.1 record; of records with equal payloads (by SHA-1) the one
with the smallest id is the response and the others are revisits of it. Pages are dealt to
archives of bounded size, sorted by URL key and time within each (a run), built as one string
column by SQL functions, and compressed as a gzip member each in their tasks. Spark's text writer
puts them down, its line end being the member's last byte (0, as a member tells its size last and
larger ones are followed by an empty member). So archives go wherever Spark can write.

Reading: archives are read whole as binary files and walked member by member, so a payload may
hold anything. Each archive's records are a sorted run of the capture index, which has a record's
place and length in the archive: fetch() takes single records out and unpacks only them.
Ranges of the key space gather their part of every run, and a loser tree merges the k runs of a
range; ranges in order are the global capture history.

Null html is an empty payload; a null url has an empty key; null ids sort last and have no id
header; repeated rows are captures of their own, of which one is the response; an empty table
gives an empty result; only the id, url and html columns are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import time
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import LOWER, NUMBER_BATCH, TEXT_BATCH, UPPER, batch_rows, cut, shared_dir, with_row

#: Bytes of payload in an archive, about; index entries in a range of the merge, about.
ARCHIVE_BYTES, RANGE_ROWS = 16 << 20, 200_000
#: Captures without a time of their own are this many seconds after 1970, plus their id.
FIRST_SECOND = 1_704_067_200
_INDEX = "archive string, offset long, length long, surt string, captured string, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, intact boolean"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of SHA-1, without Python: five hex digits are four base32 digits."""
    digits = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def url_key(url: Column) -> Column:
    """Host labels in reverse, then the path: com,example)/a."""
    rest = F.translate(F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^[^:]*://", ""), UPPER, LOWER)
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.substr(rest, F.length(host) + 1))


def captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, runs: int = 1) -> DataFrame:
    """Each page with its payload, digest, and - if it is a revisit - the id of its response, dealt to so many runs."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = with_row(pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), html.alias("html")))
    facts = cut(rows.select("_row", "page_id", F.octet_length("html").cast("long").alias("payload_bytes"), base32_sha1(F.col("html").cast("binary")).alias("payload_digest")))
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "_row")
    firsts = facts.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    revisits = facts.where(F.col("payload_bytes") >= min_bytes).join(firsts, "payload_digest").where("first._row <> _row").select("_row", F.col("first.page_id").alias("refers_to"), F.col("first._row").alias("refers_row"), F.lit("revisit").alias("record_type"))
    decided = facts.join(revisits, "_row", "left").withColumn("record_type", F.coalesce("record_type", F.lit("response"))).drop("page_id")
    return rows.repartition(runs, "_row").join(decided, "_row")  # the deal serves the join too, so payloads move once


def records(captured: DataFrame) -> DataFrame:
    """(value): one WARC record a row; sorted within archives."""
    at = F.timestamp_seconds(F.lit(FIRST_SECOND) + F.coalesce(F.pmod(F.col("page_id"), F.lit(1_000_000_000)), F.lit(0)))
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    identity = lambda *key: F.regexp_replace(F.md5(F.concat_ws("/", *key)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"),
        F.lit("\r\nWARC-Record-ID: "), identity(F.col("page_id").cast("string"), F.col("_row").cast("string")),
        F.lit("\r\nWARC-Date: "), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit("\r\nWARC-Target-URI: "), uri,
        F.coalesce(F.concat(F.lit("\r\nX-Page-Id: "), F.col("page_id").cast("string")), F.lit("")),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), identity(F.col("refers_to").cast("string"), F.col("refers_row").cast("string")), F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), F.coalesce(F.concat(F.lit("\r\nX-Refers-To-Page-Id: "), F.col("refers_to").cast("string")), F.lit("")))).otherwise(F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "),
        (F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))).cast("string"), F.lit("\r\n\r\n"),
    )
    value = F.concat(head, http, F.when(revisit, F.lit("")).otherwise(F.col("html")), F.lit("\r\n\r\n"))
    return captured.withColumn("surt", url_key(F.col("url"))).withColumn("at", at).sortWithinPartitions("surt", "at", "page_id", "_row").select(value.alias("value"))


_INFO = b"software: gleaner\r\nformat: WARC File Format 1.1\r\n"


def member(record: bytes) -> bytes:
    """A record as a gzip member that ends in a zero byte."""
    packed = gzip.compress(record, 6, mtime=0)
    return packed if packed[-1] == 0 else packed + gzip.compress(b"", mtime=0)


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The members of an archive, less their last bytes; a warcinfo record comes first."""
    begun = False
    for batch in batches:
        records = [x.encode("utf-8", "surrogatepass") for x in batch["value"]]
        if records and not begun:
            head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, hashlib.sha1(records[0]).hexdigest())}>\r\n"
            head += f"WARC-Date: {time.strftime('%Y-%m-%dT%H:%M:%SZ', time.gmtime(FIRST_SECOND))}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(_INFO)}\r\n\r\n"
            records, begun = [head.encode() + _INFO + b"\r\n\r\n", *records], True
        yield pd.DataFrame({"value": [member(r)[:-1] for r in records]})


def write(pages: DataFrame, path: str, **columns) -> str:
    """Writes the archives to a new folder and returns its path."""
    spark = pages.sparkSession
    total = pages.agg(F.sum(F.octet_length(columns.get("html_col", "html")))).first()[0] or 0
    # not fewer than a join has partitions, or Spark would deal once more
    runs = max(-(-total // ARCHIVE_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    batch_rows(spark, TEXT_BATCH)
    packed = records(captures(pages, runs=runs, **columns)).mapInPandas(_packed, "value binary")
    packed.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").text(path)
    return path


def _unpacked(data: bytes, at: int, step: int = 1 << 14) -> tuple[bytes, int]:
    """(content, end) of the gzip member at a place."""
    unpacker, parts = zlib.decompressobj(31), []
    while not unpacker.eof:
        if at >= len(data):
            raise ValueError("an archive ends inside a member")
        parts.append(unpacker.decompress(data[at : at + step]))
        at += min(step, len(data) - at)
    return b"".join(parts), at - len(unpacker.unused_data)


def walk(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each record of an archive, a gzip member each."""
    held, at = None, 0
    while at < len(data):
        part, end = _unpacked(data, at)
        if part and held:
            yield held[0], at - held[0], *parsed(held[1], held[0])
        if part:
            held = at, part
        at = end  # an empty member belongs to the record before it
    if held:
        yield held[0], at - held[0], *parsed(held[1], held[0])


def parsed(record: bytes, at: int = 0) -> tuple[dict[str, str], bytes]:
    """(headers, block) of a record; a block that doesn't end where its length says raises ValueError."""
    end = record.index(b"\r\n\r\n")
    version, *lines = record[:end].decode("utf-8", "surrogateescape").split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines)
    if not version.startswith("WARC/"):
        raise ValueError(f"no record at byte {at}")
    if record[end + 4 + int(headers["Content-Length"]) :] != b"\r\n\r\n":
        raise ValueError(f"the record at byte {at} doesn't end where its length says")
    return headers, record[end + 4 : -4]


def _files(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def read(spark, path: str) -> DataFrame:
    """The capture index of all archives, a sorted run each; payload facts are taken from the payloads themselves."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                rows = []
                for offset, length, h, block in walk(content):
                    kind = h["WARC-Type"]
                    if kind not in ("response", "revisit"):
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    stated = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response":
                        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    else:
                        size, digest = int(http.rsplit(b"Content-Length: ", 1)[1]), stated
                    number = lambda key: int(h[key]) if key in h else None
                    rows.append((name.rsplit("/", 1)[-1], offset, length, h["WARC-Target-URI"], h["WARC-Date"], number("X-Page-Id"), kind, number("X-Refers-To-Page-Id"), size, digest, digest == stated))
                yield pd.DataFrame(rows, columns=["archive", "offset", "length", "surt", "captured", "page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "intact"]).astype({"page_id": "Int64", "refers_to": "Int64"})

    batch_rows(spark, 1)  # an archive at a time
    found = _files(spark, path).mapInPandas(run, _INDEX).withColumn("surt", url_key(F.col("surt")))
    index = cut(found)
    batch_rows(spark, NUMBER_BATCH)
    return index


def fetch(spark, path: str, entries: DataFrame) -> DataFrame:
    """(archive, offset, headers, block) of index entries (archive, offset, length): only these records are unpacked."""
    wanted = entries.groupBy("archive").agg(F.collect_list(F.struct("offset", "length")).alias("places"))  # an archive's records at most
    met = _files(spark, path).withColumn("archive", F.element_at(F.split("path", "/"), -1)).join(wanted, "archive")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, content, places in zip(batch["archive"], batch["content"], batch["places"]):
                rows = [(archive, p["offset"], *parsed(gzip.decompress(content[p["offset"] : p["offset"] + p["length"]]), p["offset"])) for p in places]
                yield pd.DataFrame(rows, columns=["archive", "offset", "headers", "block"])

    batch_rows(spark, 1)
    return met.select("archive", "content", "places").mapInPandas(run, "archive string, offset long, headers map<string,string>, block binary")


class LoserTree:
    """Merges sorted runs: each inner place keeps the loser of its match, so the next item costs one path."""

    def __init__(self, runs: list[list]):
        self.runs, self.at = runs, [0] * len(runs)
        self.tree = [-1] * max(1, len(runs))
        for i in range(len(runs)):
            self._replay(i)

    def _key(self, i: int):
        return self.runs[i][self.at[i]] if self.at[i] < len(self.runs[i]) else None

    def _beats(self, a: int, b: int) -> bool:
        x, y = self._key(a), self._key(b)
        return x is not None and (y is None or (x, a) < (y, b))

    def _replay(self, i: int) -> None:
        place = (i + len(self.runs)) // 2
        while place:
            if self.tree[place] < 0:
                self.tree[place] = i
                return
            if self._beats(self.tree[place], i):
                self.tree[place], i = i, self.tree[place]
            place //= 2
        self.tree[0] = i

    def __iter__(self):
        while self.runs and self._key(i := self.tree[0]) is not None:
            yield i, self.at[i]
            self.at[i] += 1
            self._replay(i)


def merged(index: DataFrame) -> DataFrame:
    """The index in global order of (surt, captured, page_id), with place: its position in its range; ranges are the partitions."""
    names = [f.split()[0] for f in _INDEX.split(", ")]
    ranges = max(1, -(-index.count() // RANGE_ROWS))

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)  # about RANGE_ROWS entries
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True)
        runs = [g for _, g in rows.groupby("archive", sort=True)]
        big = 1 << 63
        keys = [list(zip(g["surt"], g["captured"], g["page_id"].fillna(big), g["offset"])) for g in runs]
        at = [g.index.to_numpy() for g in runs]
        order = [at[i][j] for i, j in LoserTree(keys)]
        yield rows.loc[order].assign(place=range(len(order)))[[*names, "place"]].astype({"page_id": "Int64", "refers_to": "Int64"})

    # within a range, each archive's entries come in its own order
    dealt = index.repartitionByRange(ranges, "surt", "captured", "page_id", "archive", "offset").sortWithinPartitions("archive", "surt", "captured", F.col("page_id").asc_nulls_last(), "offset")
    return dealt.mapInPandas(merge, f"{_INDEX}, place long")


def op8_warc_index(spark, sf_dir):
    path = write(spark.read.parquet(f"{sf_dir}/pages.parquet"), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    return merged(read(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def oracle() -> str:
    return """
WITH p AS (SELECT row_number() OVER () AS r, page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT r, page_id, strlen(html)::BIGINT AS payload_bytes, upper(sha1(html)) AS h FROM p),
f AS (SELECT *, first_value(page_id) OVER w AS first_id, row_number() OVER w AS k FROM d WINDOW w AS (PARTITION BY h ORDER BY page_id NULLS LAST, r))
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(h, (i // 4 * 5 + 1)::INT, 5))::INT) >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN k > 1 THEN first_id END AS refers_to
FROM f"""
