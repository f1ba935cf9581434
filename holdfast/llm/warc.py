"""WARC archives: writing captures, reading them back, and one globally ordered index.

Records are text: headers, an HTTP response head and the page, each record closed by two
line ends, which is the line separator of Spark's text format here. So Spark's own writer
and reader handle the archives, in any store that Spark reaches. Each file is gzipped, is
read as a whole by one task, and holds its captures in order of URL key, time and id: a
locally sorted run. The index entries of all runs are dealt out by ranges of that order, and
a loser tree merges the runs within each range.

Of records with equal payloads of at least `least` bytes the one with the largest id carries
the payload, the others are revisits that refer to it.

Cases: a null page is an empty payload; a null url has no target header and an empty key; a
null id counts as smaller than all others. Rows that share the largest id of their payload
all carry it. Line ends in urls are written percent-encoded. Without a time column, the time
of a capture is its id in seconds after `epoch`. Other columns are ignored; an empty table
gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.session import cut_lineage, fresh_dir

END = "\r\n\r\n"
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


@dataclass(frozen=True)
class Archive:
    """`least` bytes for a payload to be shared; `salts` parts that a payload's rows are
    joined in; about `entries` index entries are merged in one task.
    """

    least: int = 0
    salts: int = 16
    epoch: int = 1_600_000_000
    entries: int = 200_000


def base32_sha1(text: Column) -> Column:
    """SHA-1 of the UTF-8 bytes as 32 upper-case base32 digits: four groups of 40 bits."""
    digest = F.sha1(text.cast("binary"))
    groups = [
        F.lpad(F.conv(F.substring(digest, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)
    ]
    return F.translate(F.concat(*groups), _DIGITS, _BASE32)


def url_key(url: Column) -> Column:
    """Host labels from the right, then the rest of the url in lower case."""
    rest = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^.*?://", ""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    labels = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.concat(labels, F.lit(")"), tail)


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _id(number: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(number.cast("string"), F.lit("")), F.lit(">"))


def captures(
    pages: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
    page_column: str = "html",
    time_column: str | None = None,
    how: Archive = Archive(),
) -> DataFrame:
    """(id, url, time, payload, size, digest, refers_to) per row; `refers_to` for revisits."""
    number = F.col(id_column).cast("bigint")
    time = F.col(time_column).cast("timestamp") if time_column else F.timestamp_seconds(
        F.lit(how.epoch) + F.coalesce(number, F.lit(0))
    )
    rows = pages.select(
        number.alias("id"),
        F.replace(
            F.replace(F.col(url_column), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")
        ).alias("url"),
        time.alias("time"),
        F.coalesce(F.col(page_column), F.lit("")).alias("payload"),
    ).withColumns(
        {
            "size": F.octet_length("payload").cast("bigint"),
            "digest": base32_sha1(F.col("payload")),
        }
    )
    shared = (
        rows.where(F.col("size") >= how.least)
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("chief"))
        .where("n > 1")
        .select(
            "digest", "chief", F.explode(F.sequence(F.lit(0), F.lit(how.salts - 1))).alias("salt")
        )
    )
    salt = F.pmod(F.xxhash64("id", "url"), F.lit(how.salts)).cast("int")
    other = F.col("chief").isNotNull() & ~F.col("id").eqNullSafe(F.col("chief"))
    return (
        rows.withColumn("salt", salt)
        .join(shared, ["digest", "salt"], "left")
        .select(
            "id", "url", "time", "payload", "size", "digest",
            F.when(other, F.col("chief")).alias("refers_to"),
        )
    )


def write_archive(captured: DataFrame, path: str) -> str:
    """One gzipped WARC file per task, its captures in order of key, time and id."""
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("size").cast("string"),
        F.lit(END),
    )
    revisit = F.col("refers_to").isNotNull()
    length = F.octet_length(head) + F.when(revisit, 0).otherwise(F.col("size"))
    profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\n"),
        _line("WARC-Record-ID", _id(F.col("id"))),
        _line("WARC-Date", F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.coalesce(_line("WARC-Target-URI", F.col("url")), F.lit("")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(
            revisit,
            F.concat(
                _line("WARC-Refers-To", _id(F.col("refers_to"))),
                _line("WARC-Profile", F.lit(profile)),
            ),
        ).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        length.cast("string"),
        F.lit(END),
        head,
        F.when(revisit, "").otherwise(F.col("payload")),
    )
    ordered = captured.withColumn("key", url_key(F.col("url"))).sortWithinPartitions(
        "key", "time", "id"
    )
    ordered.select(record.alias("value")).write.option("lineSep", END).option(
        "compression", "gzip"
    ).text(path)
    return path


ENTRY = (
    "file string, offset bigint, length bigint, id bigint, url string, time string,"
    " size bigint, digest string, type string, refers_to bigint"
)


def _number(value: str) -> int | None:
    inside = value.removeprefix("<urn:page:").removesuffix(">")
    return int(inside) if inside else None


def _entry(file: str, offset: int, record: bytes, head: dict[str, str]) -> dict:
    """Index entry of one record; the digest of a payload that is here is made anew."""
    http, _, payload = record.partition(END.encode())
    said = head["WARC-Payload-Digest"].removeprefix("sha1:")
    sizes = [x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if head["WARC-Type"] == "response":
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if digest != said or int(sizes[0].split(b":")[1]) != len(payload):
            raise ValueError(f"record {head['WARC-Record-ID']} in {file} is damaged")
    return {
        "file": file,
        "offset": offset,
        "length": len(record),
        "id": _number(head["WARC-Record-ID"]),
        "url": head.get("WARC-Target-URI"),
        "time": head["WARC-Date"],
        "size": int(sizes[0].split(b":")[1]),
        "digest": said,
        "type": head["WARC-Type"],
        "refers_to": _number(head.get("WARC-Refers-To", "")),
    }


class _Reader:
    """Takes the pieces of one archive in order and returns the records that are complete."""

    def __init__(self, file: str):
        self.file, self.at = file, 0
        self.held: list[bytes] = []
        self.size = 0
        self.head: dict[str, str] | None = None
        self.need = 0

    def take(self, piece: bytes) -> Iterator[dict]:
        self.held += [piece, END.encode()]
        self.size += len(piece) + len(END)
        while True:
            if self.head is None:
                raw = b"".join(self.held)
                begin = len(raw) - len(raw.lstrip(b"\r\n"))
                stop = raw.find(END.encode(), begin)
                if stop < 0 or begin == len(raw):
                    self.held = [raw]
                    return
                lines = raw[begin:stop].decode().split("\r\n")
                self.head = dict(x.split(": ", 1) for x in lines[1:])
                self.need = int(self.head["Content-Length"])
                rest = raw[stop + len(END) :]
                self.at += stop + len(END)
                self.held, self.size = [rest], len(rest)
            if self.size < self.need:
                return
            raw = b"".join(self.held)
            yield _entry(self.file, self.at, raw[: self.need], self.head)
            rest = raw[self.need :]
            self.at += self.need
            self.held, self.size, self.head = [rest], len(rest), None


def _schema(fields: str) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64()}
    pairs = (f.split() for f in fields.split(","))
    return pa.schema([(name, kinds[kind]) for name, kind in pairs])


def _parsed(batches):
    schema, reader = _schema(ENTRY), None
    for batch in batches:
        out = []
        for file, piece in zip(
            batch.column("file").to_pylist(), batch.column("value").cast(pa.binary()).to_pylist()
        ):
            if reader is None or reader.file != file:
                reader = _Reader(file)
            out.extend(reader.take(piece))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of all records of an archive, with the key they are ordered by."""
    # A gzipped file is never split, so its pieces reach one task in order.
    lines = spark.read.option("lineSep", END).text(path)
    pieces = lines.select(F.col("_metadata.file_path").alias("file"), "value")
    return pieces.mapInArrow(_parsed, ENTRY).withColumn("key", url_key(F.col("url")))


class LoserTree:
    """Merges sorted runs: each inner place keeps the loser of its match, place 0 the winner.

    Taking the least item replays the matches on one way up: one comparison per level.
    """

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.k = runs, len(runs)
        self.items = [next(r, None) for r in runs]
        self.losers = [-1] * max(self.k, 1)
        for run in range(self.k):
            self._play(run)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.items[a], self.items[b]
        if x is None or y is None:
            return y is None and x is not None
        return (x, a) < (y, b)

    def _play(self, run: int) -> None:
        place = (run + self.k) // 2
        while place > 0:
            other = self.losers[place]
            if other < 0:
                # The first to come waits here for its opponent.
                self.losers[place] = run
                return
            if self._before(other, run):
                self.losers[place], run = run, other
            place //= 2
        self.losers[0] = run

    def __iter__(self) -> Iterator[tuple]:
        while self.k:
            run = self.losers[0]
            if self.items[run] is None:
                return
            yield self.items[run]
            self.items[run] = next(self.runs[run], None)
            self._play(run)


def _merge(batches):
    runs: dict[str, list[tuple]] = {}
    schema = None
    for batch in batches:
        schema, names = batch.schema, batch.schema.names
        places = [names.index(c) for c in ("key", "time", "id", "file", "offset")]
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            key, time, number, file, offset = (row[p] for p in places)
            order = (key, time, number is not None, number or 0, file, offset)
            runs.setdefault(file, []).append((order, row))
    # Runs come sorted; the shuffle may have brought a run's pieces in another order.
    for run in runs.values():
        run.sort()
    merged = iter(LoserTree([iter(runs[file]) for file in sorted(runs)]))
    while rows := [row for _, row in islice(merged, 10_000)]:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def merged_index(entries: DataFrame, how: Archive = Archive()) -> DataFrame:
    """The index in global order: by url key, then time, id, file and place in the file.

    Partitions are consecutive ranges of the whole order, so a url with any number of
    captures is spread over as many of them as it fills.
    """
    held = cut_lineage(entries)
    parts = 1 + held.count() // how.entries
    ranged = held.repartitionByRange(parts, "key", "time", "id", "file", "offset")
    return ranged.mapInArrow(_merge, held.schema)


def archived(
    pages: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
    page_column: str = "html",
    path: str | None = None,
    how: Archive = Archive(),
) -> DataFrame:
    """Write all pages to an archive, read it back, and return its merged index.

    Without a `path` the archive goes to the shared folder of the session.
    """
    spark = pages.sparkSession
    path = path or fresh_dir(spark, "warc")
    write_archive(captures(pages, id_column, url_column, page_column, how=how), path)
    return merged_index(read_archive(spark, path), how)
