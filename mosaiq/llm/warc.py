"""WARC archives: a deterministic sharded writer, and a reader.

Records are sorted into ranges of their ids, one range a shard, of about equal payload
bytes. A shard's records go to gzip files (one member a record), a new file being started
when the current one's compressed size has reached a limit. Headers, record ids and
digests are made from the records alone, so the same table gives the same bytes in every
run and on every retry. A task writes under a temporary name and moves the file to its
final name when it is whole; then the shard's manifest of its files is moved into place,
and last the archive's manifest, which says how many shards, files, records and bytes
there are and without which an archive is not complete.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mosaiq.llm._common import written
from mosaiq.runtime import scratch, ship

#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 100
#: Compressed bytes after which a file is closed, and payload bytes of a shard; with more than ``MAX_SHARDS`` of them shards are larger.
ROLL_BYTES, SHARD_BYTES, MAX_SHARDS = 64 << 20, 64 << 20, 1 << 17
#: Keys that a task sums up where ranges are cut.
TASK_KEYS = 1_000_000
DATE = "2000-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_READ = 1 << 20


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record_id(page_id: int | None, digest: str, copy: int = 0) -> str:
    """By id, payload and, where a row is repeated, the number of the copy."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}|{digest}|{copy}')}>"


def _line(name: str, value: str) -> str:
    return f"{name}: {value}\r\n"


def _uri(url: str | None) -> str:
    """The address with white space and control characters escaped, as a header can hold it."""
    return "".join(c if c.isprintable() and not c.isspace() else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, copy: int = 0) -> bytes:
    """A response, or a revisit of the record ``refers_to``, whose payload it leaves out.

    An address that a header cannot hold as it is, or that is null, is given once more in JSON.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = "WARC/1.1\r\n" + _line("WARC-Type", "response" if refers_to is None else "revisit")
    head += _line("WARC-Record-ID", record_id(page_id, digest, copy)) + _line("WARC-Date", DATE) + _line("WARC-Target-URI", _uri(url))
    if _uri(url) != url:
        head += _line("X-Target-URL", json.dumps(url))
    head += _line("WARC-Payload-Digest", f"sha256:{digest}") + _line("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")
    if refers_to is not None:
        head += _line("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head += _line("WARC-Refers-To", record_id(refers_to, digest)) + _line("X-Refers-To-Page", str(refers_to))
    if page_id is not None:
        head += _line("X-Page-Id", str(page_id))
    head += _line("Content-Type", "application/http;msgtype=response")
    return (head + _line("Content-Length", str(len(block))) + "\r\n").encode() + block + b"\r\n\r\n"


def _settle(fs: pafs.FileSystem, temporary: str, final: str, sha256: str) -> None:
    """Move a whole file to its final name, which an earlier try of the same task may have taken already.

    Some stores do not move onto a name that exists. A file of equal bytes stays as it is; any other is replaced.
    """
    if fs.get_file_info(final).type == pafs.FileType.File:
        left = hashlib.sha256()
        with fs.open_input_stream(final, compression=None) as data:
            while chunk := data.read(1 << 20):
                left.update(chunk)
        if left.hexdigest() == sha256:
            fs.delete_file(temporary)
            return
        fs.delete_file(final)
    fs.move(temporary, final)


class _Shard:
    """The files of one shard, written in order."""

    def __init__(self, uri: str, shard: int, roll_bytes: int) -> None:
        self.fs, self.top = _fs(uri)
        self.shard, self.roll_bytes, self.files, self.out = shard, roll_bytes, [], None

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.temporary = f"{self.top}/_temporary/{uuid.uuid4().hex}"
            self.out, self.size, self.n, self.sha = self.fs.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha256()
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = packer.compress(data) + packer.flush()
        self.out.write(member)
        self.sha.update(member)
        self.size, self.n = self.size + len(member), self.n + 1
        if self.size >= self.roll_bytes:
            self.close()

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        self.out = None
        name = f"part-{self.shard:06d}-{len(self.files):05d}.warc.gz"
        digest = self.sha.hexdigest()
        _settle(self.fs, self.temporary, f"{self.top}/{name}", digest)
        self.files.append({"name": name, "bytes": self.size, "records": self.n, "sha256": digest})

    def commit(self) -> list[dict]:
        self.close()
        temporary = f"{self.top}/_temporary/{uuid.uuid4().hex}"
        lines = "".join(json.dumps(f) + "\n" for f in self.files).encode()
        with self.fs.open_output_stream(temporary, compression=None) as out:
            out.write(lines)
        _settle(self.fs, temporary, f"{self.top}/_manifests/shard-{self.shard:06d}.json", hashlib.sha256(lines).hexdigest())
        return self.files


def keys(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``(page, digest, size)`` of every row, digest and size of the payload."""
    text = F.coalesce(F.col(html_col), F.lit(""))
    return pages.select(F.col(id_col).cast("long").alias("page"), F.sha2(F.encode(text, "UTF-8"), 256).alias("digest"), F.octet_length(text).cast("long").alias("size"))


def revisits(known: DataFrame) -> DataFrame:
    """``(page, digest, refers_to)`` of the records that repeat the payload of one with a smaller id; rows without an id take no part."""
    large = known.where((F.col("size") >= LEAST_REVISIT) & F.col("page").isNotNull())
    firsts = large.groupBy("digest").agg(F.min("page").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return large.join(firsts.drop("n"), "digest").where("page > refers_to").select("page", "digest", "refers_to").distinct()


def _place(page: Column, digest: Column) -> tuple[Column, Column]:
    """What shards are cut by: the id, null before all others, and 60 bits of the digest for rows that share it."""
    return F.coalesce(page, F.lit(-(1 << 63)).cast("long")).alias("p"), F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("d")


def boundaries(known: DataFrame, shard_bytes: int) -> list[tuple[int, int]]:
    """Places at which shards begin, the first excepted: where the running sum of payload bytes passes a multiple.

    The sum is taken in Spark: over ranges of places, and within each of them. Only the cuts
    come to the driver, ``MAX_SHARDS`` at most.
    """
    facts = known.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    shard_bytes = max(shard_bytes, -(-(facts["bytes"] or 0) // MAX_SHARDS))
    if not facts["bytes"] or facts["bytes"] <= shard_bytes:
        return []
    places = known.select(*_place(F.col("page"), F.col("digest")), "size").groupBy("p", "d").agg(F.sum("size").alias("size"))
    ranged = written(places.repartitionByRange(facts["rows"] // TASK_KEYS + 1, "p", "d").withColumn("part", F.spark_partition_id()))
    of_part = ranged.groupBy("part").agg(F.sum("size").alias("all"))
    # One row a range.
    before = of_part.select("part", (F.sum("all").over(W.orderBy("part")) - F.col("all")).alias("before"))
    running = F.sum("size").over(W.partitionBy("part").orderBy("p", "d")) - F.col("size") + F.col("before")
    shards = ranged.join(F.broadcast(before), "part").withColumn("shard", F.floor(running / shard_bytes))
    cuts = shards.groupBy("shard").agg(F.min(F.struct("p", "d")).alias("first")).where("shard > 0")
    return sorted((r["first"]["p"], r["first"]["d"]) for r in cuts.collect())


def shard_numbers(p: np.ndarray, d: np.ndarray, cuts: list[tuple[int, int]]) -> np.ndarray:
    """For each place the number of cuts that are not beyond it."""
    at = np.array([c[0] for c in cuts], dtype=np.int64)
    low, high = np.searchsorted(at, p, side="left"), np.searchsorted(at, p, side="right")
    out = high.astype(np.int32)
    for i in np.flatnonzero(low < high):  # an id at which shards are cut
        out[i] = bisect_right(cuts, (int(p[i]), int(d[i])), int(low[i]), int(high[i]))
    return out


def write(pages: DataFrame, uri: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> dict:
    """Write one record per row of ``pages``; the result is the archive's manifest, ``{shards, files, records, bytes}``.

    ``uri`` must be a folder that all executors reach. Rows go to their shard by one
    shuffle; a row that says what a record refers to travels the same way, so no text is
    joined. Null html is an empty payload; null addresses are kept. Rows without an id are
    responses that nothing refers to, and come first. Rows that repeat an id are records of
    their own, each judged by its own payload; those that repeat the payload as well are
    alike, and told apart by the number of the copy. An empty table gives an archive without
    files. Other columns are not read.
    """
    spark = pages.sparkSession
    ship(spark)
    known = written(keys(pages, id_col, html_col))
    cuts = boundaries(known, shard_bytes)

    @F.pandas_udf("int")
    def shard_of(p: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(shard_numbers(p.to_numpy(), d.to_numpy(), cuts))

    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload")
    texts = pages.select(F.col(id_col).cast("long").alias("page"), F.sha2(payload, 256).alias("digest"), F.col(url_col).alias("url"), payload)
    both = revisits(known).unionByName(texts, allowMissingColumns=True).withColumn("shard", shard_of(*_place(F.col("page"), F.col("digest"))))
    # A note has no payload and sorts before its record.
    ordered = both.repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("shard", "page", "digest", F.col("payload").isNotNull(), "url")
    fs, top = _fs(uri)
    for folder in ("_temporary", "_manifests"):
        fs.create_dir(f"{top}/{folder}", recursive=True)

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, note, last, copy = None, None, None, 0
        files: list[dict] = []
        for batch in batches:
            page_ids = [None if pd.isna(x) else int(x) for x in batch["page"]]
            for at, page, digest, url, payload, refers in zip(batch["shard"], page_ids, batch["digest"], batch["url"], batch["payload"], batch["refers_to"]):
                if shard is None or shard.shard != at:
                    files += shard.commit() if shard else []
                    shard = _Shard(uri, int(at), roll_bytes)
                if payload is None:
                    note = (page, digest, int(refers))
                    continue
                to = note[2] if note and note[:2] == (page, digest) else None
                copy = copy + 1 if last == (page, digest) else 0
                last = (page, digest)
                shard.add(record(page, url, bytes(payload), digest, to, copy))
        files += shard.commit() if shard else []
        yield pd.DataFrame([(1 if shard else 0, len(files), sum(f["records"] for f in files), sum(f["bytes"] for f in files))], columns=list(_SUMS))

    done = ordered.mapInPandas(put, ", ".join(f"{c} long" for c in _SUMS)).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _SUMS)).first().asDict()
    temporary = f"{top}/_temporary/{uuid.uuid4().hex}"
    whole = json.dumps(done).encode()
    with fs.open_output_stream(temporary, compression=None) as out:
        out.write(whole)
    _settle(fs, temporary, f"{top}/manifest.json", hashlib.sha256(whole).hexdigest())
    with suppress(OSError):
        fs.delete_dir(f"{top}/_temporary")
    return done


_SUMS = ("shards", "files", "records", "bytes")


def files(spark: SparkSession, uri: str) -> DataFrame:
    """``(name, bytes, records, sha256)`` of a complete archive's files, from the shards' manifests."""
    fs, top = _fs(uri)
    with fs.open_input_stream(f"{top}/manifest.json", compression=None) as f:
        want = json.loads(f.read())
    kind = "name string, bytes long, records long, sha256 string"
    if not want["files"]:
        return spark.createDataFrame([], kind)
    listed = spark.read.schema(kind).json(f"{uri}/_manifests/*.json")
    sums = listed.agg(F.count(F.lit(1)).alias("files"), F.sum("records").alias("records"), F.sum("bytes").alias("bytes")).first().asDict()
    if any(sums[k] != want[k] for k in sums):
        raise ValueError(f"{uri} has {sums}, its manifest {want}")
    return listed


def _members(stream) -> Iterator[bytes]:
    """The gzip members of a file one by one, read in pieces."""
    unpack, done, rest = zlib.decompressobj(31), io.BytesIO(), b""
    while True:
        data = rest or stream.read(_READ)
        if not data:
            if done.tell():
                raise ValueError("the file ends within a record")
            return
        done.write(unpack.decompress(data))
        rest = unpack.unused_data
        if unpack.eof:
            yield done.getvalue()
            unpack, done = zlib.decompressobj(31), io.BytesIO()


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """A record's WARC headers, HTTP head and payload; digests are checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if not lines[0].startswith("WARC/") or rest[len(block) :] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    http, _, payload = block.partition(b"\r\n\r\n")
    if fields["WARC-Type"] == "response" and fields["WARC-Payload-Digest"] != f"sha256:{hashlib.sha256(payload).hexdigest()}":
        raise ValueError(f"damaged payload {fields['WARC-Record-ID']}")
    return fields, http, payload


def read(spark: SparkSession, uri: str) -> DataFrame:
    """``(page_id, url, payload_bytes, payload_digest, record_type, refers_to, html)`` of an archive's records.

    Sizes and digests of revisits are those of the full payload; their ``html`` is null.
    """
    ship(spark)
    listed = files(spark, uri)
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"

    def get(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, top = _fs(uri)
        columns = [c.split(" ")[0] for c in schema.split(", ")]
        for batch in batches:
            for name in batch["name"]:
                rows, size = [], 0
                with fs.open_input_stream(f"{top}/{name}", compression=None) as f:
                    for data in _members(f):
                        fields, http, payload = parse(data)
                        n = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
                        kind, refers = fields["WARC-Type"], fields.get("X-Refers-To-Page")
                        html = payload.decode() if kind == "response" else None
                        page = int(fields["X-Page-Id"]) if "X-Page-Id" in fields else None
                        url = json.loads(fields["X-Target-URL"]) if "X-Target-URL" in fields else fields["WARC-Target-URI"]
                        rows.append((page, url, n, fields["WARC-Payload-Digest"].removeprefix("sha256:"), kind, int(refers) if refers else None, html))
                        size += len(data)
                        if size > 8 << 20:
                            yield pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})
                            rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})

    # Files are dealt out in turn, one a task as long as there are no more than MAX_SHARDS. A row a file is numbered.
    tasks = max(1, min(MAX_SHARDS, listed.count()))
    turn = ((F.row_number().over(W.orderBy("name")) - 1) % tasks).alias("turn")
    return listed.select("name", turn).repartitionById(tasks, F.col("turn")).mapInPandas(get, schema)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The records of ``pages`` as read back from an archive in the shared folder."""
    uri = scratch(pages.sparkSession)
    write(pages, uri, id_col, url_col, html_col)
    return read(pages.sparkSession, uri)
