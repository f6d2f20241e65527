"""WARC archives with revisit records and one globally ordered capture index.

Writing: each task writes one archive (a gzip member a record) and one capture
run, its index entries sorted by (URL key, timestamp, page id). Payloads are
equal when their SHA-1 digests are; of equal ones the record with the largest
page id is the response and the others are revisits that refer to it.

Index: an external merge. Runs are merged k ways by a loser tree, FAN_IN at a
time, until at most FAN_IN are left; the last pass is cut into key ranges at
splitters taken from the runs' block tables, one task a range, so the output
files follow each other in (URL key, timestamp, page id) order. A hot URL key
spans ranges, as the splitters are whole keys. Tasks hold one block a run.

Null html is an empty payload; null urls have the key "-". Repeated rows of a
page with the largest id are responses alike. Rows without a page id are
written last in their order with id -1. An empty table gives an empty index.
Files are written under a name of the attempt's own and renamed.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from urllib.parse import urlsplit

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import file_system, mapped, new_folder, put_file, small_batches

FAN_IN = 64
BLOCK = 2048  # entries a block of a run
SPLITTERS = 1024  # keys a run to choose ranges from, about
STRETCH = 64 << 20  # bytes of an archive that one task reads back, about
EPOCH_SECONDS = 1_600_000_000  # capture time of page 0 where the table has no timestamps
INDEX = "url_key string, captured_at string, page_id long, file string, offset long, length long"
_COLUMNS = ["url_key", "captured_at", "page_id", "file", "offset", "length"]


def url_key(url: str | None) -> str:
    """A sortable key: host labels reversed, port kept unless default, path and query; scheme, user, www. and fragment dropped; lower case but for path and query."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return re.sub(r"\s", "%20", url)
    host = re.sub(r"^www\d*\.", "", host)
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and (parts.scheme, port) not in (("http", 80), ("https", 443)) else "")
    return re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", key + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else ""))


# ---- records


def record(page: int, url: str | None, payload: bytes, date: str, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP head, so payload length and digest of the full payload stay readable."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {re.sub(r'[\r\n]', '', url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> dict:
    """A record's fields; the payload's digest is checked against the head where the record has the payload."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError("payload is damaged")
    number = lambda name: int(re.fullmatch(r"<urn:page:(-?\d+)>", fields[name])[1]) if name in fields else None
    return {
        "page_id": number("warc-record-id"),
        "url": fields["warc-target-uri"],
        "payload": payload if fields["warc-type"] == "response" else None,
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["warc-type"],
        "refers_to": number("warc-refers-to"),
    }


# ---- runs and their merge


class LoserTree:
    """k-way merge: internal nodes hold the losers of their matches, so each entry costs one comparison a level."""

    def __init__(self, sources):
        self.sources = [iter(s) for s in sources]
        self.k = max(1, len(self.sources))
        self.heads = [next(s, None) for s in self.sources] or [None]
        self.losers = [-1] * self.k
        self.winner = self._build(1)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:  # a spent source loses
            return x is not None or (y is None and a < b)
        return (x, a) < (y, b)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, lose = (a, b) if self._less(a, b) else (b, a)
        self.losers[node] = lose
        return win

    def __iter__(self):
        if not self.sources:
            return
        while (head := self.heads[self.winner]) is not None:
            yield head
            w = self.winner
            self.heads[w] = next(self.sources[w], None)
            node = (w + self.k) >> 1
            while node:
                if self._less(self.losers[node], w):
                    self.losers[node], w = w, self.losers[node]
                node >>= 1
            self.winner = w


def run_chunks(entries):
    """A run file's chunks: compressed blocks of sorted entries, the table of (offset, length, first key), its length."""
    table, offset, block = [], 0, []

    def packed():
        return zlib.compress("\n".join("\t".join(map(str, e)) for e in block).encode(), 1)

    for e in entries:
        block.append(e)
        if len(block) == BLOCK:
            yield (done := packed())
            table.append((offset, len(done), block[0][:3]))
            offset, block = offset + len(done), []
    if block:
        yield (done := packed())
        table.append((offset, len(done), block[0][:3]))
    tail = json.dumps(table).encode()
    yield tail + len(tail).to_bytes(8, "little")


def run_table(uri: str) -> list:
    where, path = file_system(uri)
    with where.open_input_file(path) as f:
        size = where.get_file_info(path).size
        f.seek(size - 8)
        n = int.from_bytes(f.read(8), "little")
        f.seek(size - 8 - n)
        return [(o, length, tuple(key)) for o, length, key in json.loads(f.read(n))]


def run_entries(uri: str, low: tuple | None = None, high: tuple | None = None):
    """Entries with low <= key < high, reading only blocks that can hold them."""
    table = run_table(uri)
    where, path = file_system(uri)
    with where.open_input_file(path) as f:
        for k, (offset, length, first) in enumerate(table):
            if high is not None and first >= high:
                return
            if low is not None and k + 1 < len(table) and table[k + 1][2] < low:
                continue
            f.seek(offset)
            for line in zlib.decompress(f.read(length)).decode().split("\n"):
                a = line.split("\t")
                e = (a[0], a[1], int(a[2]), a[3], int(a[4]), int(a[5]))
                if (low is None or e[:3] >= low) and (high is None or e[:3] < high):
                    yield e


def merge_runs(spark: SparkSession, runs: list[str], folder: str, fan_in: int = FAN_IN, ranges: int | None = None) -> list[str]:
    """Merge runs to files in global order; returns them in that order."""
    level = 0
    while len(runs) > fan_in:
        groups = [(f"{folder}/merge-{level}-{k}.run", runs[k : k + fan_in]) for k in range(0, len(runs), fan_in)]

        def one(batches):
            for batch in batches:
                for target, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    put_file(target, run_chunks(LoserTree([run_entries(p) for p in parts])))
                    yield {"target": [target]}

        todo = spark.createDataFrame(groups, "target string, parts array<string>").repartition(len(groups))
        mapped(todo, one, "target string").collect()
        runs, level = [g[0] for g in groups], level + 1

    def keys_of(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                table = run_table(uri)
                found = [key for _, _, key in table[:: max(1, len(table) // SPLITTERS)]]
                yield {"url_key": [k[0] for k in found], "captured_at": [k[1] for k in found], "page_id": [k[2] for k in found]}

    listed = spark.createDataFrame([(r,) for r in runs], "uri string").repartition(len(runs))
    keys = sorted(tuple(r) for r in mapped(listed, keys_of, "url_key string, captured_at string, page_id long").collect())  # 2 * SPLITTERS a run at most, FAN_IN runs
    n = max(1, min(ranges or int(spark.conf.get("spark.sql.shuffle.partitions")), len(keys)))
    cuts = sorted({keys[len(keys) * k // n] for k in range(1, n)}) if keys else []
    bounds = list(zip([None, *cuts], [*cuts, None]))
    todo = [(f"{folder}/captures-{k:06d}.run", json.dumps([low, high])) for k, (low, high) in enumerate(bounds)]

    def last(batches):
        for batch in batches:
            for target, span in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                low, high = (tuple(x) if x else None for x in json.loads(span))
                put_file(target, run_chunks(LoserTree([run_entries(r, low, high) for r in runs])))
                yield {"target": [target]}

    mapped(spark.createDataFrame(todo, "target string, span string").repartition(len(todo)), last, "target string").collect()
    return [t for t, _ in todo]


# ---- the operator


def write_archives(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", timestamp: str | None = None, least_payload: int = 0, folder: str | None = None) -> tuple[str, list[str]]:
    """Write archives and local runs; returns the folder and the run files. timestamp: a column of capture times."""
    spark = df.sparkSession
    out = folder or new_folder(spark, "warc")
    taken = F.col(timestamp) if timestamp else F.timestamp_seconds(F.lit(EPOCH_SECONDS) + F.pmod(F.coalesce(F.col(key), F.lit(0)), F.lit(1_000_000_000)))
    rows = df.select(
        F.coalesce(F.col(key).cast("long"), F.lit(-1)).alias("_id"),
        F.col(url).alias("_url"),
        F.coalesce(F.col(html), F.lit("")).alias("_html"),
        F.date_format(taken, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("_date"),
    ).withColumn("_sha", F.unhex(F.sha1("_html")))
    first = rows.where(F.octet_length("_html") >= least_payload).groupBy("_sha").agg(F.max("_id").alias("_best"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    marked = rows.join(first, "_sha", "left").select("_id", "_url", "_html", "_date", F.expr("nullif(_best, _id)").alias("_refers"))
    marked = marked.sortWithinPartitions("_id", F.xxhash64("_url", "_html"))  # one order, so every attempt writes the same bytes

    def run(batches):
        from pyspark import TaskContext

        name = f"archive-{TaskContext.get().partitionId():06d}"
        entries, at = [], [0]

        def chunks():
            for batch in batches:
                for piece in small_batches([batch], 256):
                    for page, link, text, date, refers in zip(*(c.to_pylist() for c in piece.columns)):
                        member = record(page, link, text.encode("utf-8", "surrogatepass"), date, refers)
                        entries.append((url_key(link), re.sub(r"\D", "", date), page, f"{name}.warc.gz", at[0], len(member)))
                        at[0] += len(member)
                        yield member

        put_file(f"{out}/{name}.warc.gz", chunks())
        if entries:
            put_file(f"{out}/{name}.run", run_chunks(sorted(entries)))
            yield {"run": [f"{out}/{name}.run"], "records": [len(entries)]}

    runs = mapped(marked, run, "run string, records long").collect()
    return out, sorted(r["run"] for r in runs)


def capture_index(spark: SparkSession, folder: str, runs: list[str], fan_in: int = FAN_IN) -> DataFrame:
    """The merged index: INDEX columns and shard, the number of the file in global order; within a shard rows come in order."""
    files = merge_runs(spark, runs, folder, fan_in) if runs else []

    def run(batches):
        for batch in batches:
            for shard, uri in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held = []
                for e in run_entries(uri):
                    held.append(e)
                    if len(held) == BLOCK:
                        yield {"shard": [shard] * len(held), **dict(zip(_COLUMNS, map(list, zip(*held))))}
                        held = []
                if held:
                    yield {"shard": [shard] * len(held), **dict(zip(_COLUMNS, map(list, zip(*held))))}

    listed = spark.createDataFrame(list(enumerate(files)), "shard int, uri string")
    return mapped(listed.repartition(max(1, len(files))), run, "shard int, " + INDEX)


def read_records(index: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The records that index rows point to, read from the archives at their offsets; with payloads, the payload of responses too."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads

    def run(batches):
        name, source = None, None
        for batch in batches:
            for piece in small_batches([batch], 512):
                found = []
                for file, offset, length in zip(*(c.to_pylist() for c in piece.columns)):
                    if file != name:
                        where, path = file_system(f"{folder}/{file}")
                        name, source = file, where.open_input_file(path)
                    source.seek(offset)
                    found.append(parse(source.read(length)))
                if found:
                    yield {n: [r[n] for r in found] for n in names}

    # Stretches of archives are dealt to a number of tasks that follows the archives' bytes; a large archive is several tasks' work.
    where, path = file_system(folder)
    size = sum(f.size for f in where.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.base_name.endswith(".warc.gz"))
    tasks = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // STRETCH)
    places = index.select("file", "offset", "length").repartition(tasks, F.col("file"), F.floor(F.col("offset") / F.lit(STRETCH))).sortWithinPartitions("file", "offset")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    return mapped(places, run, schema)
