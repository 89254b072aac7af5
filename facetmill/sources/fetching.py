"""Image fetching: a bounded number of requests in flight a task, retries, verified images, a blob store.

The transport is injected: ``connect`` is picklable and gives a session, a function from a URL to status,
headers and bytes. Each caller thread of a task opens one session and keeps it.
"""

from __future__ import annotations

import hashlib
import random
import struct
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetmill.functions import parsing as P
from facetmill.operators.inflight import in_window
from facetmill.session import ship_package

Session = Callable[[str], tuple[int, dict, bytes]]
#: Statuses that are worth another try, and the manifest's columns.
AGAIN = (429, 500, 502, 503, 504)
MANIFEST = "product_id string, status string, http int, bytes long, md5 string, w int, h int, err string"


@dataclass(frozen=True)
class Patience:
    """How often, and how long between; ``rest`` is called with the seconds to wait."""

    tries: int = 5
    longest: float = 30.0
    rest: Callable[[float], None] = time.sleep

    def after(self, attempt: int, told: str | None = None) -> None:
        """Waits what the server asks for, or twice as long each time and a random part of a second."""
        try:
            seconds = max(float(told), 0.0)
        except (TypeError, ValueError):
            seconds = (1 << attempt) + random.random()
        self.rest(min(seconds, self.longest))


def image_size(data: bytes) -> tuple[int, int]:
    """Width and height from a JPEG's, PNG's, GIF's or WebP's own header; ``ValueError`` for anything else, and
    for a JPEG or PNG that ends before its end mark."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR" and b"IEND" in data[-12:]:
        return struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) > 10:
        return struct.unpack("<HH", data[6:10])
    if data[:4] == b"RIFF" and data[8:16] == b"WEBPVP8X" and len(data) >= 30:
        return int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1
    if data[:2] == b"\xff\xd8" and b"\xff\xd9" in data[-64:]:
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            mark, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):  # a frame's header
                height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                return width, height
            at += 2 + size
    raise ValueError("no image that is known")


def fetch_one(url: str, session: Session, patience: Patience = Patience(), measure: Callable[[bytes], tuple[int, int]] = image_size) -> tuple[dict, bytes | None]:
    """What becomes of one URL, as fields of the manifest, and the image's bytes. It never raises."""
    http = None
    for attempt in range(patience.tries):
        try:
            http, headers, body = session(url)
        except Exception as e:
            if attempt + 1 == patience.tries:
                return {"status": "exception", "http": http, "err": f"{type(e).__name__}: {e}"}, None
            patience.after(attempt)
            continue
        if http in AGAIN:
            patience.after(attempt, {k.lower(): v for k, v in headers.items()}.get("retry-after"))
        elif not 200 <= http < 400:
            return {"status": "http_error", "http": http}, None
        else:
            try:
                width, height = measure(body)
            except Exception as e:
                return {"status": "not_image", "http": http, "bytes": len(body), "err": f"{type(e).__name__}: {e}"}, None
            return {"status": "ok", "http": http, "bytes": len(body), "md5": hashlib.md5(body).hexdigest(), "w": width, "h": height}, body
    return {"status": "retry_exhausted", "http": http}, None


def _store(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


def fetch_images(urls: DataFrame, connect: Callable[[], Session], root: str, tasks: int = 8, in_flight: int = 8, patience: Patience = Patience(),
                 measure: Callable[[bytes], tuple[int, int]] = image_size) -> DataFrame:
    """The manifest of ``urls`` (product_id, url_small): each image is in the sharded store under ``root`` or has
    a status that says why not. An image that the store has is skipped, so a rerun asks for what is missing.

    ``tasks`` times ``in_flight`` requests run at a time. A file is written under another name and then moved,
    so none is ever half there. Write the manifest before using it twice, as each use fetches.
    """
    ship_package(urls.sparkSession)
    names = [f.split()[0] for f in MANIFEST.split(", ")]
    types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(root)
        own = threading.local()

        def get(row: tuple[str, str, str]) -> dict:
            _, url, path = row
            at = _store(path)[1]
            have = store.get_file_info(at)
            if have.size:
                return {"status": "skip", "bytes": have.size}
            if not hasattr(own, "session"):
                own.session = connect()
            fields, body = fetch_one(url, own.session, patience, measure)
            if body is not None:
                store.create_dir(at.rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{at}.part") as out:
                    out.write(body)
                store.move(f"{at}.part", at)
            return fields

        rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3))))
        done: list[dict] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d.get(n) for d in done], t) for n, t in zip(names, types)], names)

        for row, fields, error in in_window(rows, get, in_flight):
            fields = fields if error is None else {"status": "exception", "err": f"{type(error).__name__}: {error}"}
            done.append(fields | {"product_id": row[0]})
            if len(done) == 1000:
                yield batch()
                done = []
        yield batch()

    named = urls.select("product_id", "url_small", P.shard_path(F.col("product_id"), root).alias("path"))
    return named.repartition(tasks).mapInArrow(run, MANIFEST)
