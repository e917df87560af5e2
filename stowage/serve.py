"""A store's members over HTTP: ``/api/stats``, ``/api/members?q,ext,coll,offset,limit`` and ``/api/member/<path>``."""

from __future__ import annotations

import json
import mimetypes
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from stowage.functions.paths import basename, dirname, extension
from stowage.operators import members as ops
from stowage.schema import EXTENTS
from stowage.store import Store

KEPT = 12


class Browser:
    """Queries over one snapshot; the index is cached in Spark, the last contents here."""

    def __init__(self, spark: SparkSession, root: str, at: int | None = None):
        self.store, self.at = Store(spark, root), at
        m = self.store.members(at).filter(f"frame >= 0 OR frame = {EXTENTS}")
        p = F.col("path")
        self.index = m.select("path", "size", "frame", basename(p).alias("name"), extension(p).alias("ext"), dirname(p).alias("coll")).cache()
        self.last: dict[str, bytes] = {}

    def stats(self) -> dict:
        t = self.index.agg(F.count(F.lit(1)).alias("members"), F.count_distinct(F.when(F.col("frame") >= 0, F.col("frame"))).alias("frames"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count_distinct("coll").alias("collections")).first()
        top = lambda c, n: [{c: r.value or ("?" if c == "ext" else ""), "n": r.n} for r in ops.value_counts(self.index, F.col(c), n).collect()]
        return t.asDict() | {"exts": top("ext", 16), "colls": top("coll", 60)}

    def members(self, q: str = "", ext: str = "", coll: str = "", offset: int = 0, limit: int = 200) -> dict:
        found = ops.search(self.index, q or None, ext or None, coll or None)
        rows = ops.page(found.select("path", "name", "size", "ext", "coll"), ["path"], offset, limit)
        return {"total": found.count(), "rows": [r.asDict() for r in rows.collect()]}

    def member(self, path: str) -> bytes | None:
        if path not in self.last:
            got = self.store.contents(self.at, F.col("path") == path).first()
            if got is None:
                return None
            self.last[path] = bytes(got.content)
            while len(self.last) > KEPT:
                del self.last[next(iter(self.last))]
        return self.last[path]


def server(browser: Browser, port: int = 0) -> ThreadingHTTPServer:
    """A server on this machine's loopback; call ``serve_forever``."""

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def answer(self, code: int, body: bytes, kind: str = "application/json") -> None:
            self.send_response(code)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self):
            url = urlparse(self.path)
            one = lambda k, default: parse_qs(url.query).get(k, [default])[0]
            try:
                if url.path == "/api/stats":
                    return self.answer(200, json.dumps(browser.stats()).encode())
                if url.path == "/api/members":
                    found = browser.members(one("q", ""), one("ext", ""), one("coll", ""), int(one("offset", "0")), int(one("limit", "200")))
                    return self.answer(200, json.dumps(found).encode())
                if url.path.startswith("/api/member/"):
                    path = unquote(url.path.removeprefix("/api/member/"))
                    body = browser.member(path)
                    if body is not None:
                        return self.answer(200, body, mimetypes.guess_type(path)[0] or "application/octet-stream")
                self.answer(404, b'{"error": "not found"}')
            except ValueError as e:
                self.answer(400, json.dumps({"error": str(e)}).encode())

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
