"""A thin HTTP server over the catalog: each route answers with the rows of one operator."""

from __future__ import annotations

import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import PurePosixPath

from pyspark.sql import functions as F

from lumidex.operators import export, search
from lumidex.operators.positions import positions
from lumidex.sources import files, site
from lumidex.sources.catalog import Catalog
from lumidex.sources.plugins import Helper
from lumidex.sources.thumbs import Thumbs


class Routes:
    """(status, media type, body) of a path; unknown paths, and pictures that are not there, are 404."""

    def __init__(self, catalog: Catalog, config: dict, thumbs: Thumbs | None = None, tiles: str | None = None, helper: Helper = Helper(), convert: Callable[[bytes], bytes] | None = None, fallback: Callable[[int, int, int], bytes | None] | None = None):
        self.catalog, self.thumbs, self.tiles, self.helper, self.convert, self.fallback = catalog, thumbs, tiles, helper, convert, fallback
        self.roots = {x["name"]: x.get("path", "") for x in config.get("libraries", []) if x.get("name")}

    def answer(self, path: str) -> tuple[int, str, bytes]:
        steps = path.partition("?")[0].strip("/").split("/")
        try:
            if steps == ["api", "index"]:
                return self._rows(search.index(self.catalog.images()))
            if steps == ["api", "locations"]:
                return self._rows(positions(self.catalog.images()).orderBy("id"))
            if steps[0] == "tile" and len(steps) == 4 and steps[3].endswith(".jpg") and (self.tiles or self.fallback):
                return self._bytes(site.tile(self.tiles or "", int(steps[1]), int(steps[2]), int(steps[3].removesuffix(".jpg")), self.fallback))
            row = self.catalog.images().filter(F.col("id") == int(steps[-1]))
            if steps[:-1] == ["api", "image"]:
                found = export.detail(row).toJSON().first()
                return (200, "application/json", found.encode()) if found else self._bytes(None)
            if steps[:-1] == ["thumb"] and self.thumbs:
                found = self.thumbs.read(row.select("id", "thumb_shard", "thumb_offset", "thumb_length")).first()
                return self._bytes(found and found["jpeg"] and bytes(found["jpeg"]))
            if steps[:-1] == ["image"]:
                return self._original(row.select("library", "path").first())
        except ValueError:
            pass
        return self._bytes(None)

    def _rows(self, rows) -> tuple[int, str, bytes]:
        return 200, "application/json", ("[" + ",".join(rows.toJSON().toLocalIterator()) + "]").encode()

    def _original(self, row) -> tuple[int, str, bytes]:
        if row is None or row["library"] not in self.roots:
            return self._bytes(None)
        full = f"{self.roots[row['library']].rstrip('/')}/{row['path']}"
        content = self.helper.load_image(full) if self.helper.load_image else None
        content = files.read(full) if content is None else content
        if content is not None and full.lower().endswith(".heic"):
            content = self.convert(content) if self.convert else None
        kind = {".png": "image/png", ".gif": "image/gif"}.get(PurePosixPath(full.lower()).suffix, "image/jpeg")
        return self._bytes(content, kind)

    @staticmethod
    def _bytes(content: bytes | None, kind: str = "image/jpeg") -> tuple[int, str, bytes]:
        return (200, kind, content) if content is not None else (404, "application/json", json.dumps({"error": "not found"}).encode())


def server(routes: Routes, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            status, kind, body = routes.answer(self.path)
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    return ThreadingHTTPServer((host, port), Handler)
