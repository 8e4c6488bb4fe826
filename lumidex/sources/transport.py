"""Asking a model server over HTTP: one JSON request per picture, its reply as text."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator

from lumidex.operators.describe import Endpoint, reply_schema, reply_text, request
from lumidex.sources import files

TIMEOUT_S = 180

# Media types by suffix; all others are sent as JPEG.
MIMES = {"png": "image/png", "gif": "image/gif"}


def _open(url: str, headers: dict, payload: dict, timeout: float):
    body = json.dumps(payload).encode()
    return urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json", **headers}), timeout=timeout)


def post(url: str, headers: dict, payload: dict, timeout: float = TIMEOUT_S):
    """The parsed JSON answer of a POST; HTTP errors raise."""
    with _open(url, headers, payload, timeout) as answer:
        return json.load(answer)


def lines(url: str, headers: dict, payload: dict, timeout: float = TIMEOUT_S) -> Iterator[bytes]:
    """The lines of a streamed answer, as they come."""
    with _open(url, headers, payload, timeout) as answer:
        yield from answer


def fetch(url: str, timeout: float = 10) -> dict:
    """The parsed JSON of an address, for describe.served_model."""
    with urllib.request.urlopen(url, timeout=timeout) as answer:
        return json.load(answer)


def download(url: str, target: str, timeout: float = TIMEOUT_S) -> int:
    """Fetch a file, as the world picture of the tiles, into a place that sources.files reaches; returns its bytes."""
    with urllib.request.urlopen(url, timeout=timeout) as answer:
        content = answer.read()
    files.write(target, content)
    return len(content)


def ask(endpoint: Endpoint, prompt: str, content: bytes, mime: str, timeout: float = TIMEOUT_S) -> str:
    """A model's reply to a prompt with a picture, in the endpoint's dialect; the streaming kind is read line by line."""
    url, headers, payload = request(endpoint, prompt, content, mime, reply_schema())
    return reply_text(endpoint.kind, (lines if payload.get("stream") else post)(url, headers, payload, timeout))


def caller(roots: dict[str, str], load: Callable | None = None, rewrite: Callable | None = None, to_jpeg: Callable | None = None, timeout: float = TIMEOUT_S) -> Callable:
    """The `call` of describe.describe: reads the picture and asks the endpoint.

    rewrite(prompt, path) may give another (prompt, path) just before each attempt; load
    may give the bytes; HEIC goes through to_jpeg.
    """

    def call(endpoint: Endpoint, prompt: str, number: int, library: str, path: str) -> str:
        full = f"{roots[library].rstrip('/')}/{path}"
        changed = rewrite(prompt, full) if rewrite else None
        prompt, full = changed if changed is not None else (prompt, full)
        content = load(full) if load else None
        content = files.read(full) if content is None else content
        if content is None:
            raise OSError(f"cannot read {full}")
        if full.lower().endswith(".heic") and to_jpeg:
            content = to_jpeg(content)
        return ask(endpoint, prompt, content, MIMES.get(full.lower().rpartition(".")[2], "image/jpeg"), timeout)

    return call
