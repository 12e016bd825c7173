"""Downloads that a rate limit makes small work: files by HTTP, with retries, kept whole, and a record of size and hash.

A file is written under a temporary name and renamed when it is complete. Answers that may pass (429 and 5xx, broken
connections, bodies shorter than announced) are tried again after a wait that doubles, or that the server names; other
answers are errors at once. A file whose record still fits is not fetched again.
"""

from __future__ import annotations

import hashlib
import http.client
import json
import os
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from urllib.parse import urlsplit

from tidemark.operators.runner import file_hash
from tidemark.sources.sinks import write_json

STEP = 1 << 20


@dataclass
class Fetcher:
    folder: str
    per_second: float = 5.0
    attempts: int = 4
    wait: float = 0.5
    timeout: float = 60.0
    headers: dict = field(default_factory=dict)
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic
    _next: float = 0.0

    def _turn(self) -> None:
        """Waits until the next request is allowed."""
        now = self.clock()
        if now < self._next:
            self.sleep(self._next - now)
        self._next = max(now, self._next) + 1 / self.per_second

    def get(self, url: str, name: str | None = None) -> dict:
        """url, path, bytes, sha256, attempts (0: it was there) of one file."""
        name = name or os.path.basename(urlsplit(url).path)
        if not name or os.path.basename(name) != name or name.startswith("."):
            raise ValueError(f"{url} gives no plain file name")
        path = os.path.join(self.folder, name)
        os.makedirs(self.folder, exist_ok=True)
        if (old := self._record(path)) and old["url"] == url:
            return old | {"attempts": 0}
        for k in range(1, self.attempts + 1):
            self._turn()
            try:
                size, digest = self._download(url, path)
                break
            except (urllib.error.URLError, http.client.HTTPException, ConnectionError, TimeoutError) as e:
                again = not isinstance(e, urllib.error.HTTPError) or e.code == 429 or e.code >= 500
                if not again or k == self.attempts:
                    raise
                named = e.headers.get("Retry-After") if isinstance(e, urllib.error.HTTPError) else None
                self.sleep(float(named) if named and named.isdigit() else self.wait * 2 ** (k - 1))
        record = {"url": url, "path": path, "bytes": size, "sha256": digest}
        write_json(record, path + ".fetched.json")
        return record | {"attempts": k}

    def _record(self, path: str) -> dict | None:
        if not (os.path.exists(path) and os.path.exists(path + ".fetched.json")):
            return None
        with open(path + ".fetched.json") as f:
            old = json.load(f)
        return old if old["bytes"] == os.path.getsize(path) and old["sha256"] == file_hash(path) else None

    def _download(self, url: str, path: str) -> tuple[int, str]:
        tmp, size, digest = f"{path}.{uuid.uuid4().hex}", 0, hashlib.sha256()
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=self.headers), timeout=self.timeout) as r, open(tmp, "wb") as out:
                while chunk := r.read(STEP):
                    out.write(chunk)
                    digest.update(chunk)
                    size += len(chunk)
                told = r.headers.get("Content-Length")
                if told and int(told) != size:
                    raise http.client.IncompleteRead(b"", int(told) - size)
            os.replace(tmp, path)
        finally:
            if os.path.exists(tmp):
                os.remove(tmp)
        return size, digest.hexdigest()

    def get_all(self, urls: Iterable[str]) -> list[dict]:
        """A record for each address; those that fail for good have an error instead of a hash, and the others still come."""
        out = []
        for url in urls:
            try:
                out.append(self.get(url) | {"error": None})
            except (urllib.error.URLError, http.client.HTTPException, OSError, ValueError) as e:
                out.append({"url": url, "path": None, "bytes": None, "sha256": None, "attempts": self.attempts, "error": f"{type(e).__name__}: {e}"})
        return out
