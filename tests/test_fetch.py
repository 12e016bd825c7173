"""Downloads against a server of our own."""

import hashlib
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from tidemark.sources.fetch import Fetcher

BODY = b"row\n" * 100_000


@pytest.fixture
def server():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append(self.path)
            n = seen.count(self.path)
            if self.path == "/gone.txt":
                self.send_error(404)
            elif self.path == "/busy.txt" and n < 3:
                self.send_response(429)
                self.send_header("Retry-After", "7")
                self.end_headers()
            else:
                cut = self.path == "/cut.txt" and n == 1
                self.send_response(200)
                self.send_header("Content-Length", str(len(BODY)))
                self.end_headers()
                self.wfile.write(BODY[:50] if cut else BODY)

        def log_message(self, *_):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", seen
    s.shutdown()


def test_fetch(server, tmp_path):
    base, seen = server
    waits = []
    f = Fetcher(str(tmp_path), per_second=1000, wait=0.25, sleep=waits.append)
    got = {r["url"].rsplit("/", 1)[-1]: r for r in f.get_all(f"{base}/{n}" for n in ("a.txt", "busy.txt", "cut.txt", "gone.txt", ""))}
    assert got["a.txt"]["sha256"] == hashlib.sha256(BODY).hexdigest() and got["a.txt"]["bytes"] == len(BODY) and got["a.txt"]["attempts"] == 1
    assert got["busy.txt"]["attempts"] == 3 and [w for w in waits if w >= 1] == [7.0, 7.0]
    assert got["cut.txt"]["attempts"] == 2 and 0.25 in waits and (tmp_path / "cut.txt").read_bytes() == BODY
    assert got["gone.txt"]["error"].startswith("HTTPError") and seen.count("/gone.txt") == 1 and got[""]["error"].startswith("ValueError")
    assert not [p for p in tmp_path.iterdir() if p.name.startswith(("gone", "cut.txt.")) and not p.name.endswith(".fetched.json")]
    assert f.get(f"{base}/a.txt")["attempts"] == 0 and seen.count("/a.txt") == 1
    (tmp_path / "a.txt").write_bytes(b"changed")
    assert f.get(f"{base}/a.txt")["attempts"] == 1 and (tmp_path / "a.txt").read_bytes() == BODY


def test_rate(server, tmp_path):
    now, waits = [0.0], []

    def sleep(s):
        waits.append(s)
        now[0] += s

    f = Fetcher(str(tmp_path), per_second=2, sleep=sleep, clock=lambda: now[0])
    f.get_all(f"{server[0]}/{i}.txt" for i in range(4))
    assert waits == [0.5, 0.5, 0.5]
