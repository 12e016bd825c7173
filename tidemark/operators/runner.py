"""A small runner of tasks with markers: a task is done again only if its inputs, settings or versions changed, its outputs
are gone, or a task it depends on ran. Work inside a task is Spark's."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from tidemark.sources.sinks import write_json


def file_hash(path: str) -> str:
    """SHA-256 of a file, or of a folder's files by name (M8)."""
    h = hashlib.sha256()
    files = [path] if os.path.isfile(path) else sorted(os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs)
    for f in files:
        if f != path:
            h.update(os.path.relpath(f, path).encode())
        with open(f, "rb") as x:
            while chunk := x.read(1 << 20):
                h.update(chunk)
    return h.hexdigest()


def write_metadata(path: str, **more: object) -> str:
    """A sidecar with the hash of a file."""
    return write_json({"file": os.path.basename(path), "sha256": file_hash(path), **more}, path + ".meta.json")


def verify_metadata(path: str) -> dict:
    """The sidecar of a file; a missing or different hash is an error."""
    with open(path + ".meta.json") as f:
        meta = json.load(f)
    if meta.get("sha256") != file_hash(path):
        raise ValueError(f"{path} has changed since its metadata was written")
    return meta


def contained(path: str, root: str) -> str:
    """path, if it lies in root; else an error."""
    if os.path.commonpath([os.path.realpath(path), os.path.realpath(root)]) != os.path.realpath(root):
        raise ValueError(f"{path} is outside of {root}")
    return path


@dataclass
class Task:
    name: str
    action: Callable[[], Sequence[str]]
    inputs: Sequence[str] = ()
    settings: Mapping = field(default_factory=dict)
    after: Sequence[str] = ()


class Runner:
    def __init__(self, folder: str, roots: Sequence[str], version: str = "1", resume: bool = True):
        self.folder, self.roots, self.version, self.resume = folder, roots, version, resume

    def _signature(self, t: Task) -> dict:
        return {"version": self.version, "settings": json.loads(json.dumps(t.settings, sort_keys=True, default=str)), "inputs": {p: file_hash(p) for p in t.inputs}}

    def _marker(self, name: str) -> str:
        return os.path.join(self.folder, f"{name}.done.json")

    def run(self, tasks: Sequence[Task]) -> dict[str, bool]:
        """Which tasks ran. Tasks stand in an order in which each comes after what it depends on."""
        ran: dict[str, bool] = {}
        for t in tasks:
            if unknown := [a for a in t.after if a not in ran]:
                raise ValueError(f"{t.name} depends on {', '.join(unknown)}, which didn't come before")
            sign, old = self._signature(t), None
            if os.path.exists(self._marker(t.name)):
                with open(self._marker(t.name)) as f:
                    old = json.load(f)
            fresh = self.resume and old is not None and old["signature"] == sign and not any(ran[a] for a in t.after) and all(os.path.exists(p) for p in old["outputs"])
            ran[t.name] = not fresh
            if fresh:
                continue
            for p in old["outputs"] if old else ():
                if os.path.exists(p):
                    remove_path(p, self.roots)
            write_json({"signature": sign, "outputs": list(t.action())}, self._marker(t.name))
        return ran


def remove_path(path: str, roots: Sequence[str]) -> None:
    """Deletes a table, only inside allowed roots."""
    if not any(os.path.realpath(path).startswith(os.path.realpath(r) + os.sep) for r in roots):
        raise ValueError(f"{path} is outside of the allowed roots")
    shutil.rmtree(path) if os.path.isdir(path) else os.remove(path)


def cpu_budget(cores: int, jobs: int, threads: int) -> tuple[int, int]:
    """jobs and threads as asked, unless together they are more than the cores (ML19)."""
    if jobs * threads > cores:
        raise ValueError(f"{jobs} jobs of {threads} threads need more than {cores} cores")
    return jobs, threads


def batched(paths: Sequence[str], size: int) -> list[list[str]]:
    """Paths in batches."""
    return [list(paths[k : k + size]) for k in range(0, len(paths), size)]


def sample(folder: str) -> dict:
    """What a run uses just now: bytes of the folder's disk, and this process' resident memory."""
    disk, rss = shutil.disk_usage(folder), 0
    if os.path.exists("/proc/self/status"):
        with open("/proc/self/status") as f:
            rss = next((1024 * int(x.split()[1]) for x in f if x.startswith("VmRSS:")), 0)
    return {"time": time.time(), "disk_used": disk.used, "disk_free": disk.free, "rss": rss}


def check_report(report: Mapping, schema: Mapping[str, type | tuple]) -> Mapping:
    """report, if it has just the fields of a schema, each of its type; else an error that names them."""
    wrong = sorted({*report} ^ {*schema}) + [k for k, kind in schema.items() if k in report and not isinstance(report[k], kind)]
    if wrong:
        raise ValueError(f"fields missing, unknown or of a wrong type: {', '.join(wrong)}")
    return report


def claim_status(parts: Mapping[str, str]) -> str:
    """The status of a claim from that of its parts: blocked beats missing, which beats partial."""
    states = set(parts.values())
    for s in ("blocked", "missing", "partial"):
        if s in states:
            return s
    return "supported" if states == {"fit"} or states == {"complete"} else "partial"


def provenance(folder: str, inputs: Sequence[str] = ()) -> dict:
    """The commit of a repository, whether it has changes, and hashes of inputs (X29); unknown values are None."""
    import subprocess

    def git(*args: str) -> str | None:
        got = subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True)
        return got.stdout.strip() if got.returncode == 0 else None

    return {"commit": git("rev-parse", "HEAD"), "changed": None if (s := git("status", "--porcelain")) is None else bool(s), "inputs": {os.path.basename(p): file_hash(p) for p in inputs}}
