"""Configuration, paths inside a project, bindings and progress: small files, read and written by the driver."""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import re
import sys
import tempfile
from collections.abc import Mapping
from pathlib import Path
from typing import IO

from pyspark.sql import DataFrame, SparkSession

#: Parts of a configuration that each digest covers, beside the digests before it.
ANALYSIS = ("version", "project", "sources", "graph", "wiki", "analysis")
BINDINGS = "requirement string, alias string, value string, value_type string, secret_ref string, resolver string, requirement_digest string, verified boolean, reviewer string, confirmed_at string"


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest(value: object) -> str:
    return "sha256:" + hashlib.sha256(canonical(value).encode()).hexdigest()


def config_digests(config: Mapping) -> dict[str, str]:
    """Three digests, each of which covers those before: of the analysis, of the data and of the runtime settings.

    A change of the runtime settings leaves what was analysed current; a change of the analysis makes all stale.
    """
    analysis = digest({k: config.get(k) for k in ANALYSIS})
    data = digest({"analysis": analysis, "data": config.get("data")})
    return {"analysis": analysis, "data": data, "runtime": digest({"analysis": analysis, "data": data, "runtime": config.get("runtime")})}


def load_config(path: str) -> dict:
    """A JSON file; its project root and output folder lie inside the file's folder, the output not over the sources."""
    config = json.loads(Path(path).read_text())
    home = Path(path).resolve().parent
    root = inside(home, config.get("project", {}).get("root", "."))
    out = inside(root, config.get("output", {}).get("directory", "out"))
    if out == root:
        raise ValueError("the output folder has to be one of its own")
    return config | {"root": str(root), "output_root": str(out), "digests": config_digests(config)}


def inside(root: str | Path, path: str) -> Path:
    """path below root, which no link leads out of; the file itself need not exist."""
    top = Path(root).resolve()
    full = Path(os.path.normpath(top / path))
    if not full.is_relative_to(top):
        raise ValueError(f"{path}: outside {top}")
    at = top
    for part in full.relative_to(top).parts:
        at = at / part
        if at.is_symlink():
            raise ValueError(f"{path}: {at} is a link")
    return full


def segment(name: str) -> str:
    """A name that may be part of a path."""
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]{0,127}", name) or ".." in name:
        raise ValueError(f"not a file name: {name!r}")
    return name


def write_managed(root: str | Path, path: str, text: str) -> Path:
    """Writes a file below root: to a new file beside it first, which then takes its name at once."""
    to = inside(root, path)
    to.parent.mkdir(parents=True, exist_ok=True)
    inside(root, path)  # the folders are there now
    handle, name = tempfile.mkstemp(dir=to.parent, prefix=f".{to.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(name, to)
    except BaseException:
        with contextlib.suppress(FileNotFoundError):
            os.unlink(name)
        raise
    return to


def read_managed(root: str | Path, path: str) -> str:
    fd = os.open(inside(root, path), os.O_RDONLY | getattr(os, "O_NOFOLLOW", 0))
    with os.fdopen(fd, encoding="utf-8") as f:
        return f.read()


def scalar(text: str) -> object:
    """A text as the value it writes: null, a boolean, a number, or the text."""
    if text in ("null", "true", "false"):
        return {"null": None, "true": True, "false": False}[text]
    if re.fullmatch(r"-?(?:0|[1-9]\d*)", text):
        return int(text)
    return float(text) if re.fullmatch(r"-?(?:0|[1-9]\d*)\.\d+", text) else text


def read_bindings(spark: SparkSession, root: str | Path, path: str) -> DataFrame:
    """The application's bindings (BINDINGS) of a JSON file; an absent file has none. A value comes as text with its type."""
    try:
        found = json.loads(read_managed(root, path))["bindings"]
    except FileNotFoundError:
        found = {}
    names = [c.split()[0] for c in BINDINGS.split(", ")]
    rows = []
    for key, b in sorted(found.items()):
        value = b.get("value")
        kind = None if "value" not in b else "null" if value is None else "boolean" if isinstance(value, bool) else "string" if isinstance(value, str) else "number"
        text = None if value is None else canonical(value) if not isinstance(value, str) else value
        rows.append(tuple({**b, "requirement": key, "value": text, "value_type": kind}.get(n) for n in names))
    return spark.createDataFrame(rows, BINDINGS)


def write_bindings(root: str | Path, path: str, bindings: Mapping[str, Mapping]) -> Path:
    """Replaces the file of bindings; keys are sorted, so that equal bindings are equal files."""
    return write_managed(root, path, json.dumps({"version": 1, "bindings": {k: dict(sorted(v.items())) for k, v in sorted(bindings.items())}}, indent=2, ensure_ascii=False) + "\n")


class Progress:
    """One line of JSON an event, to standard error unless told otherwise."""

    def __init__(self, to: IO[str] | None = None):
        self.to, self.n = to or sys.stderr, 0

    def __call__(self, event: str, **details: object) -> None:
        self.n += 1
        print(canonical({"sequence": self.n, "event": event, **details}), file=self.to, flush=True)
