"""Artefacts: tables and reports written once, manifests, event logs, configuration."""

from __future__ import annotations

import functools
import hashlib
import json
import os
import tempfile
import time
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame


def check(held: bool, problem: str) -> None:
    """Raises ValueError with the problem unless it held."""
    if not held:
        raise ValueError(problem)


def write_table(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    """Parquet with zstd in the cluster's storage; refuses to overwrite."""
    df.write.save(path, format="parquet", mode="errorifexists", partitionBy=list(partition_by) or None, compression="zstd")


def _publish(path: str, text: str, replace: bool) -> None:
    """A small report on the driver's own disk: written beside its place and then moved there, so no reader sees half of
    it. Tables go through write_table; only what the driver holds anyway is written here."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, part = tempfile.mkstemp(dir=folder)
    try:
        with open(handle, "w", encoding="utf-8", newline="") as file:
            file.write(text)
        # a link fails where the name is taken
        (os.replace if replace else os.link)(part, path)
    finally:
        if os.path.exists(part):
            os.remove(part)


def write_json(path: str, value: object) -> None:
    """One JSON value, its keys in order; NaN and infinity are no JSON and raise. Replaces the file."""
    _publish(path, "".join([*json.JSONEncoder(allow_nan=False, sort_keys=True, indent=1).iterencode(value), "\n"]), True)


def write_csv(path: str, rows: list[dict]) -> None:
    """Rows of any fields as CSV, a field no row has left empty. The file must not exist; without rows there is no header
    and it raises."""
    check(len(rows) > 0, "a report needs rows")
    frame = pd.DataFrame([{k: str(v) for k, v in r.items() if v is not None} for r in rows], dtype="string")
    _publish(path, frame.to_csv(index=False, lineterminator="\n"), False)


def union_rows(parts: list[DataFrame]) -> DataFrame:
    """All rows of all parts, columns by name, absent ones null."""
    check(bool(parts), "nothing to union")
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def mark(path: str, event: str, **values: object) -> None:
    """One more line in a log of events."""
    with open(path, "a", encoding="utf-8") as file:
        file.write(json.dumps({"event": event, "at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), **values}, sort_keys=True) + "\n")


def markdown(rows: list[dict], columns: list[str]) -> str:
    """A Markdown table: thousands in whole numbers, six digits in others, bars escaped, - for nothing."""

    def cell(x: object) -> str:
        if x is None:
            return "-"
        if isinstance(x, bool):
            return str(x)
        if isinstance(x, int):
            return f"{x:,}"
        if isinstance(x, float):
            return f"{x:.6g}"
        return str(x).replace("|", "\\|").replace("\n", " ")

    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows])


def file_hash(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as file:
        while block := file.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def manifest(folder: str) -> dict[str, str]:
    """Hash of every file below a folder, by relative path."""
    return {os.path.relpath(os.path.join(d, f), folder): file_hash(os.path.join(d, f)) for d, _, files in sorted(os.walk(folder)) for f in sorted(files)}


def compare_manifests(expected: dict[str, str], found: dict[str, str]) -> None:
    """Raises for a file that is missing, new or changed."""
    changed = sorted(k for k in expected.keys() | found.keys() if expected.get(k) != found.get(k))
    check(not changed, f"changed files: {changed[:5]}")


@dataclass
class Config:
    """A validated run configuration."""

    raw: str
    output: str
    fractions: tuple[float, float, float] = (0.8, 0.1, 0.1)
    minimum_dates: tuple[int, int, int] = (3, 1, 2)
    minimum_benign: int = 100
    minimum_malicious: int = 100
    may_be_infinite: list[str] = field(default_factory=lambda: ["Flow Byts/s", "Flow Pkts/s"])
    categorical: list[str] = field(default_factory=lambda: ["Protocol"])
    benign: str = "Benign"

    def __post_init__(self) -> None:
        check(abs(sum(self.fractions) - 1) < 1e-9 and all(f > 0 for f in self.fractions), "fractions must be positive and add up to 1")
        raw, out = os.path.abspath(self.raw), os.path.abspath(self.output)
        check(os.path.commonpath([raw, out]) not in (raw, out), "input and output must be apart")


def load_config(path: str) -> Config:
    with open(path, encoding="utf-8") as file:
        values = json.load(file)
    known = set(Config.__dataclass_fields__)
    check(set(values) <= known, f"unknown settings: {sorted(set(values) - known)}")
    return Config(**{k: tuple(v) if k in ("fractions", "minimum_dates") else v for k, v in values.items()})


@dataclass
class ThresholdLock:
    """Thresholds chosen on validation rows, frozen with the hash of what they were chosen from."""

    thresholds: list[dict]
    source_hash: str

    def save(self, path: str) -> None:
        check(not os.path.exists(path), "the lock exists")
        write_json(path, {"thresholds": self.thresholds, "source_hash": self.source_hash})

    @staticmethod
    def load(path: str, source_hash: str) -> ThresholdLock:
        with open(path, encoding="utf-8") as file:
            value = json.load(file)
        check(value["source_hash"] == source_hash, "the scores changed since the lock")
        return ThresholdLock(value["thresholds"], source_hash)
