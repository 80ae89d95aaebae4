"""Measurements of a run as CSV lines."""

from __future__ import annotations

import csv
import sys
import time
import uuid
from contextlib import AbstractContextManager
from typing import TextIO


class BenchmarkLog(AbstractContextManager):
    """A header with facts about the run as comments, then a line for each measurement; columns are fixed by name."""

    def __init__(self, name: str, columns: list[str], facts: dict[str, object] | None = None, to: TextIO | None = None) -> None:
        if not columns or len(set(columns)) != len(columns):
            raise ValueError("columns need distinct names")
        self.name, self.columns, self.facts, self.to, self.id = name, columns, facts or {}, to or sys.stdout, uuid.uuid4().hex

    def __enter__(self) -> BenchmarkLog:
        for k, v in {"benchmark": self.name, "id": self.id, "started": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), **self.facts}.items():
            self.to.write(f"# {k}: {v}\n")
        self.out = csv.DictWriter(self.to, self.columns, lineterminator="\n")
        self.out.writeheader()
        return self

    def log(self, **values: object) -> None:
        if set(values) != set(self.columns):
            raise ValueError(f"a measurement needs {self.columns}")
        self.out.writerow(values)

    def __exit__(self, *error: object) -> None:
        self.to.flush()
