"""A store of small JSON results, one file for each unit of work: atomic, checksummed, readable as a table."""

from __future__ import annotations

import hashlib
import json
import math
import os
import re
import tempfile
from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "unit_id string, payload string, metadata string, checksum string, written_at string"


class CorruptShardError(ValueError):
    pass


def to_jsonable(value):
    """Plain JSON values; numbers that JSON lacks become strings; unknown types are an error."""
    if value is None or isinstance(value, (bool, int, str)):
        return value
    if isinstance(value, float):
        return value if math.isfinite(value) else str(value)
    if isinstance(value, np.generic):
        return to_jsonable(value.item())
    if isinstance(value, np.ndarray):
        return to_jsonable(value.tolist())
    if isinstance(value, dict):
        return {str(k): to_jsonable(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set, frozenset)):
        return [to_jsonable(v) for v in (sorted(value) if isinstance(value, (set, frozenset)) else value)]
    if isinstance(value, Path):
        return str(value)
    raise TypeError(f"no JSON for {type(value).__name__}")


def canonical(value) -> str:
    return json.dumps(to_jsonable(value), sort_keys=True, separators=(",", ":"), allow_nan=False)


def checksum(payload) -> str:
    return hashlib.sha256(canonical(payload).encode()).hexdigest()


@dataclass(frozen=True)
class Shard:
    unit_id: str
    payload: dict
    metadata: dict
    checksum: str
    written_at: str

    def verify(self) -> bool:
        return checksum(self.payload) == self.checksum


class ShardStore:
    def __init__(self, root: str | Path, *, strict: bool = False) -> None:
        self.root, self.strict = Path(root), strict
        self.root.mkdir(parents=True, exist_ok=True)

    def path_for(self, unit_id: str) -> Path:
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.\-]*", unit_id):
            raise ValueError(f"{unit_id!r} is no safe file name")
        return self.root / f"{unit_id}.json"

    def write(self, unit_id: str, payload: dict, **metadata) -> Path:
        path = self.path_for(unit_id)
        record = {"unit_id": unit_id, "payload": to_jsonable(payload), "metadata": to_jsonable(metadata), "checksum": checksum(payload), "written_at": datetime.now(timezone.utc).isoformat()}
        fd, temporary = tempfile.mkstemp(prefix=".tmp-", dir=self.root)
        with os.fdopen(fd, "w") as out:
            json.dump(record, out, allow_nan=False)
            out.flush()
            os.fsync(out.fileno())
        os.replace(temporary, path)
        return path

    def read(self, unit_id: str) -> Shard | None:
        path = self.path_for(unit_id)
        if not path.exists():
            return None
        try:
            shard = Shard(**json.loads(path.read_text()))
            if not shard.verify():
                raise ValueError("checksum differs")
            return shard
        except (ValueError, TypeError, AttributeError) as error:
            if self.strict:
                raise CorruptShardError(f"{path.name}: {error}") from error
            return None

    def exists(self, unit_id: str) -> bool:
        return self.read(unit_id) is not None

    __contains__ = exists

    def __len__(self) -> int:
        return len(self._paths())

    def _paths(self) -> list[Path]:
        return sorted(p for p in self.root.glob("*.json") if not p.name.startswith(".tmp-"))

    def completed_units(self) -> set[str]:
        return {p.stem for p in self._paths() if self.exists(p.stem)}

    def pending(self, unit_ids: list[str]) -> list[str]:
        done = self.completed_units()
        return [u for u in unit_ids if u not in done]

    def load_all(self) -> list[Shard]:
        return [s for p in self._paths() if (s := self.read(p.stem)) is not None]

    def delete(self, unit_id: str) -> bool:
        path = self.path_for(unit_id)
        existed = path.exists()
        path.unlink(missing_ok=True)
        return existed

    def clear_corrupt(self) -> list[str]:
        lenient = ShardStore(self.root)
        bad = [p.stem for p in self._paths() if not lenient.exists(p.stem)]
        for unit in bad:
            self.delete(unit)
        return bad

    def clear_temporary(self) -> int:
        left = list(self.root.glob(".tmp-*"))
        for p in left:
            p.unlink()
        return len(left)

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """Shards as rows: metadata and payload as columns, the payload's winning where names clash; absent ones null."""
        records = [{"unit_id": s.unit_id} | {k: v if isinstance(v, (str, int, float, bool, type(None))) else canonical(v) for k, v in (s.metadata | s.payload).items()} for s in self.load_all()]
        names = sorted({k for r in records for k in r})
        if not records:
            return spark.createDataFrame([], "unit_id string")
        as_float = {k for k in names if any(isinstance(r.get(k), float) for r in records)}
        return spark.createDataFrame([tuple(float(r[k]) if k in as_float and r.get(k) is not None and not isinstance(r[k], str) else r.get(k) for k in names) for r in records], names)
