"""Reports and manifests as JSON."""

from __future__ import annotations

import hashlib
import json
import math
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanloom.model import InspectionError


def _finite(value: Any) -> Any:
    """The value with every NaN and infinity as null."""
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, dict):
        return {k: _finite(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_finite(v) for v in value]
    return value


def serialize_result(report: dict) -> str:
    """A report as JSON with sorted keys, so equal reports are equal texts."""
    try:
        return json.dumps(_finite(report), sort_keys=True, allow_nan=False)
    except (TypeError, ValueError) as error:
        raise InspectionError("serialization_failed", "serialization", str(error)) from None


def sha256_hex(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def sha256_column(column: str) -> Column:
    return F.sha2(column, 256)


def build_manifest(schema_version: str, generator: str, files: dict[str, str]) -> str:
    """Which files belong to a result, with the SHA-256 of each."""
    return json.dumps({"files": [{"path": p, "sha256": h} for p, h in files.items()], "generator": generator, "schema_version": schema_version}, indent=2, sort_keys=True)
