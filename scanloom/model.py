"""Values of the inspection: errors, units, poses, and the configuration with its validation."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field
from types import SimpleNamespace
from typing import Any

SCHEMA_VERSION = "1.0"

# Names used in configurations and reports.
ERROR_CODES = ("invalid_argument", "invalid_input", "unsupported_format", "io_error", "registration_failed", "insufficient_coverage", "serialization_failed", "internal_error")
STAGES = ("none", "validate", "normalize", "preprocess", "registration", "registration_gate", "transform", "compare", "coverage_gate", "detect", "finalize", "serialization")
MM_PER_UNIT = {"millimeter": 1.0, "meter": 1000.0, "micrometer": 0.001}
METHODS = ("point_to_plane", "point_to_point", "gicp")
BACKENDS = ("cpu", "gpu", "auto")
INVALID_REASONS = ("none", "row_padding", "input_masked", "non_finite_point", "non_finite_normal", "outside_roi")
NORMAL_REASONS = ("none", "input_invalid", "normal_missing")
DEVIATION_REASONS = ("valid", "input_invalid", "no_neighbor", "normal_missing", "normal_mismatch", "reference_boundary")
COVERAGE_REASONS = ("covered", "input_invalid", "no_neighbor", "scan_boundary")
CLASSES = ("bump", "dent", "missing_material")  # also the order of regions in a report
FLOAT_MAX = 3.4028234663852886e38


class InspectionError(Exception):
    """A call that could not complete. A FAIL or INDETERMINATE verdict is a result, not an error."""

    def __init__(self, code: str, stage: str, message: str, context: dict[str, str] | None = None) -> None:
        assert code in ERROR_CODES and stage in STAGES
        super().__init__(f"{code} in {stage}: {message}" + (f" {context}" if context else ""))
        self.code, self.stage, self.message, self.context = code, stage, message, dict(sorted((context or {}).items()))


def frame_id(value: str) -> str:
    """A frame's name: any non-empty text that UTF-8 can hold."""
    try:
        if not isinstance(value, str) or not value or not value.encode("utf-8"):
            raise ValueError("must be non-empty")
    except (UnicodeEncodeError, ValueError) as error:
        raise InspectionError("invalid_argument", "validate", "invalid frame identifier", {"reason": str(error)}) from None
    return value


def to_millimeters(value: float, unit: str) -> float:
    if unit not in MM_PER_UNIT:
        raise InspectionError("invalid_argument", "normalize", "unknown length unit", {"unit": str(unit)})
    if not math.isfinite(value):
        raise InspectionError("invalid_input", "normalize", "length must be finite")
    return value * MM_PER_UNIT[unit]


IDENTITY = (1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0)


@dataclass(frozen=True)
class RigidTransform:
    """A row-major 4 x 4 rotation and translation from ``source`` to ``target``, for column vectors."""

    matrix: tuple[float, ...]
    source: str
    target: str

    @staticmethod
    def create(matrix: Any, source: str, target: str, tolerance: float = 1e-9) -> RigidTransform:
        m = tuple(float(x) for x in matrix)
        problem = ""
        if len(m) != 16 or not all(math.isfinite(x) for x in m):
            problem = "needs 16 finite numbers"
        elif not (math.isfinite(tolerance) and tolerance >= 0):
            problem = "tolerance must be finite and non-negative"
        elif any(abs(a - b) > tolerance for a, b in zip(m[12:], (0.0, 0.0, 0.0, 1.0))):
            problem = "last row must be 0 0 0 1"
        else:
            columns = [(m[i], m[4 + i], m[8 + i]) for i in range(3)]
            for i in range(3):
                for j in range(3):
                    if abs(sum(a * b for a, b in zip(columns[i], columns[j])) - (i == j)) > tolerance:
                        problem = "rotation must be orthonormal"
            a, b, c = columns
            det = a[0] * (b[1] * c[2] - b[2] * c[1]) - b[0] * (a[1] * c[2] - a[2] * c[1]) + c[0] * (a[1] * b[2] - a[2] * b[1])
            if not problem and abs(det - 1.0) > tolerance:
                problem = "rotation must have determinant 1"
        if problem:
            raise InspectionError("invalid_argument", "validate", "invalid rigid transform", {"reason": problem})
        return RigidTransform(m, frame_id(source), frame_id(target))

    @staticmethod
    def identity(source: str, target: str) -> RigidTransform:
        return RigidTransform.create(IDENTITY, source, target)

    def apply(self, point: tuple[float, float, float]) -> tuple[float, float, float]:
        m, (x, y, z) = self.matrix, point
        return tuple(((m[r] * x + m[r + 1] * y) + m[r + 2] * z) + m[r + 3] for r in (0, 4, 8))  # type: ignore[return-value]


# ---------------------------------------------------------------------------------- configuration

_Check = Callable[[Any], bool]
_number: _Check = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v)
_whole: _Check = lambda v: isinstance(v, int) and not isinstance(v, bool) and 0 <= v < 2**64


def _between(low: float, high: float, closed_low: bool = True) -> _Check:
    return lambda v: _number(v) and (v >= low if closed_low else v > low) and v <= high


_positive: _Check = lambda v: _number(v) and v > 0
_non_negative: _Check = lambda v: _number(v) and v >= 0
_POSITIVE, _NON_NEGATIVE = (_positive, "must be finite and positive"), (_non_negative, "must be finite and non-negative")

# Every required field with its rule, in the order in which problems are reported.
RULES: tuple[tuple[str, str, _Check, str], ...] = (
    ("preprocess", "voxel_size_mm", *_POSITIVE),
    ("preprocess", "normal_radius_mm", *_POSITIVE),
    ("preprocess", "normal_min_neighbors", lambda v: _whole(v) and v >= 3, "must be at least 3"),
    ("preprocess", "boundary_radius_mm", *_POSITIVE),
    ("registration", "max_iterations", lambda v: _whole(v) and 1 <= v <= 1000, "must be in [1, 1000]"),
    ("registration", "max_correspondence_distance_mm", *_POSITIVE),
    ("registration", "huber_delta_mm", *_POSITIVE),
    ("registration", "translation_epsilon_mm", *_POSITIVE),
    ("registration", "rotation_epsilon_rad", *_POSITIVE),
    ("registration", "residual_epsilon_mm", *_POSITIVE),
    ("registration_gate", "min_overlap_ratio", _between(0, 1), "must be in [0, 1]"),
    ("registration_gate", "max_inlier_rmse_mm", *_POSITIVE),
    ("registration_gate", "min_valid_pairs", lambda v: _whole(v) and v > 0, "must be positive"),
    ("registration_gate", "max_translation_from_initial_mm", *_POSITIVE),
    ("registration_gate", "max_rotation_from_initial_deg", _between(0, 180, closed_low=False), "must be in (0, 180]"),
    ("comparison", "max_search_distance_mm", *_POSITIVE),
    ("comparison", "max_normal_angle_deg", _between(0, 90), "must be in [0, 90]"),
    ("comparison", "boundary_exclusion_mm", *_NON_NEGATIVE),
    ("comparison", "min_valid_coverage_ratio", _between(0, 1), "must be in [0, 1]"),
    ("detection", "positive_threshold_mm", *_POSITIVE),
    ("detection", "negative_threshold_mm", lambda v: _number(v) and v < 0, "must be finite and negative"),
    ("detection", "cluster_tolerance_mm", *_POSITIVE),
    ("detection", "min_cluster_points", lambda v: _whole(v) and v > 0, "must be positive"),
    ("detection", "measurement_error_budget_mm", *_NON_NEGATIVE),
    ("execution", "deterministic", lambda v: isinstance(v, bool), "must be a boolean"),
    ("execution", "thread_count", lambda v: _whole(v) and v >= 1, "must be at least 1"),
    ("execution", "random_seed", _whole, "must be a non-negative integer"),
)
SECTIONS = ("input", "preprocess", "registration", "registration_gate", "comparison", "detection", "execution")
_INPUT = ("reference_unit", "scan_unit", "reference_frame", "scan_frame")


@dataclass
class InspectionConfig:
    """A configuration as given; any field may be absent."""

    schema_version: str = ""
    profile: str = ""
    sections: dict[str, dict[str, Any]] = field(default_factory=dict)

    def get(self, section: str, name: str) -> Any:
        default = {"method": "point_to_plane", "backend": "cpu"}.get(name)
        value = self.sections.get(section, {}).get(name)
        return default if value is None else value


def _known(section: str) -> list[str]:
    extra = {"input": list(_INPUT), "registration": ["method"], "execution": ["backend"]}.get(section, [])
    return extra + [n for s, n, _, _ in RULES if s == section]


def parse_config(text: str) -> InspectionConfig:
    """Read a configuration. Missing and null fields are absent, unknown keys are ignored, unknown names are errors."""

    def bad(message: str) -> InspectionError:
        return InspectionError("invalid_input", "serialization", message)

    try:
        document = json.loads(text)
    except (ValueError, RecursionError) as error:
        raise bad(str(error)) from None
    if not isinstance(document, dict) or "schema_version" not in document:
        raise bad("missing schema_version")
    if document["schema_version"] != SCHEMA_VERSION:
        raise bad("unsupported schema_version")
    profile = document.get("profile", "")
    if not isinstance(profile, str):
        raise bad("profile must be a string")
    sections: dict[str, dict[str, Any]] = {}
    for section in SECTIONS:
        given = document.get(section, {})
        if not isinstance(given, dict):
            raise bad(f"{section} must be an object")
        sections[section] = {n: given[n] for n in _known(section) if given.get(n) is not None}
        for name, value in sections[section].items():
            if name in ("deterministic",):
                good = isinstance(value, bool)
            elif name in (*_INPUT, "method", "backend"):
                good = isinstance(value, str)
            else:
                good = isinstance(value, (int, float)) and not isinstance(value, bool)
            if not good:
                raise bad(f"{section}.{name} has the wrong type")
    for name in ("reference_unit", "scan_unit"):
        if sections["input"].get(name, "meter") not in MM_PER_UNIT:
            raise bad("unknown length unit")
    for name in ("reference_frame", "scan_frame"):
        if name in sections["input"]:
            frame_id(sections["input"][name])
    if sections["registration"].get("method", METHODS[0]) not in METHODS:
        raise bad("unknown registration method")
    if sections["execution"].get("backend", BACKENDS[0]) not in BACKENDS:
        raise bad("unknown compute backend")
    return InspectionConfig(SCHEMA_VERSION, profile, sections)


def serialize_config(config: InspectionConfig) -> str:
    """The configuration as JSON; absent fields are null."""
    document: dict[str, Any] = {"schema_version": config.schema_version, "profile": config.profile}
    for section in SECTIONS:
        document[section] = {n: config.get(section, n) for n in _known(section)}
    return json.dumps(document)


def validate_config(config: InspectionConfig) -> SimpleNamespace:
    """All fields present and within their rules, as ``validated.section.field``; else the first problem is raised."""

    def fail(name: str, reason: str) -> InspectionError:
        return InspectionError("invalid_argument", "validate", "invalid inspection configuration", {"field": name, "reason": reason})

    if not config.schema_version:
        raise fail("schema_version", "is required")
    if config.schema_version != SCHEMA_VERSION:
        raise fail("schema_version", "must equal supported version 1.0")
    if not config.profile:
        raise fail("profile", "is required")
    try:
        config.profile.encode("utf-8")
    except UnicodeEncodeError:
        raise fail("profile", "must be valid UTF-8") from None
    for name in _INPUT[:2]:
        if config.get("input", name) is None:
            raise fail(f"input.{name}", "is required")
    for name in _INPUT[:2]:
        if config.get("input", name) not in MM_PER_UNIT:
            raise fail(f"input.{name}", "enumerator is not supported")
    for name in _INPUT[2:]:
        if config.get("input", name) is None:
            raise fail(f"input.{name}", "is required")
    for section, name, check, rule in RULES:
        value = config.get(section, name)
        if value is None:
            raise fail(f"{section}.{name}", "is required")
        if not check(value):
            raise fail(f"{section}.{name}", rule)
        if name == "measurement_error_budget_mm":
            for threshold in ("positive_threshold_mm", "negative_threshold_mm"):
                if abs(config.get("detection", threshold)) <= value:
                    raise fail(f"detection.{threshold}", "must exceed measurement error budget")
    if config.get("registration", "method") not in METHODS:
        raise fail("registration.method", "unsupported method")
    if config.get("execution", "backend") not in BACKENDS:
        raise fail("execution.backend", "unsupported backend")
    groups = {s: SimpleNamespace(**{n: config.get(s, n) for n in _known(s)}) for s in SECTIONS}
    return SimpleNamespace(schema_version=config.schema_version, profile=config.profile, **groups)


@dataclass(frozen=True)
class RegistrationParameters:
    max_iterations: int
    max_correspondence_distance_mm: float
    huber_delta_mm: float
    translation_epsilon_mm: float
    rotation_epsilon_rad: float
    residual_epsilon_mm: float
    method: str = "point_to_plane"
    covariance_neighbors: int = 12
    covariance_epsilon: float = 0.001

    def validate(self) -> RegistrationParameters:
        rules = {
            "max_iterations": 1 <= self.max_iterations <= 1000,
            "max_correspondence_distance_mm": _positive(self.max_correspondence_distance_mm),
            "huber_delta_mm": _positive(self.huber_delta_mm),
            "translation_epsilon_mm": _positive(self.translation_epsilon_mm),
            "rotation_epsilon_rad": _positive(self.rotation_epsilon_rad),
            "residual_epsilon_mm": _positive(self.residual_epsilon_mm),
            "method": self.method in METHODS,
            "covariance_neighbors": 3 <= self.covariance_neighbors <= 1024,
            "covariance_epsilon": _between(0, 1, closed_low=False)(self.covariance_epsilon),
        }
        for name, good in rules.items():
            if not good:
                raise InspectionError("invalid_argument", "registration", "invalid registration parameters", {"field": name})
        return self
