"""The inspection: normalize, prepare, register, gate, compare, detect, conclude."""

from __future__ import annotations

import datetime
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict
from typing import Any

from pyspark.sql import DataFrame

import scanloom
from scanloom.model import InspectionConfig, InspectionError, RegistrationParameters, RigidTransform, validate_config
from scanloom.operators import compare, detect
from scanloom.operators.preprocess import Prepared, prepare
from scanloom.operators.registration import GATE_MESSAGES, RegistrationContext, RegistrationMetrics, evaluate_gate, select_backend
from scanloom.surface import Surface, normalize_surface


def _parameters(config: Any) -> RegistrationParameters:
    r = config.registration
    return RegistrationParameters(r.max_iterations, r.max_correspondence_distance_mm, r.huber_delta_mm, r.translation_epsilon_mm, r.rotation_epsilon_rad, r.residual_epsilon_mm, r.method)


def pose_json(pose: RigidTransform | None) -> dict | None:
    return None if pose is None else {"source_frame": pose.source, "target_frame": pose.target, "matrix": list(pose.matrix)}


class _Timer:
    """Stage times. A stage is made to run by an action inside it; without timings plans stay lazy across stages."""

    def __init__(self) -> None:
        self.timings: list[dict] = []

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        start = time.monotonic()
        try:
            yield
        finally:
            self.timings.append({"stage": name, "duration_us": int((time.monotonic() - start) * 1e6)})


class InspectionPipeline:
    """Inspects scans against references under one validated configuration."""

    def __init__(self, config: InspectionConfig) -> None:
        self.config = validate_config(config)

    def _prepare(self, surface: Surface) -> Prepared:
        p = self.config.preprocess
        made = prepare(normalize_surface(surface, surface.frame), p.normal_radius_mm, p.normal_min_neighbors, p.boundary_radius_mm)
        return Prepared(_held(made.surface), made.orientation_proven)

    def run(self, reference: Surface, scan: Surface, initial_pose: RigidTransform | None = None, run_id: str = "") -> dict:
        """The report of one inspection."""
        context = InspectionContext(self.config, self._prepare(reference))
        try:
            return context.run(scan, initial_pose, run_id)
        finally:
            context.close()

    def context(self, reference: Surface) -> InspectionContext:
        """The reference prepared once, for many scans."""
        return InspectionContext(self.config, self._prepare(reference))


def _released(index) -> None:  # noqa: ANN001
    if isinstance(index, DataFrame):
        index.unpersist()
    else:
        index.close()


def _held(surface: Surface) -> Surface:
    surface.df.persist()
    return surface


class InspectionContext:
    """A prepared reference with its registration context. No state passes from scan to scan."""

    def __init__(self, config: Any, reference: Prepared) -> None:
        self.config, self.reference = config, reference
        select_backend(config.execution.backend)
        self._registration: RegistrationContext | None = None
        self._index = compare.sized_deviation_index(reference.surface.df, config.comparison.max_search_distance_mm)
        if isinstance(self._index, DataFrame):
            self._index.persist()

    def close(self) -> None:
        if self._registration is not None:
            self._registration.close()
        _released(self._index)
        self.reference.surface.df.unpersist()

    def run(self, scan: Surface, initial_pose: RigidTransform | None = None, run_id: str = "") -> dict:
        c, ref = self.config, self.reference.surface
        timer = _Timer()
        diagnostics: list[dict] = []
        report: dict[str, Any] = {
            "schema_version": c.schema_version, "verdict": "indeterminate", "registration": None, "coverage": _zeros(_COVERAGE), "deviations": _zeros(_DEVIATION), "regions": [],
            "timings": timer.timings, "diagnostics": diagnostics,
            "provenance": {
                "schema_version": c.schema_version, "run_id": run_id, "profile": c.profile, "generator_version": scanloom.__version__,
                "timestamp_utc": datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), "deterministic": c.execution.deterministic,
                "thread_count": c.execution.thread_count, "random_seed": c.execution.random_seed,
            },
        }
        with timer.stage("normalize"):
            scan_mm = normalize_surface(scan, scan.frame)
        held, indices = [], []
        try:
            with timer.stage("preprocess"):
                p = c.preprocess
                prepared = _held(prepare(scan_mm, p.normal_radius_mm, p.normal_min_neighbors, p.boundary_radius_mm).surface)
                held.append(prepared.df)
            with timer.stage("registration"):
                if initial_pose is None:
                    pose = RigidTransform.identity(prepared.frame, ref.frame)
                    diagnostics.append(_note("invalid_input", "registration", "no initial pose provided; using identity"))
                elif (initial_pose.source, initial_pose.target) != (prepared.frame, ref.frame):
                    raise InspectionError("invalid_input", "registration", "initial pose must lead from the scan's frame to the reference's")
                else:
                    pose = initial_pose
                if self._registration is None:
                    self._registration = RegistrationContext(ref, _parameters(c), c.execution.backend)
                metrics = self._registration.align(prepared, pose)
            report["registration"] = self._registered(pose, metrics)
            with timer.stage("registration_gate"):
                failure = evaluate_gate(metrics, c.registration_gate)
            if failure != "none":
                diagnostics.append(_note("registration_failed", "registration_gate", GATE_MESSAGES[failure]))
                return report
            with timer.stage("transform"):
                aligned = normalize_surface(prepared, ref.frame, metrics.final_transform)
            with timer.stage("compare"):
                field = compare.deviation_field(aligned.df, self._index, c.comparison.max_search_distance_mm, c.comparison.max_normal_angle_deg).persist()
                indices.append(compare.sized_coverage_index(aligned.df, c.comparison.max_search_distance_mm))
                cover = compare.coverage_field(ref.df, aligned.df, c.comparison.max_search_distance_mm, index=indices[0]).persist()
                held += [field, cover]
                report["deviations"] = compare.deviation_report(field, padding=aligned.padding)
                report["coverage"] = compare.coverage_summary(cover, padding=ref.padding).first().asDict()
            with timer.stage("coverage_gate"):
                failed = report["coverage"]["coverage_ratio"] < c.comparison.min_valid_coverage_ratio
                if failed:
                    diagnostics.append(_note("insufficient_coverage", "coverage_gate", "coverage ratio is below the minimum"))
            with timer.stage("detect"):
                report["regions"] = self._regions(field, cover)
            rejected = any(r["severity"] == "reject" for r in report["regions"])
            if failed or not report["deviations"]["valid_count"]:
                report["verdict"] = "indeterminate"
            else:
                report["verdict"] = "fail" if rejected else "pass"
            return report
        finally:
            for df in held:
                df.unpersist()
            for index in indices:
                _released(index)

    def _regions(self, field, cover) -> list[dict]:  # noqa: ANN001
        d = self.config.detection
        candidates = detect.deviation_candidates(field, d.positive_threshold_mm, d.negative_threshold_mm).unionByName(detect.missing_candidates(cover))
        measured = detect.measure(detect.cluster(candidates, d.cluster_tolerance_mm, d.min_cluster_points))
        found = detect.numbered(measured).withColumn("severity", detect.default_severity(d.positive_threshold_mm, d.negative_threshold_mm))
        rows = [r.asDict(recursive=True) for r in found.orderBy("id").collect()]
        return [{"id": r.pop("id"), "type": r.pop("class"), **{k: v for k, v in r.items() if k != "cluster"}} for r in rows]

    def _registered(self, pose: RigidTransform, m: RegistrationMetrics) -> dict:
        c = self.config
        return {
            "initial_pose": pose_json(pose), "final_pose": pose_json(m.final_transform), "iterations": m.iterations, "converged": m.convergence == "converged",
            "valid_pairs": m.valid_pairs, "overlap_ratio": m.fitness, "inlier_rmse_mm": m.inlier_rmse_mm, "termination_reason": m.convergence,
            "method": c.registration.method, "requested_backend": c.execution.backend, "actual_backend": self._registration.backend, "execution_scope": "cpu",
            "rmse_metric": "point_to_plane_mm" if c.registration.method == "point_to_plane" else "euclidean_mm",
        }


_COVERAGE = ("valid_count", "covered_count", "coverage_ratio", "input_invalid", "no_neighbor", "scan_boundary")
_DEVIATION = ("valid_count", "mean_signed_mm", "rms_mm", "max_abs_mm", "p95_abs_mm", "input_invalid", "no_neighbor", "normal_missing", "normal_mismatch", "reference_boundary")


def _zeros(names: tuple[str, ...]) -> dict:
    return {n: 0.0 if n.endswith(("_mm", "_ratio")) else 0 for n in names}


def _note(code: str, stage: str, message: str) -> dict:
    return {"code": code, "stage": stage, "message": message, "context": {}}


def metrics_table(spark, metrics: list[RegistrationMetrics]):  # noqa: ANN001, ANN201
    """Alignments as rows, for the gate as a column expression."""
    rows = [{k: v for k, v in asdict(m).items() if k != "final_transform"} | {"final_pose": list(m.final_transform.matrix)} for m in metrics]
    kind = "convergence string, iterations int, valid_pairs long, fitness double, inlier_rmse_mm double, translation_delta_mm double, rotation_delta_deg double, final_pose array<double>"
    return spark.createDataFrame(rows, kind)
