"""Synthetic surfaces and the configuration they are inspected with."""

import json
import math

import numpy as np

from scanloom.model import RigidTransform, parse_config
from scanloom.surface import from_points

FRAME, SCANNER = "fixture", "scanner"

CONFIG = {
    "schema_version": "1.0", "profile": "workbench",
    "input": {"reference_unit": "millimeter", "scan_unit": "millimeter", "reference_frame": FRAME, "scan_frame": SCANNER},
    "preprocess": {"voxel_size_mm": 0.3, "normal_radius_mm": 1.25, "normal_min_neighbors": 9, "boundary_radius_mm": 0.9},
    "registration": {"method": "point_to_plane", "max_iterations": 45, "max_correspondence_distance_mm": 1.1, "huber_delta_mm": 0.25, "translation_epsilon_mm": 5e-5, "rotation_epsilon_rad": 5e-6, "residual_epsilon_mm": 5e-6},
    "registration_gate": {"min_overlap_ratio": 0.6, "max_inlier_rmse_mm": 0.18, "min_valid_pairs": 400, "max_translation_from_initial_mm": 4.0, "max_rotation_from_initial_deg": 4.0},
    "comparison": {"max_search_distance_mm": 1.3, "max_normal_angle_deg": 32.0, "boundary_exclusion_mm": 0.5, "min_valid_coverage_ratio": 0.7},
    "detection": {"positive_threshold_mm": 0.2, "negative_threshold_mm": -0.2, "cluster_tolerance_mm": 0.65, "min_cluster_points": 9, "measurement_error_budget_mm": 0.0},
    "execution": {"backend": "cpu", "deterministic": True, "thread_count": 1, "random_seed": 11},
}


def config(**changes):
    document = json.loads(json.dumps(CONFIG))
    for key, value in changes.items():
        section, name = key.split("__")
        document[section][name] = value
    return parse_config(json.dumps(document))


def lattice(half=6.4, step=0.4):
    axis = np.arange(round(2 * half / step) + 1) * step - half
    x, y = np.meshgrid(axis, axis, indexing="ij")
    return x.ravel(), y.ravel()


def plane(height=0.0, radius=1.8, cx=0.0, cy=0.0, nz=1.0, half=6.4, step=0.4):
    """Points and constant normals of a plane with a round knob on it, whose height falls off as a cosine."""
    x, y = lattice(half, step)
    r = np.minimum(np.hypot(x - cx, y - cy) / radius, 1.0)
    return np.column_stack([x, y, height * (1 + np.cos(np.pi * r)) / 2]), np.tile([0.0, 0.0, nz], (len(x), 1))


def ripples():
    """A saddle with waves along both axes, and its exact normals."""
    x, y = lattice()
    z = 0.22 * np.sin(0.9 * x) * np.cos(0.7 * y) + 0.015 * x * x - 0.01 * y * y
    zx = 0.198 * np.cos(0.9 * x) * np.cos(0.7 * y) + 0.03 * x
    zy = -0.154 * np.sin(0.9 * x) * np.sin(0.7 * y) - 0.02 * y
    n = np.column_stack([-zx, -zy, np.ones_like(x)])
    return np.column_stack([x, y, z]), n / np.linalg.norm(n, axis=1, keepdims=True)


def turn_z(degrees, translation):
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return np.array([[c, -s, 0, translation[0]], [s, c, 0, translation[1]], [0, 0, 1, translation[2]], [0, 0, 0, 1]], dtype=float)


def moved(points, normals, matrix):
    return points @ matrix[:3, :3].T + matrix[:3, 3], normals @ matrix[:3, :3].T


def surface(spark, points, normals=(), frame=SCANNER, **more):
    return from_points(spark, points, normals, frame=frame, **more)


def patch(side, shifted):
    """A shallow curved patch, optionally shifted."""
    # Spacing, curvatures and shift that belong to the poses of test_pipeline.py.
    i = (np.arange(side) - side // 2) * 0.25
    x, y = (a.ravel() for a in np.meshgrid(i, i, indexing="ij"))
    z = 0.008 * x * x + 0.013 * y * y
    n = np.column_stack([-0.016 * x, -0.026 * y, np.ones_like(x)])
    p = np.column_stack([x, y, z]) + (np.array([-0.003, 0.002, -0.01]) if shifted else 0.0)
    return p, n / np.linalg.norm(n, axis=1, keepdims=True)


def identity(source=SCANNER, target=FRAME):
    return RigidTransform.identity(source, target)
