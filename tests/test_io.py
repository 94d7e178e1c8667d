"""Point files, configuration and report JSON, manifest, command line, stream."""

import json
import os

import numpy as np
import pytest

import scenes as S
from scanloom import cli
from scanloom.model import InspectionError, parse_config, serialize_config, validate_config
from scanloom.report import build_manifest, serialize_result, sha256_hex
from scanloom.sources import point_files as pf
from scanloom.surface import from_points

NAN = float("nan")


def _grid(spark):
    points = [(1, 2, 3), (4, 5, 6), (99, 99, 99), (NAN, NAN, NAN), (7, 8, 9)]
    normals = [(0, 0, 1), (0, 1, 0), (1, 0, 0), (NAN, NAN, NAN), (1, 0, 0)]
    return from_points(spark, points, normals, [1, 1, 0, 0, 1], (2, 2, 3), frame="scanner")


@pytest.mark.parametrize("kind,encoding", [("ply", "ascii"), ("ply", "binary"), ("pcd", "ascii"), ("pcd", "binary")])
def test_round_trip_of_a_masked_grid(spark, tmp_path, kind, encoding):
    path = str(tmp_path / f"organized.{kind.upper()}")
    write, read = (pf.write_ply, pf.read_ply) if kind == "ply" else (pf.write_pcd, pf.read_pcd)
    assert write(_grid(spark), path, encoding) == 4
    back = read(spark, path, "millimeter", "scanner", rows=3)
    assert (back.width, back.height, back.row_stride, back.has_normals, back.has_mask) == (2, 2, 2, True, True)
    rows = back.df.orderBy("idx").collect()
    assert [r["valid"] for r in rows] == [True, True, False, True]
    assert (rows[3]["x"], rows[3]["nx"], rows[3]["row_idx"], rows[3]["col_idx"]) == (7.0, 1.0, 1, 1)


def test_short_normal_names_and_derived_mask(spark, tmp_path):
    path = tmp_path / "a.ply"
    path.write_text("ply\nformat ascii 1.0\nelement vertex 3\n" + "".join(f"property float {n}\n" for n in ("x", "y", "z", "nx", "ny", "nz")) + "end_header\n0 0 0 0 0 1\n1 0 0 0 0 1\nnan 0 0 0 0 1\n")
    s = pf.read_ply(spark, str(path), "millimeter", "f")
    assert s.has_normals and s.has_mask and [r["valid"] for r in s.df.orderBy("idx").collect()] == [True, True, False]


@pytest.mark.parametrize("fields,code", [(("x", "y"), "unsupported_format"), (("x", "y", "z", "normal_x"), "unsupported_format")])
def test_field_rules(spark, tmp_path, fields, code):
    path = tmp_path / "a.ply"
    path.write_text("ply\nformat ascii 1.0\nelement vertex 1\n" + "".join(f"property float {n}\n" for n in fields) + "end_header\n" + "0 " * len(fields) + "\n")
    with pytest.raises(InspectionError) as error:
        pf.read_ply(spark, str(path), "millimeter", "f")
    assert error.value.code == code


def test_mask_rules_paths_and_missing_files(spark, tmp_path):
    for row in ("0 0 0 2", "nan 0 0 1"):
        path = tmp_path / "m.pcd"
        path.write_text(f"VERSION 0.7\nFIELDS x y z valid\nSIZE 4 4 4 1\nTYPE F F F U\nCOUNT 1 1 1 1\nWIDTH 1\nHEIGHT 1\nPOINTS 1\nDATA ascii\n{row}\n")
        with pytest.raises(InspectionError) as error:
            pf.read_pcd(spark, str(path), "millimeter", "f")
        assert error.value.code == "invalid_input"
    for bad in ("", "a\0.ply", "a.obj"):
        with pytest.raises(InspectionError):
            pf.read_ply(spark, bad, "millimeter", "f")
    with pytest.raises(InspectionError) as error:
        pf.read_ply(spark, str(tmp_path / "none.ply"), "millimeter", "f")
    assert error.value.code == "io_error"


def test_compressed_pcd(spark, tmp_path):
    values = np.array([1, 2, 3, 4, 5, 6], "<f4").tobytes()
    packed = b"".join(bytes([len(values[i : i + 32]) - 1]) + values[i : i + 32] for i in range(0, len(values), 32))
    path = tmp_path / "c.pcd"
    head = "VERSION 0.7\nFIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nCOUNT 1 1 1\nWIDTH 2\nHEIGHT 1\nPOINTS 2\nDATA binary_compressed\n"
    path.write_bytes(head.encode() + np.array([len(packed), len(values)], "<u4").tobytes() + packed)
    rows = pf.read_pcd(spark, str(path), "millimeter", "f").df.orderBy("idx").collect()
    assert [(r["x"], r["y"], r["z"]) for r in rows] == [(1.0, 3.0, 5.0), (2.0, 4.0, 6.0)]
    assert pf.lzf_decompress(bytes([2]) + b"abc" + bytes([0x20, 2]) + bytes([0xE0, 1, 5]), 16) == b"abcabcabcabcabca"


def test_attribute_ply(spark, tmp_path):
    path = str(tmp_path / "attributes.ply")
    s = from_points(spark, [(0, 0, 0), (1, 2, 3)])
    values = spark.createDataFrame([(0, 0.5, 0, -1), (1, -0.25, 3, 7)], "idx long, scalar double, reason int, region_id int")
    assert pf.write_attribute_ply(pf.attribute_table(s, values), path) == 2
    lines = open(path).read().split("\n")
    assert lines[2] == "element vertex 2" and lines[-3:] == ["0.000000 0.000000 0.000000 0.500000 0 -1", "1.000000 2.000000 3.000000 -0.250000 3 7", ""]
    with pytest.raises(InspectionError):
        pf.attribute_table(s, values.where("idx = 0"))


def test_config_round_trip_and_rules():
    config = S.config()
    assert parse_config(serialize_config(config)) == config
    assert validate_config(config).comparison.max_normal_angle_deg == S.CONFIG["comparison"]["max_normal_angle_deg"]
    text = json.loads(serialize_config(config))
    for section, name, value, reason in (
        ("preprocess", "voxel_size_mm", None, "is required"), ("preprocess", "normal_min_neighbors", 2, "must be at least 3"), ("comparison", "max_normal_angle_deg", 91, "must be in [0, 90]"),
        ("detection", "measurement_error_budget_mm", 0.3, "must exceed measurement error budget"), ("execution", "thread_count", 0, "must be at least 1"), ("registration_gate", "max_rotation_from_initial_deg", 0, "must be in (0, 180]"),
    ):
        changed = json.loads(json.dumps(text))
        changed[section][name] = value
        with pytest.raises(InspectionError) as error:
            validate_config(parse_config(json.dumps(changed)))
        assert error.value.context["reason"] == reason
    for broken in ("[]", "{", '{"schema_version": "2.0"}', json.dumps({**text, "registration": {"method": "other"}}), json.dumps({**text, "input": {"scan_unit": "inch"}}), json.dumps({**text, "execution": {"deterministic": 1}})):
        with pytest.raises(InspectionError):
            parse_config(broken)
    assert parse_config(json.dumps({**text, "more": 1})) == config


def test_report_and_manifest():
    assert serialize_result({"b": [NAN, 1.0], "a": float("inf")}) == '{"a": null, "b": [null, 1.0]}'
    assert sha256_hex("abc") == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert json.loads(build_manifest("1.0", "x", {"result.json": "00"}))["files"] == [{"path": "result.json", "sha256": "00"}]
    with pytest.raises(InspectionError):
        serialize_result({"a": object()})


def test_command_line(spark, tmp_path, capsys):
    config, ref, scan = tmp_path / "c.json", str(tmp_path / "r.ply"), str(tmp_path / "s.pcd")
    config.write_text(serialize_config(S.config()))
    pf.write_ply(S.surface(spark, *S.plane(), frame=S.FRAME), ref)
    pf.write_pcd(S.surface(spark, *S.plane(0.8)), scan)
    assert cli.main(["validate-config", str(config)]) == 0
    assert cli.main(["inspect", str(config), ref, scan, "--output", str(tmp_path)]) == 0
    assert "verdict: fail" in capsys.readouterr().out
    text = (tmp_path / "result.json").read_text()
    assert json.loads(text)["verdict"] == "fail"
    assert json.loads((tmp_path / "manifest.json").read_text())["files"][0]["sha256"] == sha256_hex(text)
    assert cli.main(["inspect", str(config), ref, str(tmp_path / "s.obj")]) == 2
    assert cli.main(["validate-config", str(tmp_path / "none.json")]) == 1
    assert cli.main(["unknown"]) == 2 and cli.main(["--version"]) == 0
    assert os.path.exists(tmp_path / "result.json")
