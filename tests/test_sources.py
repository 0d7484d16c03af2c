"""Artefacts, pictures and snapshots."""

from __future__ import annotations

import struct
import zlib
from dataclasses import replace

import numpy as np
import pytest

from kindred.operators import images
from kindred.sources import files, profiles


def test_profile_has_the_known_identity():
    p = profiles.Profile()
    data = profiles.encode(p)
    assert len(data) == 320
    assert p.identity() == "91b545f801f5a0959475270996b190b5b395f98cb22a2d731eaa065a3c03d078"
    assert profiles.decode(data) == p


@pytest.mark.parametrize("change", [{"grid": 1}, {"lowe_num": 200}, {"thresholds": (0,) * 8}, {"weights": (-1,) * 7}, {"tables": profiles.Profile().tables[:3]}])
def test_profiles_out_of_range_are_refused(change):
    with pytest.raises(ValueError):
        profiles.encode(replace(profiles.Profile(), **change))


def test_damaged_profiles_are_refused():
    data = profiles.encode(profiles.Profile())
    for bad in (data[:-1], data + b"\0", b"XCAL" + data[4:], data[:4] + b"\x09\0" + data[6:], b""):
        with pytest.raises(ValueError):
            profiles.decode(bad)


def png(px: np.ndarray, kinds: list[int]) -> bytes:
    h, w, c = px.shape
    flat = px.reshape(h, w * c).astype(np.int64)
    lines = []
    for y, kind in enumerate(kinds):
        a = np.concatenate([np.zeros(c, np.int64), flat[y, :-c]])
        b = flat[y - 1] if y else np.zeros(w * c, np.int64)
        d = np.concatenate([np.zeros(c, np.int64), b[:-c]])
        p = a + b - d
        pa, pb, pc = abs(p - a), abs(p - b), abs(p - d)
        paeth = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, d))
        guess = [0, a, b, (a + b) // 2, paeth][kind]
        lines.append(bytes([kind]) + ((flat[y] - guess) & 255).astype(np.uint8).tobytes())
    chunk = lambda k, body: struct.pack(">I", len(body)) + k + body + struct.pack(">I", zlib.crc32(k + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6 if c == 4 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


@pytest.mark.parametrize("channels", [3, 4])
def test_png_with_every_filter(channels):
    px = np.random.default_rng(1).integers(0, 256, (10, 7, channels), np.uint8)
    w, h, raw = files.decode_picture(png(px, [0, 1, 2, 3, 4, 4, 3, 2, 1, 0]))
    got = np.frombuffer(raw, np.uint8).reshape(h, w, 4)
    assert (got[..., :channels] == px).all()


def test_pictures_of_a_folder(spark, tmp_path):
    (tmp_path / "a.rgba").write_bytes(struct.pack("<II", 2, 1) + bytes(range(8)))
    (tmp_path / "b.rgba").write_bytes(b"nothing like it")
    rows = {r.path[-6:]: r for r in files.read_pictures(spark, str(tmp_path)).collect()}
    assert (rows["a.rgba"].w, rows["a.rgba"].h, bytes(rows["a.rgba"].px)) == (2, 1, bytes(range(8)))
    assert rows["b.rgba"].px is None and rows["b.rgba"].reason


def test_snapshots_come_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "Copy", 4000), (2, "Related", None)], "pair long, verdict string, structural int")
    files.write_snapshot(df, f"{tmp_path}/s")
    assert sorted(map(tuple, files.read_snapshot(spark, f"{tmp_path}/s", df.schema).collect())) == [(1, "Copy", 4000), (2, "Related", None)]


def test_enlargement_is_undone_and_mirrors_have_the_same_runs():
    base = np.frombuffer(images.synthetic_image(3), np.uint8).reshape(72, 96, 4)
    big = base.repeat(3, 0).repeat(3, 1)
    assert images.upscale_factor(big) == 3 * images.upscale_factor(base)
    plain, large, mirrored = (images.records(x.shape[1], x.shape[0], np.ascontiguousarray(x).tobytes()) for x in (base, big, base[:, ::-1]))
    assert plain[2:] == large[2:]
    assert plain[7][:2] == mirrored[7][:2]  # rows and columns; diagonals turn over
    assert plain[5] == mirrored[5]


def test_matte_goes_and_a_plain_picture_has_none():
    px = np.full((20, 20, 4), 255, np.uint8)
    px[..., :3] = (40, 44, 60)
    px[5:15, 5:15, :3] = (200, 10, 10)
    out = images.fold_matte(px)
    assert (out[..., 3] == 0).sum() == 300 and (out[5:15, 5:15, 3] == 255).all()
    noise = np.random.default_rng(0).integers(0, 256, (20, 20, 4)).astype(np.uint8)
    noise[..., 3] = 255
    assert images.fold_matte(noise) is None


def test_bad_pictures_have_a_reason():
    assert images.records(2, 2, b"123")[0] == "damaged"
    assert images.records(None, 2, b"")[0] == "damaged"
    assert images.records(20000, 1, bytes(80000))[0] == "limit"


def test_frequencies_turn_with_the_block():
    block = np.random.default_rng(2).integers(0, 256, (16, 16))
    f, odd = images.frequencies(block), np.where(np.arange(16) % 2, -1, 1)
    assert (images.frequencies(block[:, ::-1]) == f * odd).all()
    assert (images.frequencies(block.T) == f.T).all()
    assert len(images.frequency_codes(block)) == 256 + 256 + 256


def test_codes_are_the_same_for_all_symmetries_and_the_inverse():
    cell = np.random.default_rng(3).permutation(64).reshape(8, 8)
    assert len({images.canonical_code(x) for x in [*images.symmetries(cell), *(63 - x for x in images.symmetries(cell))]}) == 1


def test_components():
    labels = np.array([[1, 1, 0, 2], [0, 1, 0, 2], [0, 0, 0, 2], [-1, 2, 2, 2]])
    assert images.components(labels).tolist() == [[0, 0, 1, 2], [1, 0, 1, 2], [1, 1, 1, 2], [-1, 2, 2, 2]]


def test_containers_come_back_and_damaged_ones_have_reasons(spark):
    from kindred.operators import keypoints
    from kindred.sources import containers

    pictures = images.synthetic_images(spark, 8)
    found = keypoints.image_keypoints(pictures).cache()
    made = containers.write_containers(found)
    want = {r.work_id: r.points for r in found.collect()}
    got = {r.work_id: r for r in containers.read_containers(made).collect()}
    assert any(want.values()) and all(got[k].points == p for k, p in want.items() if p is not None)
    assert {r.reason for k, r in got.items() if want[k] is None} == {"too short"}
    data = containers.write([{"desc": [1, -2, 3, -4], "x": 5, "y": 6, "level": 1, "sector": 63, "strength": 9}], 300)
    assert len(data) == 72 and containers.read(data)[1]["points"][0] == {"desc": [1, -2, 3, -4], "x": 5, "y": 6, "level": 1, "sector": 63, "strength": 9}
    for bad, reason in ((data[:40], "length and count differ"), (data[:-1] + b"x", "checksum"), (b"XXXX" + data[4:], "not a container"), (b"", "too short"), (None, "too short")):
        assert containers.read(bad) == (reason, None)
    old = spark.createDataFrame([(1, data[:4] + b"\x03" + data[5:])], "work_id long, container binary")
    assert containers.read_containers(old).first().reason == "version"


def test_principal_axes_are_those_of_the_whole(spark):
    from kindred.operators import screening

    x = np.random.default_rng(4).normal(size=(500, 6)) @ np.diag([5, 3, 2, 1, 0.5, 0.1])
    df = spark.createDataFrame([(r.tolist(),) for r in x] + [(None,), ([1.0],)], "v array<double>").repartition(4)
    mean, axes, shares = screening.principal_axes(df, "v", 6)
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    assert np.allclose(mean, x.mean(0)) and np.allclose(shares, values[::-1][:4] / values.sum())
    assert all(abs(abs(np.dot(a, v)) - 1) < 1e-6 for a, v in zip(axes, vectors.T[::-1], strict=False))
