"""Records of JSON documents read in byte ranges, against the json module."""

from __future__ import annotations

import json
import random

import pytest

from pairlake.sources import files as SRC
from pairlake.sources.json_pieces import read_records

NASTY = ['a', 'brace { in [ text', 'quote \\" "', 'back\\slash', '\\\\"', 'é漢\U0001f600', '', '"]},[{', 'tab\t', '\\' * 5, '/x.png']


def names(n, seed=0):
    rng = random.Random(seed)
    return [rng.choice(NASTY) + rng.choice(NASTY) + str(rng.randrange(n)) for _ in range(n)]


@pytest.mark.parametrize("piece", [1, 3, 17, 256, 1 << 20])
@pytest.mark.parametrize("indent,ascii_", [(None, True), (1, False)])
def test_captions_of_one_document(spark, tmp_path, piece, indent, ascii_):
    n = 12 if piece < 10 else 300
    rows = [{"id": x, "en": y, "more": {"en": "no", "l": [1, {"id": 2}]}} for x, y in zip(names(n), names(n, 1))]
    path = tmp_path / "c.json"
    path.write_text(json.dumps(rows, indent=indent, ensure_ascii=ascii_), encoding="utf-8")
    got = {r["id"]: r["caption"] for r in SRC.read_captions(spark, str(path), piece=piece).collect()}
    assert got == {r["id"]: r["en"] for r in rows}  # later duplicates win


@pytest.mark.parametrize("piece", [2, 31, 1 << 20])
def test_manifest_of_one_document(spark, tmp_path, piece):
    n = 10 if piece < 10 else 200
    labels = [[x, i] for i, x in enumerate(names(n, 2))]
    other = [["not", 1], ["these", 2]]
    path = tmp_path / "m.json"
    for doc in ({"labels": labels}, {"a": other, "labels": labels, "z": {"labels": other}, "y": [[["q"]]]},
                {"x": {"labels": [other]}, "labels": labels, "labels2": other}):
        path.write_text(json.dumps(doc, indent=piece % 3 or None))
        got = {r["fname"]: r["label"] for r in SRC.read_class_manifest(spark, f"file:{path}", piece=piece).collect()}
        assert got == dict(labels)
    path.write_text('{"a\\"labels": [["x", 1]], "labels" \n: ' + " " * 900 + '[["y", 2]], "b": "labels\\": [[", "c": [3]}')
    assert [tuple(r) for r in SRC.read_class_manifest(spark, str(path), piece=max(piece, 31)).select("fname", "label").collect()] == [("y", 2)]
    for doc in ('{"labels": null}', '{"labels": []}', "{}", '{"other": [["a", 1]]}', ""):
        path.write_text(doc)
        assert SRC.read_class_manifest(spark, str(path), piece=piece).collect() == []
    path.write_text('{"labels": [["v", [1.5, 2]], ["w", [3, 4]]]}')
    got = {r["fname"]: r["label"] for r in SRC.read_class_manifest(spark, str(path), vector_labels=True, piece=piece).collect()}
    assert got == {"v": [1.5, 2.0], "w": [3.0, 4.0]}


def test_records_come_from_several_tasks_in_order(spark, tmp_path):
    path = tmp_path / "c.json"
    rows = [{"id": i, "s": "x" * (i % 50)} for i in range(2000)]
    path.write_text(json.dumps(rows))
    df = read_records(spark, str(path), piece=4096)
    assert df.rdd.getNumPartitions() > 4
    assert [json.loads(r["record"]) for r in df.orderBy("offset").collect()] == rows
    path.write_text(json.dumps(rows)[:-5])
    with pytest.raises(ValueError, match="whole JSON"):
        read_records(spark, str(path), piece=4096)
    with pytest.raises(FileNotFoundError):
        read_records(spark, str(tmp_path / "none.json"))


def test_open_dataset_by_uri(spark, tmp_path):
    import zipfile

    from pairlake.sinks.blobs import png_bytes
    import numpy as np
    png = png_bytes(np.zeros((2, 2), np.uint8))
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.png").write_bytes(png)
    (tmp_path / "d/b.txt").write_text("x")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("m.png", png)
    for head in ("", "file:", "file://"):
        assert [r["path"] for r in SRC.open_dataset(spark, f"{head}{tmp_path}/d").collect()] == ["a.png"]
        assert [r["path"] for r in SRC.open_dataset(spark, f"{head}{tmp_path}/z.zip").collect()] == ["m.png"]
        with pytest.raises(FileNotFoundError):
            SRC.open_dataset(spark, f"{head}{tmp_path}/none")
    with pytest.raises(ValueError, match="neither"):
        SRC.open_dataset(spark, f"{tmp_path}/d/b.txt")
