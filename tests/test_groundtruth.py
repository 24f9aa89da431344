"""Ground truth in trees and manifests; whole files in tasks."""

import os

from tallywright.operators.prompts import load_prompt
from tallywright.sources import files, groundtruth


def put(root, *parts, text="{}"):
    path = os.path.join(root, *parts)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    return path


def test_discovery_prefers_the_tree(spark, tmp_path):
    root, other = str(tmp_path / "tree"), str(tmp_path / "other")
    put(root, "e1", "x", "007", "cot.json", text='{"a": "tree"}')
    put(root, "e1", "x", "010", "video.mp4")
    put(root, "e0", "y", "1", "deep", "cot.json")  # too deep
    put(other, "a", "cot.json", text='{"a": "first"}')
    put(other, "b", "cot.json", text='{"a": "second"}')
    os.makedirs(os.path.join(other, "folder", "cot.json"))
    lines = [
        "engine,experiment,sample_id,original_path", f"e1,x,007,{other}/a", f"e1,x,010,{other}/none", f"e1,x,010,{other}/a/", f"e1,x,010,{other}/b",
        f"e0,z,002,file:{other}/b", f"e0,z,003,{other}/folder", "e0,z,004,", f"e0,z,005,{other}/gone",
    ]
    put(root, "manifest.csv", text="\n".join(lines) + "\n")
    found = groundtruth.discover(spark, root)
    rows = found.collect()
    assert [(r.engine, r.experiment, r.sample_id, r.from_manifest) for r in rows] == [("e0", "z", "002", True), ("e1", "x", "007", False), ("e1", "x", "010", True)]
    assert {r.sample_id: r.document for r in groundtruth.documents(found).collect()} == {"002": '{"a": "second"}', "007": '{"a": "tree"}', "010": '{"a": "first"}'}


def test_codes_are_whole_files(spark, tmp_path):
    put(str(tmp_path), "e", "x", "01", "simulation_code.py", text="a = 1\n\nprint(a)\n")
    put(str(tmp_path), "e", "x", "02", "simulation_code.py", text="")
    assert {tuple(r) for r in groundtruth.codes(spark, str(tmp_path)).collect()} >= {("e", "x", "01", "a = 1\n\nprint(a)\n")}


def test_files_are_written_whole_and_again(spark, tmp_path):
    places = [str(tmp_path / f"d{i % 3}" / f"f{i}") for i in range(20)]
    df = spark.createDataFrame([(p, f"text é {i}" * 50) for i, p in enumerate(places)], "path string, content string").repartition(4)
    assert files.write_files(df, "path", "content") == 20 == files.write_files(df, "path", "content")
    assert sorted(os.path.join(d, f) for d, _, names in os.walk(tmp_path) for f in names) == sorted(places)
    asked = spark.createDataFrame([(p,) for p in [*places, str(tmp_path / "none"), str(tmp_path), None, "file://" + places[0]]], "path string")
    read = {r.path: r.content for r in files.with_content(asked, "path").collect()}
    assert read[places[3]].decode() == "text é 3" * 50 and read[None] is None and read[str(tmp_path)] is None and read["file://" + places[0]] == read[places[0]]
    assert sum(r.exists for r in files.with_existence(asked, "path").collect()) == 21
    assert files.write_files(df.limit(0), "path", "content") == 0
