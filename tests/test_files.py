"""Readers of lines in splits, and the writer of Markdown files in two phases."""

import io
import os

import pytest
from loomtext.sources import files, subtitles
from pyspark.sql import functions as F


@pytest.mark.parametrize("split", [1, 2, 3, 7, 50, 10**6])
def test_lines_are_read_once_whatever_the_cuts(monkeypatch, split):
    monkeypatch.setattr(files, "READ", 4)
    for data in (b"", b"\n", b"a", b"a\n", b"\n\na\n", b"one\ntwo\n\nthree", b"long line without end " * 3 + b"\nx\n", b"\n\n\n"):
        want, at = [], 0
        for line in data.split(b"\n") if data else []:
            want.append((at, line))
            at += len(line) + 1
        got = []
        for a in range(0, len(data), split):
            for place, lines in files._lines(io.BytesIO(data), a, min(a + split, len(data))):
                for line in lines:
                    got.append((place, line))
                    place += len(line) + 1
        # the empty line behind a last line end begins where the file ends, in no split
        assert got == [w for w in want if w[0] < len(data)]


def test_subtitle_files_in_splits(spark, tmp_path):
    texts = {}
    for n in range(3):
        cues = "".join(f"00:{k // 60:02d}:{k % 60:02d}.000 --> 00:{k // 60:02d}:{k % 60:02d}.900\nLine {k} of {n} é\nand more\n\n" for k in range(200))
        texts[f"{n}.vtt"] = "﻿WEBVTT\nLanguage: en\n\nNOTE x\n\n" + (cues.replace("\n", "\r\n") if n == 1 else cues)
        (tmp_path / f"{n}.vtt").write_bytes(texts[f"{n}.vtt"].encode())
    (tmp_path / "other.txt").write_text("00:00:00.000 --> 00:00:01.000\nno\n")
    whole = subtitles.cues(spark.createDataFrame(list(texts.items()), "doc_id string, text string"))
    lines = files.read_lines(spark, str(tmp_path), split=1000)
    assert lines.rdd.getNumPartitions() > 20
    cut = subtitles.cues_of_lines(lines).withColumn("doc_id", F.element_at(F.split("doc_id", "/"), -1))
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole.collect())) and whole.count() == 600


def test_a_failed_job_leaves_no_file_and_a_rerun_no_second_one(spark, tmp_path):
    path = str(tmp_path / "out")
    docs = spark.createDataFrame([(f"Doc {k}/x", f"# {k}\n\nbody é") for k in range(40)], "title string, content string").repartition(4)
    with pytest.raises(Exception, match="(?s).*"):
        files.write_markdown(docs.withColumn("content", F.when(F.col("title") == "Doc 33/x", F.raise_error(F.lit("broken"))).otherwise(F.col("content"))), path)
    left = [f for _, _, names in os.walk(path) for f in names] if os.path.isdir(path) else []
    assert left == []
    for _ in range(2):
        files.write_markdown(docs, path)
        names = [f for _, _, names in os.walk(path) for f in names]
        assert sorted(names) == sorted(f"Doc {k}_x.md" for k in range(40))
    assert (tmp_path / "out" / "Doc 7_x.md").read_text(encoding="utf-8") == "# 7\n\nbody é"
    twice = docs.withColumn("title", F.when(F.col("title") == "Doc 1/x", "Doc 2/x").otherwise(F.col("title"))).withColumn("content", F.lit("new"))
    with pytest.raises(Exception, match="named"):
        files.write_markdown(twice, path)
    assert len([f for _, _, names in os.walk(path) for f in names]) == 40
    assert (tmp_path / "out" / "Doc 2_x.md").read_text(encoding="utf-8").startswith("# 2")
