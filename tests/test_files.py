from pyspark.sql import functions as F

from scriptorium.operators import keywords
from scriptorium.sources import files


def test_load_and_labels(spark, tmp_path):
    (tmp_path / "posts").mkdir()
    (tmp_path / "posts" / "a.md").write_text("# T\n\nx")
    (tmp_path / "posts" / "b.txt").write_text("\n<!DOCTYPE html><p>y")
    got = {r.path.rsplit("/", 1)[1]: r.kind for r in files.load(spark, str(tmp_path / "posts")).collect()}
    assert got == {"a.md": "markdown", "b.txt": "html"}
    for label in ("native", "mt"):
        (tmp_path / "samples" / label).mkdir(parents=True)
        (tmp_path / "samples" / label / "one.txt").write_text("# title\nbody " + label)
    assert {(r.label, r.name, r.text) for r in files.labelled(spark, str(tmp_path / "samples")).collect()} == {("native", "one", "body native"), ("mt", "one", "body mt")}


def test_tracker_and_csv(spark, tmp_path):
    rows = [("2026-01-02", "s1", "a", "hi", "scored", "12.5", "x", "", "", "", "1", "100", "", "n"), ("2026-01-03", "s2", "b", "hi", "failed", *[""] * 9), ("", "", *[""] * 12)]
    spark.createDataFrame(rows, ", ".join(f"{c} string" for c in files.TRACKER)).coalesce(1).write.option("header", "true").csv(str(tmp_path / "t"))
    got = files.tracker(spark, str(tmp_path / "t")).collect()
    assert [r.source for r in got] == ["s2", "s1"] and got[1].ai_pct == 12.5 and got[1].fidelity is None
    files.write_csv(spark.createDataFrame([("kidney, stone", None)], "keyword string, volume string").coalesce(1), str(tmp_path / "k"), ["keyword", "volume"])
    text = next((tmp_path / "k").glob("part-*")).read_text()
    assert text.startswith("﻿keyword,volume\n") and '"kidney, stone"' in text


def test_report(spark):
    rows = [(1, "meta", "present", "fail", "high"), (1, "title", "length", "warn", "medium"), (2, "content", "readability", "warn", "medium"), (2, "x", "y", "pass", "low"), (3, "<b>", "z", "fail", "low")]
    df = spark.createDataFrame(rows, "id int, group string, check string, status string, impact string")
    assert [(r.id, r.check) for r in files.prioritise(df, "id").collect()] == [(1, "present"), (3, "z"), (1, "length"), (2, "readability")]
    page = files.report(df, "A & B", "id")
    assert "A &amp; B" in page and "&lt;b&gt;" in page and "readability" in page


def test_keywords(spark):
    df = spark.createDataFrame([("What are the signs of kidney stones?", False), ("The best", False), ("1) one two three four five six seven", False), ("मधुमेह के पहले लक्षण क्या हैं?", True), ("किसी को क्या", True)], "h string, i boolean")
    assert [r.t for r in df.select(keywords.topic(F.col("h"), F.col("i")).alias("t")).collect()] == ["signs of kidney stones", "", "three four five six seven", "मधुमेह के पहले लक्षण", ""]
    rows = spark.createDataFrame([(1, "kidney diet", [("h2", "Kidney Diet"), ("h3", "kidney ka ilaj"), ("p", "x")])], "id int, title string, blocks array<struct<type:string,text:string>>")
    found = keywords.seeds(rows, "id")
    assert [(r.pos, r.term, r.source) for r in found.orderBy("pos").collect()] == [(1, "kidney diet", "title"), (2, "kidney ka ilaj", "heading")]
    got = {r.keyword for r in keywords.expand(found, "id", "hinglish").collect()}
    assert "kidney diet ka ilaj" in got and "kidney ka ilaj ka ilaj" not in got and len(got) == 11
    volumes = spark.createDataFrame([("Kidney Diet", 90)], "keyword string, volume int")
    vs = {r.keyword: r.volume for r in keywords.with_volumes(keywords.expand(found, "id", "hinglish"), volumes).collect()}
    assert vs["kidney diet"] == 90 and sum(v is None for v in vs.values()) == 10
    hits = spark.createDataFrame([("Kidney",), ("kidney pain",), ("back pain",), ("back pain",), ("kidney diet plan",)], "suggestion string")
    assert [r.suggestion for r in keywords.rank_suggestions(hits, "kidney").collect()] == ["kidney pain", "kidney diet plan", "back pain"]
