"""Nested catalogue pages, indexed form, COPY text and JSON round trips."""
import datetime as dt

from pyspark.sql import functions as F

from conftest import rows
from quizmart.operators import nested
from quizmart.session import scratch_path
from quizmart.sources import io


def test_catalogue_pages_and_flatten(spark):
    courses = spark.createDataFrame([(1, "Mathe"), (2, "Leer")], "course_id int, course_name string")
    qs = spark.createDataFrame([(i, 1, f"Frage {i}") for i in range(1, 6)], "question_id long, course_id int, text string")
    ans = spark.createDataFrame([(10 * q + a, q, f"A{a}", a == 2) for q in range(1, 6) for a in range(4)],
                                "answer_id long, question_id long, text string, right_wrong boolean")
    pages = nested.nest_catalogue(courses, qs, ans, page_size=2)
    got = rows(pages.select("course_id", "question_count", "page", F.size("questions").alias("n")))
    assert got == [(1, 5, 0, 2), (1, 5, 1, 2), (1, 5, 2, 1), (2, 0, None, None)]
    flat = nested.flatten_catalogue(pages)
    assert flat.filter("course_id = 1").count() == 20
    assert rows(flat.filter("question_id = 3"), "a_pos", "answer_text", "right_wrong") == [
        (0, "A0", False), (1, "A1", False), (2, "A2", True), (3, "A3", False)]
    assert nested.catalogue_count_mismatch(pages).count() == 0
    texts, correct = nested.to_indexed_form(F.col("q.answers"))
    one = pages.filter("page = 0").select(F.explode("questions").alias("q")).select(
        texts.alias("t"), correct.alias("c"), F.col("q.answers").alias("orig"))
    r = one.select("t", "c", (nested.from_indexed_form(F.col("t"), F.col("c")) == F.col("orig")).alias("same")).collect()
    assert all(x["same"] for x in r) and r[0]["t"] == ["A0", "A1", "A2", "A3"] and r[0]["c"] == 2


def test_copy_text_roundtrip(spark):
    schema = "id long, txt string, ok boolean, ts timestamp_ntz, n double"
    data = [(1, "tab\there\nnew line \\ back\\slash", True, dt.datetime(2024, 1, 2, 3, 4, 5, 123456), 1.5),
            (2, "", False, None, None), (3, None, None, dt.datetime(2024, 1, 1), -2.0), (4, "\\N literal", True, None, 0.0)]
    df = spark.createDataFrame(data, schema)
    path = scratch_path(spark, "t-copy")
    io.write_copy_text(df, path)
    lines = sorted(r[0] for r in spark.read.text(path).collect())
    assert lines[0].startswith("1\ttab\\there\\nnew line \\\\ back\\\\slash\tt\t2024-01-02 03:04:05.123456")
    assert "3\t\\N\t\\N\t" in lines[2]
    back = io.read_copy_text(spark, path, df.schema)
    assert rows(back) == rows(df)


def test_json_roundtrip_and_parse(spark):
    df = spark.createDataFrame([(1, '{"k": 5}'), (2, "not json"), (3, None)], "id long, props string")
    assert rows(io.parse_json_column(df, "props", "k INT").select("id", "parsed.k")) == [(1, 5), (2, None), (3, None)]
    prim = spark.createDataFrame([(1, "p")], "id long, v string")
    fb = spark.createDataFrame([(1, "f"), (2, "f")], "id long, v string")
    assert rows(io.with_fallback(prim, fb, ["id"])) == [(1, "p"), (2, "f")]


def test_answer_pages_do_not_change_results(spark):
    courses = spark.createDataFrame([(1, "Mathe")], "course_id int, course_name string")
    qs = spark.createDataFrame([(i, 1, f"Frage {i}") for i in range(1, 4)], "question_id long, course_id int, text string")
    ans = spark.createDataFrame([(100 * q + a, q, f"A{a}", a == 6) for q in range(1, 4) for a in range(7)],
                                "answer_id long, question_id long, text string, right_wrong boolean")
    whole, cut = (nested.nest_catalogue(courses, qs, ans, page_size=p, answers_page_size=a) for p, a in ((50, 1000), (2, 3)))
    cols = ["question_id", "question_text", "a_pos", "answer_text", "right_wrong"]
    assert rows(nested.flatten_catalogue(whole).select(*cols)) == rows(nested.flatten_catalogue(cut).select(*cols))
    assert nested.catalogue_count_mismatch(cut).count() == 0


def test_pages_of_a_large_course_are_spread(spark):
    """The pages of one course do not meet in one task when they get its name and counts."""
    courses = spark.createDataFrame([(1, "Mathe"), (1, "Zweitname"), (2, "Leer"), (None, "Ohne")], "course_id int, course_name string")
    qs = spark.createDataFrame([(i, 1, "x" * 400) for i in range(200)] + [(200, None, "y"), (201, 3, "z")], "question_id long, course_id int, text string")
    ans = spark.createDataFrame([(q, q // 2, "A", True) for q in range(200)], "answer_id long, question_id long, text string, right_wrong boolean")
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8k")
        pages = nested.nest_catalogue(courses, qs, ans, page_size=2)
        approved = qs.filter("question_id < 7").groupBy("course_id").agg(F.count(F.lit(1)).alias("question_count"))
        declared = nested.with_declared_counts(pages, approved)
        for df, count in ((pages, 200), (declared, 7)):
            at = df.filter("course_name = 'Mathe'").groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
            assert len(at) > 3 and sum(r.n for r in at) == 100
            got = rows(df.groupBy("course_id", "course_name").agg(F.max("question_count").alias("c"), F.count("page").alias("n"), F.count(F.lit(1)).alias("all")))
            assert got == [(1, "Mathe", count, 100, 100), (1, "Zweitname", count, 100, 100), (2, "Leer", 0, 0, 1), (None, "Ohne", 0, 0, 1)]
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_copy_block_and_quarantine(spark):
    path = scratch_path(spark, "t-block")
    text = ["COPY public.t (id, txt, ok) FROM stdin;", "1\ta\\tb\ue000c\\\\\\n\tt", "x\tbad id\tf", "3\tshort", "4\t\\N\t\\N", "\\.", ""]
    spark.createDataFrame([(x,) for x in text], "value string").coalesce(1).write.text(path)
    schema = spark.createDataFrame([], "id long, txt string, ok boolean").schema
    assert rows(io.read_copy_text(spark, path, schema)) == [(1, "a\tb\ue000c\\\n", True), (4, None, None)]
    assert rows(io.read_copy_quarantine(spark, path, schema), "line", "reason") == [("3\tshort", "field_count"), ("x\tbad id\tf", "bad_value(id)")]


def test_layout_overwrite_and_skew(spark):
    path = scratch_path(spark, "t-layout")
    df = spark.range(4000).select(F.col("id"), (F.col("id") % 50 == 0).cast("int").alias("s"))
    io.write_layout(df, path, ["s"], ["id"])
    assert len([f for f in spark.read.parquet(path).filter("s = 0").inputFiles()]) > 3
    io.write_layout(df.filter("s = 0"), path, ["s"], ["id"])
    assert spark.read.parquet(path).filter("s = 1").count() == 0 and spark.read.parquet(path).count() == 3920


def test_table_profile_order(spark):
    a, b = scratch_path(spark, "small"), scratch_path(spark, "large")
    spark.range(10).write.parquet(a)
    spark.range(100_000).write.parquet(b)
    got = io.table_profile(spark, {"a": a, "b": b}).collect()
    assert [(r.table_name, r.row_count, r.size_rank) for r in got] == [("b", 100_000, 1), ("a", 10, 2)]
    assert got[0].data_bytes > got[1].data_bytes > 0 and got[0].table_size.endswith("kB")
