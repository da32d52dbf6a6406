"""

Shape B (course → questions[] → answers[]{text, right_wrong} + explanation, question_count) is
built in *pages*: a course's questions are numbered with the skew-proof scan and grouped
``page_size`` at a time, so no document — and no task building one — grows with the largest
course. ``question_count`` is the course total on every page. Answers are nested per question the
same way: a question with more than ``answers_page_size`` answers is continued by further entries
whose ``answer_start`` says at which of its answers they begin, so counts and positions do not
depend on the page sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizmart.operators.scan import sequence_number
from quizmart.session import measured, small_batches

ANSWER = T.StructType([T.StructField("text", T.StringType()), T.StructField("right_wrong", T.BooleanType())])
QUESTION = T.StructType([T.StructField("question_id", T.LongType()), T.StructField("text", T.StringType()),
                         T.StructField("answers", T.ArrayType(ANSWER)),
                         T.StructField("explanation", T.StringType()),
                         T.StructField("answer_start", T.LongType())])
CATALOGUE_PAGE = T.StructType([T.StructField("course_id", T.IntegerType()),
                               T.StructField("course_name", T.StringType()),
                               T.StructField("question_count", T.LongType()),
                               T.StructField("page", T.LongType()),
                               T.StructField("questions", T.ArrayType(QUESTION))])
QUESTION_A = T.StructType([T.StructField("id", T.LongType()), T.StructField("question", T.StringType()),
                           T.StructField("answers", T.ArrayType(T.StringType())),
                           T.StructField("correct", T.IntegerType())])


def nest_in_pages(df: DataFrame, keys: list[str], order: list[str], item: Column, page_size: int,
                  items: str = "items") -> DataFrame:
    """Group ``item`` values per key into ordered arrays of at most ``page_size`` elements.

    Output: keys, ``page`` (0-based), ``items`` (array ordered by ``order``). Each group that
    ``collect_list`` sees is bounded by ``page_size``.
    """
    pos = sequence_number(df.select(*keys, *order, item.alias("__item")), keys, order, "__pos")
    pos = pos.withColumn("page", F.floor((F.col("__pos") - 1) / page_size).cast("bigint"))
    agg = pos.groupBy(*keys, "page").agg(
        F.array_sort(F.collect_list(F.struct(F.col("__pos"), F.col("__item")))).alias("__s"))
    return agg.select(*keys, "page", F.transform("__s", lambda s: s["__item"]).alias(items))


def nest_catalogue(courses: DataFrame, questions: DataFrame, answers: DataFrame, page_size: int = 50,
                   answers_page_size: int = 1000) -> DataFrame:
    """Relational courses/questions/answers → shape-B catalogue pages.

    Questions keep their answers in answer_id order; questions are ordered by question_id.
    A question with more than ``answers_page_size`` answers is continued in further entries
    (``answer_start`` > 0).

    The pages take their course's name and count from a table of courses that is broadcast if small, and
    stay where they were built: a shuffle by course would bring all pages of a course to one task. Courses
    without questions, which have no pages, are added to them.
    """
    small_batches(courses.sparkSession)  # texts go through the scan that numbers the questions
    a = nest_in_pages(answers, ["question_id"], ["answer_id"],
                      F.struct(F.col("text"), F.col("right_wrong")), answers_page_size, "answers")
    expl = F.col("explanation") if "explanation" in questions.columns else F.lit(None).cast("string")
    q = (questions.select("question_id", "course_id", "text", expl.alias("explanation"))
         .join(a.withColumnRenamed("page", "answer_page"), "question_id", "left"))
    qs = nest_in_pages(q, ["course_id"], ["question_id", "answer_page"],
                       F.struct(F.col("question_id").cast("bigint").alias("question_id"), F.col("text"),
                                F.coalesce(F.col("answers"), F.array().cast(T.ArrayType(ANSWER))).alias("answers"),
                                F.col("explanation"),
                                (F.coalesce(F.col("answer_page"), F.lit(0)) * answers_page_size).cast("bigint").alias("answer_start")),
                       page_size, "questions")
    counts = questions.groupBy("course_id").agg(F.count(F.lit(1)).alias("question_count"))
    c = measured(courses.select("course_id", "course_name").join(counts, "course_id", "left"), "catalogue-courses")
    paged = qs.withColumnRenamed("course_id", "__course_id").join(
        c.filter(F.col("question_count").isNotNull()), F.col("__course_id") == F.col("course_id")).drop("__course_id")
    empty = c.filter(F.col("question_count").isNull()).withColumns(
        {x: F.lit(None).cast(paged.schema[x].dataType) for x in ("page", "questions")})
    return paged.unionByName(empty).select(
        F.col("course_id").cast("int"), "course_name",
        F.coalesce("question_count", F.lit(0)).cast("bigint").alias("question_count"), "page", "questions")


def with_declared_counts(pages: DataFrame, counts: DataFrame) -> DataFrame:
    """``pages`` with the ``question_count`` of ``counts`` (course_id, question_count), 0 where it has none.
    The counts are a row per course, so that the pages need not be shuffled by course."""
    return (pages.drop("question_count").join(measured(counts, "catalogue-counts"), "course_id", "left")
            .withColumn("question_count", F.coalesce("question_count", F.lit(0)).cast("bigint")))


def flatten_catalogue(pages: DataFrame) -> DataFrame:
    """Catalogue documents → one row per answer with positions (questions without answers
    keep one row with NULL answer fields). Question positions count across a course's pages."""
    q = pages.select("course_id", "course_name", "page",
                     F.posexplode_outer("questions").alias("q_pos_in_page", "q"))
    a = q.select("course_id", "course_name", "page", "q_pos_in_page",
                 F.col("q.question_id").alias("question_id"), F.col("q.text").alias("question_text"),
                 F.col("q.explanation").alias("explanation"),
                 F.coalesce(F.col("q.answer_start"), F.lit(0)).alias("answer_start"),
                 F.posexplode_outer("q.answers").alias("__a", "a"))
    return a.select("course_id", "course_name", "page", "q_pos_in_page", "question_id", "question_text",
                    "explanation", (F.col("answer_start") + F.col("__a")).cast("int").alias("a_pos"), F.col("a.text").alias("answer_text"),
                    F.col("a.right_wrong").alias("right_wrong"))


def to_indexed_form(answers_col: Column, start: Column | int = 0) -> tuple[Column, Column]:
    """Shape-B answers → (array of texts, 0-based index of the first right answer or NULL).
    ``start``: number of the question's answers before this page of them."""
    texts = F.transform(answers_col, lambda a: a["text"])
    pos = F.array_position(F.transform(answers_col, lambda a: F.coalesce(a["right_wrong"], F.lit(False))),
                           F.lit(True))
    return texts, F.when(pos > 0, (pos - 1 + start).cast("int"))


def catalogue_from_shape_a(docs: DataFrame) -> DataFrame:
    """A3 shape A (id, question, answers as texts, index of the right one) → one row per answer in
    the form of :func:`flatten_catalogue`'s question and answer columns."""
    marked = docs.select(F.col("id").alias("question_id"), F.col("question").alias("question_text"),
                         F.posexplode_outer(from_indexed_form(F.col("answers"), F.col("correct"))).alias("a_pos", "a"))
    return marked.select("question_id", "question_text", "a_pos", F.col("a.text").alias("answer_text"),
                         F.col("a.right_wrong").alias("right_wrong"))


def from_indexed_form(answers_col: Column, correct: Column) -> Column:
    """I3 inverse: (texts, correct index) → shape-B answers with ``right_wrong = (i == correct)``."""
    return F.transform(answers_col, lambda a, i: F.struct(a.alias("text"),
                                                          F.coalesce(i == correct, F.lit(False)).alias("right_wrong")))


def catalogue_count_mismatch(pages: DataFrame) -> DataFrame:
    """Courses whose declared ``question_count`` differs from the questions present in their
    pages (continued entries of a question do not count again)."""
    s = pages.groupBy("course_id", "course_name").agg(
        F.max("question_count").alias("declared"),
        F.coalesce(F.sum(F.when(F.col("questions").isNull(), 0).otherwise(
            F.size(F.filter("questions", lambda q: F.coalesce(q["answer_start"], F.lit(0)) == 0)))), F.lit(0))
        .cast("bigint").alias("present"))
    return s.filter(F.col("declared") != F.col("present"))
