"""What is costly stands once in a query's plan: the optimizer neither copies it into a filter nor into the steps of a lambda."""

import pytest

from bookloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["paragraphs", "verse_blocks", "clean_text"])
def test_blocks_are_made_once(spark, name):
    """Marks of boilerplate are sought once, and lines sorted for the width, the page mode and the median only."""
    p = plan(spark, name)
    assert p.count("regexp_instr(") == 3 and p.count("sort_array(") == 3


def small(spark, name):
    """Bytes of a batch to Python workers, Spark's own number before, once the query is made."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, str(64 << 20))
    plan(spark, name)
    return spark.conf.get(key)


def test_title_tokens_goes_to_python_in_small_batches_and_without_ascii_texts(spark):
    assert small(spark, "title_tokens") in ("4m", f"{4 << 20}b") and "ArrowEvalPython [of(CASE WHEN NOT" in plan(spark, "title_tokens")


def test_paragraph_units_folds_each_unit_once(spark):
    assert small(spark, "paragraph_units") in ("4m", f"{4 << 20}b") and plan(spark, "paragraph_units").count("ArrowEvalPython") == 1


def test_epub_items_goes_to_python_in_small_batches_and_deals_digests(spark):
    """Of the Window's rows none holds a text."""
    assert small(spark, "epub_items") in ("4m", f"{4 << 20}b")
    p = plan(spark, "epub_items")
    assert p.index("Window") < p.index("md5(")


@pytest.mark.parametrize("name", ["corpus_quantiles", "quality_checks", "lcs_titles", "title_misses"])
def test_books_are_joined_from_their_documents_once(spark, name):
    """And chapters are sought once: no second branch, and no filter that seeks them anew."""
    p = plan(spark, name)
    assert (p.count("listagg("), p.count("exeunt")) == (1, 1)


def test_quantiles_leave_nulls_out(spark):
    from bookloom.operators import metrics

    rows = spark.createDataFrame([(x,) for x in (5, None, 1, None, 3, 3, None)], "v long")
    assert tuple(metrics.quantiles(rows, "v").first()) == (1, 3, 3, 5, 5, 5)
    assert tuple(metrics.quantiles(rows.where("v is null"), "v").first()) == (None,) * 6


def test_stripping_is_by_characters_and_of_the_same_ones(spark):
    """Every character of the first plane at both ends, against the pattern; and no pattern in the plan."""
    from pyspark.sql import functions as F

    from bookloom.functions import text as T

    rows = spark.range(1, 65536).where("id not between 55296 and 57343").select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    t = F.concat("c", F.lit(" "), "c", F.lit("a \u3000b"), "c", "c")
    rows = rows.select(T.strip(t).alias("a"), F.regexp_replace(t, rf"(?U)^{T.SPACE}+|{T.SPACE}+\z", "").alias("b"), T.rstrip(t).alias("c"), F.regexp_replace(t, rf"(?U){T.SPACE}+\z", "").alias("d"))
    assert rows.where("a <> b or c <> d or length(a) = 0").count() == 0 and rows.where("length(a) = 4").count() > 20
    assert "regexp" not in spark.range(1).select(T.strip(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()


def test_converted_reads_a_head_once(spark):
    """For the author: the first lines are split off once."""
    assert plan(spark, "converted").count(", 81)") == 1


def test_epub_build_cleans_once(spark):
    """As ``test_blocks_are_made_once``, with one more sort for repeated titles."""
    p = plan(spark, "epub_build")
    assert p.count("regexp_instr(") == 3 and p.count("sort_array(") == 4
