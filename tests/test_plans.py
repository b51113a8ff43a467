import duckdb
import pytest
from pyspark.sql import functions as F

from glyphsieve import plans
from glyphsieve.operators import ngrams, reports
from tests.conftest import SF, same


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    assert same(plans.QUERIES[name](spark, SF), duck.execute(plans.ORACLE_SQL[name]))


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_query_without_sql_gives_a_row_per_document(spark, name):
    assert plans.QUERIES[name](spark, SF).count() == 200


def test_entry_points_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(plans.QUERIES) <= set(e.queries())


def test_report_values_round_the_double_itself(spark):
    values = [0.16135, 0.16125, 0.03125, 0.09375, -0.00005, 9.99995, 12.25, 12.35, -10.0, None]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    got = [r["x"] for r in df.select("k", reports.markdown_value(df, "v").alias("x")).orderBy("k").collect()]
    assert got == ["—" if v is None else f"{v:.4f}" if abs(v) < 10 else f"{v:.1f}" for v in values]


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_report_lines_equal_sql_at_larger_sizes(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf{sf}/documents.parquet')")
    assert same(plans.QUERIES["report_lines"](spark, f"/root/testdata/sf{sf}"), con.execute(plans.ORACLE_SQL["report_lines"]))


@pytest.fixture(scope="module")
def one_address(tmp_path_factory):
    """Tables in which pages have an address together or none: marks of all five kinds meet on one."""
    folder = tmp_path_factory.mktemp("pages")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    con.execute(f"CREATE VIEW pages AS SELECT * REPLACE (CASE WHEN page_id % 9 < 4 THEN 'http://a.example/' || (page_id % 9) WHEN page_id % 9 < 6 THEN url END AS url) FROM read_parquet('{SF}/pages.parquet')")
    for t in ("documents", "pages"):
        con.execute(f"COPY {t} TO '{folder}/{t}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["audit_by_kind", "audit_items", "audit_summary", "sarif_results"])
def test_pages_of_one_address_speak_for_each_other(spark, one_address, name):
    folder, con = one_address
    assert same(plans.QUERIES[name](spark, folder), con.execute(plans.ORACLE_SQL[name]))


def test_variants_count_words_once_a_scan(spark):
    """The count was inlined into each column that is made of it: 37 times over six scans."""
    plan = plans.QUERIES["variant_aggregate"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") + plan.count("regexp_count") == plan.count("Generate explode")


@pytest.mark.parametrize("context", [1, 2])
def test_scores_of_texts_deal_out_their_pairs_once(spark, context):
    texts = ["a b a b c", "", "a", "c a b c a b", "b a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string").withColumn("w", F.filter(F.split("t", " "), lambda x: x != ""))
    words = [t.split() for t in texts]
    held = [(k, " ".join(w[i - context : i]), w[i]) for k, w in enumerate(words) for i in range(context, len(w))]
    assert sorted(map(tuple, ngrams.pairs(docs, F.col("w"), context, ("id",)).collect())) == sorted(held)
    weights = {(c, t): len(c) + 0.25 for _, c, t in held if t != "c"}
    got = ngrams.sequence_scores(docs, spark.createDataFrame([(*k, v) for k, v in weights.items()], "ctx string, tok string, score double"), F.col("w"), "id", context)
    each = {k: [weights[c, t] for j, c, t in held if j == k and (c, t) in weights] for k in range(5)}
    assert {r["id"]: (r["hits"], r["total"]) for r in got.collect()} == {k: (len(v), sum(v) if v else None) for k, v in each.items()}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_tables_of_pairs_are_counted_once_a_corpus(spark):
    df = plans.QUERIES["ngram_top"](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ReusedExchange") >= 4, plan


def test_files_take_no_whole_texts_to_python(spark):
    plan = plans.QUERIES["file_items"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("substring(text") >= plan.count("Relation [") > 0
