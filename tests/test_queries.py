"""Every query of the catalogue runs over its whole tables; those with SQL give the SQL's rows."""

import pytest

from promptlake.plans.catalogue import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, sf_dir, same_rows):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLE_SQL:
        same_rows(df, duck.execute(ORACLE_SQL[name]))
    else:
        assert df.count() >= 0
        assert len(set(df.columns)) == len(df.columns)


def test_entry_without_training_data_operators(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns


def test_findings_are_not_computed_inside_a_filter(spark, sf_dir):
    plan = QUERIES["mask_findings"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line[:80] for line in plan.splitlines() if "Filter" in line and "regexp" in line]


def test_words_that_are_no_terms_are_not_counted(spark, sf_dir):
    plan = QUERIES["dictionary_lookup"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Join")


def test_keywords_shuffle_no_words(spark, sf_dir):
    plan = QUERIES["top_keywords"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan
    assert not [line for line in plan.splitlines() if "hashpartitioning" in line and ", w#" in line]


def test_large_dictionaries_meet_by_a_shuffle(spark, monkeypatch):
    from promptlake.operators import rules

    docs = spark.createDataFrame([(1, "a b a b"), (2, None), (1, "b c")], "doc_id long, text string")
    terms = spark.createDataFrame([("k", "A b"), ("j", "a b"), ("k", "b")], "kind string, term string")
    wanted = [(1, "j", "a b", 2), (1, "k", "A b", 2), (1, "k", "b", 3)]
    for most in (1, 100):
        monkeypatch.setattr(rules, "BROADCAST_TERMS", most)
        df = rules.dictionary_lookup(docs, terms, "doc_id", "text")
        assert sorted(map(tuple, df.collect())) == wanted
        assert ("rightHint=(strategy=broadcast)" in df._jdf.queryExecution().optimizedPlan().toString()) == (most == 100)


def test_terms_of_any_number_of_words_are_found(spark, monkeypatch):
    from promptlake.operators import rules

    docs = spark.createDataFrame([(1, "so: One two, three-FOUR five one two three four"), (2, "four"), (3, None)], "doc_id long, text string")
    terms = spark.createDataFrame([("k", "one two three four"), ("k", "two three four five one two"), ("k", "Four"), ("k", "..."), ("k", None)], "kind string, term string")
    for most in (1, 100):
        monkeypatch.setattr(rules, "BROADCAST_TERMS", most)
        found = rules.dictionary_lookup(docs, terms, "doc_id", "text").select("doc_id", "term", "n").collect()
        assert sorted(map(tuple, found)) == [(1, "Four", 2), (1, "one two three four", 2), (1, "two three four five one two", 1), (2, "Four", 1)]
    assert rules.dictionary_lookup(docs, terms.where("false"), "doc_id", "text").count() == 0


def test_runs_that_the_end_cuts_short_are_not_counted_twice():
    from promptlake.operators import rules

    assert rules.term_runs("x a b", {"a b", "a b c"}, {"a": [2, 3]}) == ["a b"]


def test_runs_of_small_dictionaries_are_no_arrays_of_the_jvm(spark, sf_dir):
    plan = QUERIES["dictionary_lookup"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(" not in plan and plan.count("ArrowEvalPython") == 1


def test_dictionary_holds_countries_and_markets(spark, tmp_path):
    spark.createDataFrame([(1, "From nation 3 to machinery, nation_3; copyright"), (2, "nation 33")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("NATION_3",), ("NATION_4",)], "n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([("MACHINERY",)] * 3, "c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    found = QUERIES["dictionary_lookup"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == [(1, "MACHINERY", 1), (1, "NATION_3", 2), (1, "copyright", 1)]


def test_units_are_found_once(spark, sf_dir):
    plan = QUERIES["segment_documents"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_unit_runs") == 1 and plan.count("ArrowEvalPython") == 2


def test_tokens_are_not_arrays_of_the_jvm(spark, sf_dir):
    plan = QUERIES["token_counts"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan
