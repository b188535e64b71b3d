"""Near copies go by SimHash first, and none of their tables is sent to the driver."""

from pyspark.sql import functions as F

from promptlake.llm import simhash, similar

BASE = [f"w{i}" for i in range(4000)]
TEXTS = [(1, " ".join(BASE)), (2, " ".join([*BASE, "end"])), (3, "other words that stand alone in here"), (4, ""), (5, None), (6, "  ")]


def _near(spark):
    return similar.near_copies(spark.createDataFrame(TEXTS, "doc_id bigint, text string"), as_column="g")


def test_simhash_links_are_candidates(spark, monkeypatch):
    seen = []

    def links(marks, *rest):
        seen.append({r.mark for r in marks.collect()})
        return real(marks, *rest)

    real = simhash.links
    monkeypatch.setattr(simhash, "links", links)
    group = {r.doc_id: r.g for r in _near(spark).collect()}
    docs = spark.createDataFrame(TEXTS[:3], "doc_id bigint, text string")
    assert seen == [{r[0] for r in docs.select(simhash.fingerprint(F.col("text"), 5)).collect()}]
    assert group[1] == group[2] and group[4] == group[5] == group[6]
    assert len(set(group.values())) == 3


def test_near_copies_are_not_broadcast(spark):
    plans = [_near(spark), similar._mixed(spark.createDataFrame([(1, "a", 3, "a")], "key long, digest string, size long, root string"))]
    plans += [simhash.near_duplicates(spark.createDataFrame(TEXTS, "doc_id bigint, text string"))]
    for df in plans:
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
