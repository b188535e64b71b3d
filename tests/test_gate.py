"""Which policy is in force, and what the layered engine answers."""

from pyspark.sql import functions as F

from promptlake.operators import conversations as conv
from promptlake.plans import decide, pipeline

HISTORY = "org_id string, document_id string, status string, at timestamp, version int"


def at(hour, day=1):
    from datetime import datetime

    return datetime(2024, 1, day, hour)


def test_just_one_active_document_is_in_force(spark):
    history = spark.createDataFrame(
        [
            ("a", "p1", "ACTIVE", at(2), 1),
            ("a", "p1", "ACTIVE", at(3), 2),  # again: no change
            ("a", "p2", "ACTIVE", at(6), 1),  # two from here
            ("a", "p1", "ARCHIVED", at(8), 3),  # one again, the other
            ("a", "p2", "ARCHIVED", at(1, 9), 2),  # none
            ("b", "p1", "ACTIVE", at(5), 1),
            ("b", "p1", "DRAFT", at(5), 2),  # of one time the last version counts
            ("c", "p3", "ACTIVE", None, 1),
            (None, "p4", "ACTIVE", at(0), 1),
        ],
        HISTORY,
    )
    asked = [
        (1, "a", at(1)), (2, "a", at(2)), (3, "a", at(5)), (4, "a", at(7)), (5, "a", at(8)), (6, "a", at(23, 8)), (7, "a", at(1, 9)),
        (8, "b", at(6)), (9, "c", at(6)), (10, None, at(6)), (11, "a", None), (12, "nobody", at(6)), (2, "a", at(2)),
    ]
    requests = spark.createDataFrame(asked, "conv_id bigint, org_id string, at timestamp")
    found = conv.policies_in_force(requests, history, "conv_id").collect()
    assert len(found) == len(asked)
    got = {r.conv_id: (r.n_active, r.document, r.in_force) for r in found}
    none = (0, None, False)
    assert got == {1: none, 2: (1, "p1", True), 3: (1, "p1", True), 4: (2, None, False), 5: (1, "p2", True), 6: (1, "p2", True), 7: none, 8: none, 9: none, 10: none, 11: none, 12: none}
    messages = spark.createDataFrame([(i, 0, "user", "hello there") for i in (2, 4, 12)], "conv_id bigint, turn bigint, role string, text string")
    routes = {r.conv_id: (r.route, r.health) for r in pipeline.route_conversations(messages, in_force=conv.policies_in_force(requests, history, "conv_id")).collect()}
    assert routes == {2: ("EXTERNAL_DIRECT", "HEALTHY"), 4: ("LOCAL", "FAILED"), 12: ("LOCAL", "FAILED")}
    assert conv.policies_in_force(requests, history.limit(0), "conv_id").where("in_force").count() == 0
    assert conv.policies_in_force(requests.limit(0), history, "conv_id").count() == 0


LAYERS = f"id int, layers array<{decide.LAYER}>, policy boolean"


def test_layers_gather_reasons_and_rules(spark):
    high = {"score": 0.8, "blocked": True, "reasons": ["r1", "r1", "r2"], "rules": [("A", "HIGH"), ("A", "CRITICAL"), ("B", "LOW")]}
    critical = {"score": 0.5, "blocked": True, "reasons": ["r2", "r3"], "rules": [("A", "CRITICAL"), ("C", "CRITICAL")]}
    quiet = {"score": 0.0, "blocked": False, "reasons": [], "rules": []}
    last = {"score": 1.0, "blocked": True, "reasons": ["r4"], "rules": [("D", "LOW")]}
    rows = [(1, [high, critical, last], True), (2, [high, quiet, last], True), (3, [quiet, quiet], True), (4, [high, None, last], True), (5, [critical, None], True), (6, [high], False), (7, [high], None), (8, [], True)]
    got = {r.id: r.o for r in spark.createDataFrame(rows, LAYERS).select("id", decide.layered(F.col("layers"), F.col("policy")).alias("o")).collect()}
    say = {i: (o.action, o.score, o.reasons, [r.code for r in o.rules], o.layers_run) for i, o in got.items()}
    assert say[1] == ("BLOCK", 0.8, ["r1", "r2", "r3"], ["A", "B", "C"], 2)
    assert got[1].rules[0].severity == "HIGH", "the first of a code counts"
    assert say[2] == ("BLOCK", 1.0, ["r1", "r2", "r4"], ["A", "B", "D"], 3)
    assert say[3] == ("ALLOW", 0.0, [], [], 2)
    assert say[4] == ("BLOCK", 1.0, [decide.FAILED_LAYER], [], 2)
    assert say[5] == ("BLOCK", 0.5, ["r2", "r3"], ["A", "C"], 1), "what fails after the end never ran"
    assert say[6] == say[7] == ("BLOCK", 1.0, [decide.NO_POLICY], [], 0)
    assert say[8] == ("ALLOW", 0.0, [], [], 0)
