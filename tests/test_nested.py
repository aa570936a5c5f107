import json

from laudario.operators import nested as N

BATCH = {"Patients": [None, {"PatientKey": "p1", "Episodes": {"episode_key": "e1", "LaboratoryOccurrences": [{"OccurrenceId": "o1", "Observations": "[{\"ObservationId\": \"x\"}, null, {}]"}]}}, {"Episodes": []}]}


def rows(spark, *payloads):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "record_id bigint, payload string")
    return {tuple(r) for r in N.links(df).collect()}


def test_shapes(spark):
    assert rows(spark, json.dumps(BATCH)) == {
        (0, "patient", "root", "p1"), (0, "patient", "root", "#2"), (0, "episode", "p1", "e1"), (0, "occurrence", "e1", "o1"), (0, "observation", "o1", "x"), (0, "observation", "o1", "#2"),
    }


def test_wrappers_and_pages(spark):
    doc = {"data": {"payload": [{"pages": [{"pageNumber": 2, "lines": [{"id": "l", "cells": [{"text": "a"}]}], "words": [{"id": "l"}]}]}]}}
    assert rows(spark, json.dumps(doc)) == {(0, "page", "root", "2"), (0, "line", "2", "l"), (0, "cell", "l", "#0"), (0, "word", "2", "l")}


def test_damage_nulls_and_repeats(spark):
    whole = json.dumps(BATCH)
    assert rows(spark, None, "", whole[:-3], "[1, 2", "NaN", '{"patients": NaN}', "7", '"x"', "{}", '{"patients": null}') == set()
    df = spark.createDataFrame([(1, whole), (1, whole)], "record_id bigint, payload string")
    assert N.links(df).count() == 6
    assert N.links(df.limit(0)).count() == 0


def test_deep_and_long(spark):
    deep = "[" * 100_000 + "]" * 100_000
    assert rows(spark, deep) == set()
    for depth in (5_000, 200_000):
        wrapped = "[" * depth + '{"patients": [{"patientKey": "p", "x": ' + "[" * depth + "]" * depth + "}]}" + "]" * depth
        assert rows(spark, wrapped) == {(0, "patient", "root", "p")}
    many = {"patients": [{"patientKey": f"k{i}"} for i in range(30_000)]}
    assert len(rows(spark, json.dumps(many))) == 30_000


def test_deep_parser_agrees_with_the_usual_one():
    good = ['{"a": [1, -2.5e3, true, false, null, "x\\u00e9\\n", {}, []], "b": {"c": {"d": [[1]]}}}', " [ ] ", "7", '"x"', '{"a":1,"a":2}']
    for text in good:
        assert N.parse_deep(text) == json.loads(text)
    for text in ("", "[1,]", "[1 2]", '{"a"}', '{"a":1,}', "{1:2}", "[1]]", "nul", "[", '{"a":', "01", "NaN", "-", '"x'):
        for f in (N.parse_deep, N.parse):
            try:
                f(text)
            except ValueError:
                continue
            raise AssertionError(text)


def test_labels_lead_to_parents(spark):
    df = spark.createDataFrame([(1, json.dumps(BATCH), 9)], "record_id bigint, payload string, dewey int")
    nodes = N.label_nodes(df)
    patients = {r.dewey: r for r in N.flat_table(nodes, "patient").collect()}
    episodes = N.flat_table(nodes, "episode").collect()
    assert [patients[e.parent_dewey].own_id for e in episodes] == ["p1"]
    assert all(p.parent_dewey is None for p in patients.values())
    assert {json.loads(r.fields)["PatientKey"] for r in patients.values() if r.own_id} == {"p1"}


def test_arrays_of_all_names_become_tables(spark):
    page = {"pageNumber": 1, "words": [{"id": "w", "glyphIds": ["g1", "g2"]}], "Lines": [{"id": "l", "cells": [{"id": "c"}], "bounds": {"left": 1}}]}
    doc = {"pages": [page], "sources": [{"name": "a", "parts": [{"n": 1}, None, {"n": 2}]}]}
    nodes = N.label_nodes(spark.createDataFrame([(1, json.dumps(doc))], "record_id bigint, payload string"))
    every = {r.dewey: r for r in nodes.collect()}
    assert sorted((r.schema_path, r.ordinal) for r in every.values()) == [("pages", 0), ("pages.lines", 0), ("pages.lines.bounds", 0), ("pages.lines.cells", 0), ("pages.words", 0), ("sources", 0), ("sources.parts", 0), ("sources.parts", 2)]
    others = N.other_tables(nodes).collect()
    assert {r.schema_path for r in others} == {"pages.lines.bounds", "sources", "sources.parts"}
    for r in every.values():
        above = r.dewey.rpartition(".")[0]
        assert above == "" or every[above].schema_path == r.schema_path.rpartition(".")[0]
    assert json.loads(next(r.fields for r in every.values() if r.own_id == "w")) == {"id": "w", "glyphIds": ["g1", "g2"]}
    assert N.flat_table(N.label_nodes(spark.createDataFrame([], "record_id bigint, payload string")), "page").count() == 0
