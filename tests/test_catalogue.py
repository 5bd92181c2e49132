"""The operators on hand-written tables with expectations derived by reading."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from catalith.catalog import Catalog, family_suffix
from catalith.operators import crossref, documents, favourites, legacy, navigation, search, trees, vehicle
from catalith.plans.applicability import Vehicle
from catalith.schemas import SCHEMAS


@pytest.fixture(scope="module")
def catalog(spark):
    def table(name, columns, rows):
        types = {f.name: f.dataType.simpleString() for f in SCHEMAS[name].fields}
        return spark.createDataFrame(rows, ", ".join(f"`{c}` {types[c]}" for c in columns.split())).cache()

    node = "path_id node_id parent_id sort name code variant_kind variant_value enabled"
    return Catalog(spark, tables={
        "document": table("document", "id code doc_type_id sort title published security enabled", [(1, "A1", 200, 2, "b", 202401, 0, 1), (2, "A2", 200, 1, "a", 20240131, 0, 1), (3, "A3", 200, 1, "c", None, 0, 0), (4, "A4", 200, 3, "d", None, 0, 1), (5, "A5", 200, 4, "e", None, 0, 1), (20, "T0", 200, 1, "x", None, 0, 1), (21, None, 200, 1, "y", None, 0, 1)]),
        "node_document": table("node_document", "node_id doc_id security doc_type_id", [(10, 1, 0, 200), (10, 1, 0, 200), (10, 2, 0, 200), (10, 3, 0, 200), (10, 4, 1, 200), (10, 5, 0, 200)]),
        "applicability": table("applicability", "doc_id series_id model_id engine_id body_id gearbox_id produced_from produced_to", [(1, 7, 70, 13001, 14001, 0, 199001, 199512), (2, 0, 0, 0, 14001, 0, None, None), (3, 7, 70, 13001, 14001, 0, None, None), (4, 7, 70, 13001, 14001, 0, None, None)]),
        "doc_type": table("doc_type", "id code name sort method access enabled", [(200, "RA", "repair", 2, 2, 101, 1), (1600, "ISB", "bulletins", 1, 5, 108, 1), (300, "X", "shared", 3, 6, 1, 0), (400, "Y", "none", 3, 6, 0, 1)]),
        "document_file": table("document_file", "doc_id file_name device_type device_code", [(1, "F1", None, None), (1, "F0", "d", "c")]),
        "document_ref": table("document_ref", "source_id target_id enabled", [(9, 1, 1), (9, 2, 1), (9, 2, 1), (9, 5, 0)]),
        "hotspot": table("hotspot", "source_id number target_id enabled", [(1, 1, 20, 1), (1, 1, 21, 1), (1, 1, 20, 1), (1, 2, 20, 1), (1, 3, 20, 0)]),
        "path_node": table("path_node", node, [(1, -1, 0, 1, "component", None, 0, 0, 1), (1, -2, 0, 2, "diagnosis", None, 0, 0, 1), (1, 1, -1, 1, "Engine", "11", 0, 0, 1), (1, 2, -1, 2, "Body", "41", 0, 0, 1), (1, 3, 1, 1, "Pump", None, 0, 0, 1), (1, 4, 3, 1, "Seal", None, 0, 0, 1), (1, 5, 1, 2, "Off", None, 0, 0, 0)]),
        "symptom_applicability": table("symptom_applicability", "path_id node_id series_id", [(1, 1, 7), (1, 4, 7), (2, 2, 7)]),
        "label": table("label", "key name", [(13001, "M50"), (14001, "saloon"), (14002, ""), (1, "b"), (1, "a")]),
        "vehicle_type": table("vehicle_type", "type_id series_id model_id engine_id body_id gearbox_id drive_id equipment", [(5, 7, 70, 13001, 14001, 22001, 1, None), (6, 7, 70, 13001, 14002, 22001, 1, None)]),
        "vehicle_model": table("vehicle_model", "series_id series_name model_id model_name body_id produced_from produced_to", [(7, "E36", 70, "320i", 14009, 199001, 199512), (7, "E36", 70, "320i saloon", 14001, 199101, 199902), (8, "E46", 80, "330", 1, None, None)]),
        "chassis_range": table("chassis_range", "area serial_from serial_to type_id produced", [(371, 1776965, 1776965, 6, 199506), (371, 1776960, 1776965, 5, 199505)]),
    })


def ids(df):
    return [r["id"] for r in df.collect()]


@pytest.mark.parametrize("car, expected", [(Vehicle(), [2, 1, 5]), (Vehicle(7), [2, 1]), (Vehicle(8), [2]), (Vehicle(7, bodies=(14002,)), [2]), (Vehicle(7, gearboxes=(22002,)), [2, 1]), (Vehicle(model=70), [2, 1, 5]), (Vehicle(7, 71), [2]), (Vehicle(7, bodies=(None, 14001)), [2, 1])])
def test_documents_by_node(catalog, car, expected):
    assert ids(documents.documents_by_node(catalog, 200, 10, car)) == expected


def test_other_listings(catalog):
    assert ids(documents.documents_by_node(catalog, 300, 10)) == []
    assert ids(documents.documents_by_type(catalog, 200, Vehicle(7))) == [2, 1, 4]
    assert ids(documents.document_by_code(catalog, " A1 ", Vehicle(8))) == []
    assert ids(documents.document_by_code(catalog, "A1", doc_type_id=200)) == [1]
    with pytest.raises(ValueError):
        documents.document_by_code(catalog, "A.1", doc_type_id=200)
    assert ids(documents.related_documents(catalog, 9)) == [2, 1]
    assert ids(documents.related_documents(catalog, 9, Vehicle(8))) == [2]
    one = documents.document(catalog, 1).first()
    assert [f["text_url"] for f in one["files"]] == ["/api/docs/F0.rtf", "/api/docs/F1.rtf"]
    assert documents.document(catalog, 2).first()["files"] == []
    assert [(r["id"], r["code_prefix"]) for r in documents.doc_types(catalog).collect()] == [(1600, "IB"), (200, ""), (400, "")]
    assert documents.doc_types(catalog, 300).count() == 1


def test_hotspots(catalog):
    assert [(r["number"], r["id"]) for r in crossref.hotspots(catalog, 1).collect()] == [(1, 20), (1, 21), (2, 20)]
    found = crossref.hotspot_map(crossref.hotspots(catalog, 1)).first()["hotspots"]
    assert {k: [t["id"] for t in v] for k, v in found.items()} == {1: [20, 21], 2: [20]}


def test_symptom_trees(catalog):
    assert ids(trees.symptom_roots(catalog)) == [-1, -2]
    assert [(r["id"], r["has_children"]) for r in trees.symptom_nodes(catalog, -1).collect()] == [(1, True), (2, False)]
    assert ids(trees.symptom_tree(catalog, -1)) == [1, 3, 4, 2]
    only = trees.symptom_tree(catalog, -1, Vehicle(7)).collect()
    assert [(r["id"], r["has_children"]) for r in only] == [(1, True)]
    found = trees.search_tree(trees.symptom_tree(catalog, -1), "seal").collect()
    assert {r["id"]: r["expanded"] for r in found} == {1: True, 3: True, 4: False}


def test_cycles_end(spark, catalog):
    extra = spark.createDataFrame([(1, 6, -1, 9, "a", None, 0, 0, 1), (1, 6, 6, 9, "a", None, 0, 0, 1)], catalog.table("path_node").schema)
    looped = Catalog(spark, tables={"path_node": catalog.table("path_node").union(extra)})
    assert sorted(ids(trees.symptom_tree(looped, -1))) == [1, 2, 3, 4, 6, 6]


def test_groups(catalog):
    assert ids(navigation.groups(catalog, 1600)) == []
    assert ids(navigation.groups(catalog, 300)) == [1, 2]
    assert ids(navigation.group_children(catalog, 300, 1)) == [3]
    for missing in (999, 400):
        with pytest.raises(navigation.NotFound):
            navigation.groups(catalog, missing)


def test_vehicles(catalog):
    assert ids(vehicle.series(catalog)) == [7, 8]
    assert [(r["name"], r["produced_to"]) for r in vehicle.models(catalog, 7).collect()] == [("320i", 199512), ("320i saloon", 199902)]
    assert [r["name"] for r in vehicle.engines(catalog, 70).collect()] == ["M50"]
    v = vehicle.variants(catalog, Vehicle(7, 70)).first()
    assert (v["body_ids"], v["body_names"], v["drive_names"], v["model_year"]) == ([14001, 14002], ["saloon"], ["a"], "1990-1999")
    with pytest.raises(ValueError):
        vehicle.variants(catalog, Vehicle())
    found = vehicle.lookup_vin(catalog, "wbaa a0000-0AB12345").first()
    assert (found["model_name"], found["body_name"], found["production_date"]) == ("320i saloon", "saloon", 199505)
    for bad in ("WBAAA00000AB1234", "WBAAA00000AB1234O", "WBAAA00000AB1234*", "WBAAA00000AB99999"):
        assert vehicle.lookup_vin(catalog, bad).count() == 0


VARIANTS = [(1, "11", 3000, 0), (2, "11", 3000, 7), (3, "11", 3000, 8), (4, "12", 3000, 0), (5, "12", 3000, 9), (6, "13", 0, 0), (7, "14", 9999, 3), (8, "15", 4000, 5)]


@pytest.mark.parametrize("car, kept", [(Vehicle(), [1, 2, 3, 4, 5, 6, 7, 8]), (Vehicle(engine=7), [2, 4, 6, 7, 8]), (Vehicle(bodies=(9,)), [1, 4, 6, 7])])
def test_variant_filter(spark, car, kept):
    rows = spark.createDataFrame(VARIANTS, "id long, code string, variant_kind int, variant_value long")
    assert ids(navigation.filter_variants(rows, car)) == kept


def plain_variants(rows, car):
    given = {3000: [car.engine] if car.engine else [], 4000: list(car.bodies), 5000: list(car.gearboxes)}
    if not any(given.values()):
        return {r[0] for r in rows}
    out = set()
    for r in rows:
        group = [x for x in rows if (x[1], x[2]) == (r[1], r[2])]
        hits = [x for x in group if x[3] > 0 and x[3] in given.get(r[2], [])]
        generic = [x for x in group if x[3] == 0]
        chosen = group if r[2] == 0 or r[2] not in given else (hits or generic) if given[r[2]] else (generic or group)
        if r in chosen:
            out.add(r[0])
    return out


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([None, "a", "b"]), st.sampled_from([0, 3000, 4000, 5000, 7]), st.integers(0, 3)), max_size=12), st.sampled_from([None, 1, 2]), st.lists(st.integers(1, 3), max_size=2), st.lists(st.integers(1, 3), max_size=2))
def test_variant_filter_like_a_loop(spark, parts, engine, bodies, gearboxes):
    rows = [(i, *p) for i, p in enumerate(parts)]
    car = Vehicle(engine=engine, bodies=tuple(bodies), gearboxes=tuple(gearboxes))
    df = spark.createDataFrame(rows, "id long, code string, variant_kind int, variant_value long")
    assert set(ids(navigation.filter_variants(df, car))) == plain_variants(rows, car)


def test_union_is_a_semi_join(catalog):
    """Fitting rows united with rows for all vehicles give what one semi join gives."""
    docs, fits, car = catalog.table("document"), catalog.table("applicability"), Vehicle(7, bodies=(14001,))
    one = docs.join(fits.where(car.fits()).withColumnRenamed("doc_id", "id").select("id"), "id").union(docs.join(fits.where("series_id = 0").withColumnRenamed("doc_id", "id").select("id"), "id")).distinct()
    from catalith.plans.applicability import applicable

    assert sorted(ids(one)) == sorted(ids(applicable(docs, fits, car)))


def test_search(spark):
    rows = spark.createDataFrame([(1, "100% Oil", "A"), (2, "oil", None), (3, None, "oil9")], "id long, title string, code string")
    assert ids(search.search_documents(rows, " OIL ")) == [1, 2, 3]
    assert ids(search.search_documents(rows, "0% o")) == [1]
    assert ids(search.search_documents(rows, "  ")) == [1, 2, 3]
    assert ids(search.first_result(rows)) == [1]
    groups = spark.createDataFrame([(1, "11", "Engine", "M50"), (2, None, "Engine", " ")], "id long, code string, name string, variant_name string")
    assert ids(search.search_groups(groups, "engine (m")) == [1]


def test_favourites(spark):
    car = {"kind": "vehicle", "series_id": 1, "model_id": 2, "engine_id": 3, "name": "mine"}
    rows = favourites.add(favourites.add(favourites.empty(spark), car), car)
    assert rows.count() == 1 and favourites.contains(rows, car)
    rows = favourites.rename(favourites.add(rows, {"kind": "document", "doc_id": 5, "name": "doc"}), car, "ours")
    again = favourites.load(spark, favourites.export(rows))
    assert sorted(map(str, again.collect())) == sorted(map(str, rows.collect()))
    assert favourites.remove(again, car).count() == 1
    for bad in ("[]", '{"vehicles": []}', '{"vehicles": [{}], "documents": []}'):
        with pytest.raises(ValueError):
            favourites.load(spark, bad)


def test_legacy(catalog):
    assert ids(legacy.default_type(catalog)) == [1600]
    assert legacy.applicability_check(catalog, 1, Vehicle(7), 199306).first()["rows"] == 1
    assert legacy.applicability_check(catalog, 1, Vehicle(7), 200001).first()["rows"] == 0
    assert legacy.reference_count(catalog, 9).first()["links"] == 3
    assert legacy.production_span(catalog, Vehicle(7)).first()["models"] == 2
    legacy.collect_applicable(catalog, Vehicle(8), "collected")
    assert ids(legacy.browse_collected(catalog, 200, "collected")) == [2]
    assert legacy.graphics_count(catalog, 10).first()["documents"] == 1
    assert ids(legacy.document_list(catalog, 200, max_security=0))[:2] == [2, 20]
    assert legacy.chassis_lookup(Catalog(catalog.spark, tables=catalog.tables), 371, 1776965).first()["type_id"] == 5


def test_catalog(spark, catalog, tmp_path):
    assert family_suffix(200) == "000200" and family_suffix(1234567) == "1234567"
    catalog.table("node_document").write.partitionBy("doc_type_id").parquet(str(tmp_path / "node_document"))
    stored = Catalog(spark, str(tmp_path))
    assert stored.resolve("THGR000200").count() == 6
    for absent in ("THGR000300", "THGR200", "thgr000200", "TZUKN000200", "X; DROP"):
        assert stored.resolve(absent) is None
    assert stored.register("c_") == ["node_document"] and spark.table("c_node_document").count() == 6
    assert stored.table("news").count() == 0 and stored.lookup("news", "id", 1).count() == 0
    plan = stored.partition("node_document", 200)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(doc_type_id" in plan


def test_links(spark, catalog):
    rows = spark.createDataFrame([(1, '<a href="x"></a><a href="y"></a>'), (2, "")], "id long, html string")
    assert [(r["id"], r["number"], r["link"]) for r in crossref.links(rows, "html", "id").collect()] == [(1, 1, "x"), (1, 2, "y")]
    texts = spark.createDataFrame([(1, r"\strike a\~b\strike0  x \strike c\line\strike d"), (2, "none"), (3, None)], "id long, text string")
    assert [(r["id"], r["number"], r["link"]) for r in crossref.text_links(texts, "text", "id").collect()] == [(1, 1, "a\xa0b"), (1, 2, "c"), (1, 3, "d")]
    blob = spark.createDataFrame([("N.RTF", "", "", b"\\strike one\\par\\strike two\\par\\strike three")], SCHEMAS["doc_blob"])
    found = crossref.resolved_links(Catalog(spark, tables={**catalog.tables, "doc_blob": blob}), 1, "n.rtf").collect()
    assert [(r["number"], r["link"], r["id"]) for r in found] == [(1, "one", 20), (1, "one", 21), (2, "two", 20), (3, "three", None)]
    html = documents.document_html(Catalog(spark, tables={"doc_blob": blob}), "n.rtf").first()["html"]
    assert html.count("data-hotspot") == 3 and documents.document_html(Catalog(spark, tables={"doc_blob": blob}), "absent.rtf").count() == 0


def test_deep_and_wide_trees(spark):
    """No number of levels or rows ends a walk."""
    chain = spark.range(1, 40).selectExpr("id as node_id", "id - 1 as parent_id", "'c' as code", "'n' as name", "cast(id as int) as sort")
    assert trees.descendants(chain, 0).count() == 39
    wide = spark.range(1, 1_200_000).selectExpr("id as node_id", "cast(0 as bigint) as parent_id")
    assert trees.descendants(wide, 0).count() == 1_199_999


def test_an_empty_family_table_is_there(spark, tmp_path):
    from catalith.sources import ingest as g

    (tmp_path / "in/Data").mkdir(parents=True)
    (tmp_path / "in/Data/THGR000200.csv").write_text("KNOTEN_ID,INFOOBJ_ID,SECURITY\n")
    g.ingest(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out")
    stored = Catalog(spark, f"file://{tmp_path}/out")
    assert stored.partition("node_document", 200).count() == 0 and stored.partition("node_document", 300) is None


def test_append_new_by_uri(spark, tmp_path):
    from catalith.sources import ingest as g

    rows = spark.createDataFrame([("A", "", "", b"x"), ("B", "", "", b"y")], "id string, path string, content_type string, data binary")
    for _ in range(2):
        g.append_new(rows, f"file://{tmp_path}/blobs")
    assert spark.read.parquet(f"file://{tmp_path}/blobs").count() == 2


def test_ranges_that_span_bins(spark):
    ranges = spark.createDataFrame([(1, 0, 60_000_000, 9, 1), (1, 4095, 4096, 3, 2), (2, 5, 4, 1, 1)], "area long, serial_from long, serial_to long, type_id long, produced int")
    asked = spark.createDataFrame([(k, 1, s) for k, s in enumerate((0, 4094, 4095, 4096, 4097, 60_000_000, 60_000_001))] + [(50, 2, 5)], "vin int, area long, serial long")
    assert {r["vin"]: r["type_id"] for r in vehicle.chassis_types(asked, ranges, ["vin"]).collect()} == {0: 9, 1: 9, 2: 3, 3: 3, 4: 9, 5: 9}
