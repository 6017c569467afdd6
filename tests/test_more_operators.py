"""Routes, terrain, rules, saves and image readers on small fixtures."""

import io
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import diff, layers, provinces, raster, routes, rules, search, terrain
from palimpsest.sources import publish, readers, saves, script


def test_route_graph_and_prices(spark):
    adj = spark.createDataFrame([(1, 2, True), (2, 1, False), (2, 3, False), (3, 4, True), (1, 1, False)], "u long, v long, blocked boolean")
    way = spark.createDataFrame([(1, 4, "sea_route"), (1, 3, "offmap_gateway"), (1, 3, "strait")], "u long, v long, kind string")
    prov = spark.createDataFrame([(1, 0.0, 0.0, False), (2, 3.0, 4.0, False), (3, 3.0, 0.0, True), (4, 9.0, 0.0, True)], "id long, x double, y double, water boolean")
    g = routes.route_graph(adj, way, prov)
    assert {(r.u, r.v, r.kind, r.blocked, r.w) for r in g.where("u < v").collect()} == {(1, 2, "land_boundary", False, 5.0), (2, 3, "water_boundary", False, 4.0), (3, 4, "water_boundary", True, 6.0), (1, 4, "sea_route", False, 9.0), (1, 3, "strait", False, 3.0)}
    take = lambda mode: {(r.u, r.v) for r in routes.priced(g, mode).where("u < v").collect()}
    assert take("land") == {(1, 2)} and take("sea") == {(3, 4)} and take("mixed") == {(1, 2), (1, 3), (2, 3), (3, 4)}
    assert {r.w for r in routes.priced(g, "mixed").where("u = 2 and v = 3").collect()} == {254.0}
    assert {r.w for r in routes.priced(g, "mixed").where("kind = 'strait'").collect()} == {253.0}
    assert {r.node for r in routes.reachable(g, spark.createDataFrame([(4,)], "node long")).collect()} == {1, 2, 3, 4}


def test_representatives(spark):
    d = spark.createDataFrame([(1, 5, 1), (2, 4, 9), (3, 3, 8)], "id int, a int, b int")
    assert routes.representatives(d, "id", [F.desc("a"), F.desc("b")], 3) == [1, 2, 3]


def test_flow_accumulation(spark):
    slope = np.add.outer(np.arange(5.0), np.zeros(4))
    assert terrain.flow_accumulation(slope).sum() >= 20
    bowl = np.array([[9, 9, 9, 9, 9], [9, 5, 5, 5, 9], [9, 5, 1, 5, 9], [9, 5, 5, 5, 9], [9, 9, 4, 9, 9]], float)
    assert terrain.flow_accumulation(bowl)[4, 2] >= 9
    h = spark.createDataFrame([(1, y, x, float(y)) for y in range(4) for x in range(3)] + [(2, 0, 0, 1.0)], "basin long, y long, x long, h double")
    out = terrain.accumulate_by_basin(h)
    assert out.count() == 13 and out.where("basin = 2").first()["flow"] == 1
    top = terrain.river_order(spark.createDataFrame([(i, i) for i in range(100)], "label int, flow int"))
    assert {r.label: r.river_class for r in top.where("label in (0, 60, 80, 95, 99)").collect()} == {0: 1, 60: 2, 80: 3, 95: 4, 99: 5}


def test_coasts_assets_and_warps(spark):
    e = spark.createDataFrame([(1, 2), (1, 3), (2, 1)], "u long, v long")
    s = spark.createDataFrame([(1, False, 0.0), (2, True, 5.0), (3, True, 9.0)], "id long, water boolean, depth double")
    assert [tuple(r) for r in terrain.coastal_drops(e, s).collect()] == [(1, 9.0)]
    d = spark.createDataFrame([(1, 10), (2, 20), (2, 30), (4, 10)], "id int, colour int")
    p = spark.createDataFrame([(10,), (40,), (0,)], "value int")
    assert {(r.code, r.subject) for r in terrain.asset_problems(d, p).collect()} == {("undefined_colour", "40"), ("missing_pixels", "2"), ("duplicate_id", "2"), ("duplicate_colour", "10")}
    t = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 0.0, 0.0, 10.0, 5.0, 5.0, 25.0, 5.0, 5.0, 25.0)], "id int, ax double, ay double, bx double, by double, cx double, cy double, ax2 double, ay2 double, bx2 double, by2 double, cx2 double, cy2 double")
    out = terrain.triangle_warp(spark.createDataFrame([(1, 1), (9, 9)], "x int, y int"), t)
    assert [tuple(r) for r in out.collect()] == [(1, 1, 7, 7)]
    half = [(2, 10.0, 0.0, 10.0, 30.0, 40.0, 0.0, 0.0, 0.0, 0.0, 30.0, 30.0, 0.0), (3, -20.0, -20.0, -20.0, -5.0, -5.0, -20.0, 0.0, 0.0, 0.0, 15.0, 15.0, 0.0)]
    mesh = t.union(spark.createDataFrame(half, t.schema))
    grid = spark.createDataFrame([(x, y) for x in range(-21, 42) for y in range(-21, 32)], "x int, y int")
    moved = {(r.from_x, r.from_y): (r.x, r.y) for r in terrain.triangle_warp(grid, mesh).collect()}
    wanted = {(x, y): (x - 10, y) for x in range(10, 41) for y in range(31) if x - 10 + y <= 30}
    wanted |= {(x, y): (x + 20, y + 20) for x in range(-20, -4) for y in range(-20, -4) if x + y <= -25}
    wanted |= {(x, y): (2 * x + 5, 2 * y + 5) for x in range(11) for y in range(11) if x + y <= 10}
    assert moved == wanted
    assert terrain.triangle_warp(grid, t.limit(0)).count() == 0
    b = spark.createDataFrame([(1, 0.5), (1, 0.1), (1, 0.9)], "label int, h double")
    assert terrain.surface_reference(b).first()["surface"] == pytest.approx(0.5, abs=0.003)


def test_term_counts(spark):
    docs = spark.createDataFrame([(1, "Été ete b"), (2, "b b"), (3, None), (4, ""), (5, "b B 数字 x_y")], "id int, text string")
    found = {tuple(r) for r in search.term_counts(docs, "text").collect()}
    assert found == {("ete", 1, 2), ("b", 3, 5), ("数字", 1, 1), ("x", 1, 1), ("y", 1, 1)}
    rows = search.inverted_index(docs, "id", "text").collect()
    assert found == {(w, sum(r.term == w for r in rows), sum(r.tf for r in rows if r.term == w)) for w in {r.term for r in rows}}


def test_rules(spark):
    text = "a.1 = {\n trigger = { add_gold = 5 every_child = { any_ally = { random_x = { } } } }\n immediate = { has_trait = x }\n else = { }\n}\nfx = { fx = yes if = { } else = { } }"
    nodes = script.read_nodes(spark.createDataFrame([(1, text)], "file_id long, text string"))
    words = lambda *xs: spark.createDataFrame([(x,) for x in xs], "key string")
    assert {(r.key, r.code) for r in rules.wrong_context(nodes, words("add_gold"), words("has_trait")).collect()} == {("add_gold", "effect_in_trigger"), ("has_trait", "trigger_in_effect")}
    assert {(r.key, r.code) for r in rules.lint(nodes).collect()} == {("else", "else_without_if"), ("random_x", "deep_iterators"), ("fx", "calls_itself"), ("a.1", "event_no_option")}
    scope = rules.scope_problems(nodes, {"every_child": (1, 1), "any_ally": (2, 2), "random_x": (2, 1)}, 1)
    assert [(r.key, r.scope) for r in scope.collect()] == [("any_ally", 1)]
    fields = spark.createDataFrame([("law", 1, "l1", "cost", "integer"), ("law", 1, "l2", "cost", "block")], "object_type string, file_id long, object string, field string, value_shape string")
    contracts = spark.createDataFrame([("law", "cost", True, ["integer"]), ("law", "name", True, ["string"])], "object_type string, field string, required boolean, shapes array<string>")
    assert {(r.object, r.field, r.code) for r in rules.field_contracts(fields, contracts).collect()} == {("l1", "name", "missing_field"), ("l2", "name", "missing_field"), ("l2", "cost", "wrong_shape")}
    types = spark.createDataFrame([("a", None), ("b", "a"), ("c", "d"), ("d", "c"), ("e", "gone")], "type string, base string")
    assert {(r.type, r.status) for r in rules.inherit(types).collect()} == {("a", "resolved"), ("b", "resolved"), ("c", "cycle"), ("d", "cycle"), ("e", "missing_base")}
    t = spark.createDataFrame([(1, "# add gold\nadd GOLD\n x = \"add\" gold"), (2, None)], "id long, text string")
    assert [(r.id, r.line) for r in rules.script_matches(t, "id", "add gold").orderBy("line").collect()] == [(1, 2), (1, 3)]


def test_interface_dialect():
    top, errors = script.parse('types Main {\n type button_x = button_standard {\n  block "content" { size = { 1 2 } }\n  icon { texture = "a.dds" }\n }\n}', gui=True)
    assert not errors
    x = top[0].children[0]
    assert (top[0].key, x.key, x.value, x.kind) == ("types Main", "type button_x", "button_standard", "block")
    assert [c.key for c in x.children] == ["block content", "icon"]


def save(zipped):
    state = 'living={ 7={ trait={ brave zealous } house=h1 } 8={ trait={ odd } } }\nlanded_titles={ k_x={ holder=7 } c_y={ holder=7 } }'
    if not zipped:
        return state.encode()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("gamestate", state)
    return b"SAV0102\nmeta={}\n" + out.getvalue()


@pytest.mark.parametrize("zipped", [False, True])
def test_saves(spark, zipped):
    data = save(zipped)
    assert saves.envelope(data)["format"] == ("zip" if zipped else "plain")
    rows = saves.inventory(spark.createDataFrame([("s", bytearray(data))], "save string, content binary"))
    known = spark.createDataFrame([("trait", "brave"), ("house", "h1"), ("x", "zealous")], "object_type string, name string")
    assert [tuple(r) for r in saves.audit(rows, known, {"trait": "trait", "house": "house"}).collect()] == [("s", "trait", "odd")]
    with pytest.raises(ValueError):
        saves.audit(rows, known.limit(0), {"trait": "trait"})
    who = spark.createDataFrame([("s", "7"), ("s", "9")], "save string, id string")
    out = {r.id: (r.fields, r.titles) for r in saves.dossier(rows, who).collect()}
    assert out == {"7": ({"house": "h1", "trait": "brave,zealous"}, ["c_y", "k_x"]), "9": (None, None)}


def test_token_maps_and_zip(spark):
    obs = spark.createDataFrame([(1,), (2,), (3,)], "token int")
    maps = spark.createDataFrame([("a", 0, 1), ("a", 0, 2), ("b", 1, 1), ("b", 1, 2), ("b", 1, 3), ("c", 2, 1), ("c", 2, 2), ("c", 2, 3)], "map string, seq int, token int")
    assert tuple(saves.token_map(obs, maps).first()) == ("b", 3, 3, True)
    assert saves.write_zip([("b", b"2"), ("a", b"1")]) == saves.write_zip([("a", b"1"), ("b", b"2")])


def test_dds():
    def dds(code, body, bits=0, masks=(0, 0, 0, 0)):
        h = bytearray(128)
        h[:4] = b"DDS "
        struct.pack_into("<2I", h, 12, 4, 4)
        h[84:88] = code
        struct.pack_into("<5I", h, 88, bits, *masks)
        return bytes(h) + body

    block = struct.pack("<2HI", 0xF800, 0x001F, 0b11_10_01_00)
    a = readers.decode_dds(dds(b"DXT1", block))
    assert a[0].tolist() == [[255, 0, 0, 255], [0, 0, 255, 255], [170, 0, 85, 255], [85, 0, 170, 255]]
    alpha = bytes([200, 100]) + (0b001_000).to_bytes(6, "little")
    assert readers.decode_dds(dds(b"DXT5", alpha + block))[0, :2, 3].tolist() == [200, 100]
    raw = np.arange(64, dtype=np.uint8).reshape(4, 4, 4)
    b = readers.decode_dds(dds(bytes(4), raw.tobytes(), 32, (0xFF0000, 0xFF00, 0xFF, 0xFF000000)))
    assert (b[..., 0] == raw[..., 2]).all() and (b[..., 3] == raw[..., 3]).all()


def test_provinces(spark):
    from palimpsest.operators import provinces

    p = spark.createDataFrame([(1, "c1", "city_holding", "plains", "x", "r", "yes", 4), (2, "c1", "castle_holding", "hills", "y", "r", "", 2), (3, "c2", "none", "desert", "x", "", "no", 1), (4, "c2", "none", "plains", "x", None, "", 1)], "id long, county string, holding string, terrain string, culture string, religion string, is_county_capital string, area int")
    value = lambda n: {r.entity: float(r.value) for r in provinces.recipe(p, n).collect()}
    assert value("settlement_terrain_gap") == {"c1": pytest.approx(0.75 - 0.45 * 8), "c2": pytest.approx(0 - 0.45)}
    assert {r.entity: r.value for r in provinces.recipe(p, "cultural_frontier").collect()} == {"c1": "x", "c2": "x"}
    e = spark.createDataFrame([("c1", "c2", 1.0), ("c2", "c1", 1.0)], "u string, v string, w double")
    moved = {r.entity: float(r.value) for r in provinces.recipe(p, "development_network", edges=e).collect()}
    assert moved["c1"] == pytest.approx(8.75) and 1.0 < moved["c2"] < 8.75
    edges = spark.createDataFrame([(1, 3, 5), (3, 1, 5), (2, 3, 3), (3, 2, 3), (2, 4, 1), (4, 2, 1)], "u long, v long, border int")
    known = p.withColumn("religion", F.when(F.col("id") == 1, "a").when(F.col("id") == 2, "b").otherwise(F.col("religion")))
    assert {(r.id, r.religion, r.weight) for r in provinces.faith_plan(known, edges).collect()} == {(3, "a", 10), (4, "b", 1)}
    at = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0), (3, 0.0, -2.0), (4, 9.0, 4.0)], "id long, x double, y double")
    assert {(r.id, r.hops, r.distance, r.direction) for r in provinces.neighbours(edges, at, 1, 2).collect()} == {(3, 1, 2.0, "north"), (2, 2, 5.0, "southeast")}
    site = spark.createDataFrame([(True, False, True, True, False, False, True, "city_holding", 0, 2, 0), (False, True, None, None, None, None, None, "ruin", None, None, 3)], "empty_slot boolean, has_special boolean, capital boolean, coastal boolean, inland_water boolean, pass_or_choke boolean, border boolean, holding string, water_hops int, same_culture_near int, special_near int")
    assert sorted(r.score for r in provinces.building_score(site).collect()) == [0, 50 + 30 + 12 + 10 + 8 + 4 + 4 + 4]
    assert {(r.county, r.provinces, r.main_culture) for r in provinces.title_context(p, "county").collect()} == {("c1", 2, "x"), ("c2", 2, "x")}


def test_boundaries_and_passages(spark):
    rows = [("impassable_mountain", "water", True), (None, "water", True), ("other", None, True), (None, None, False)]
    kinds = spark.createDataFrame(rows, "a string, b string, blocked boolean").select(provinces.adjacency_kind(F.col("a"), F.col("b"), F.col("blocked")), provinces.adjacency_water(F.col("a"), F.col("b"), F.lit("lake"), F.lit("")))
    assert [tuple(r) for r in kinds.collect()] == [("impassable_mountain_boundary", None), ("water_boundary", "lake"), ("other_blocked_boundary", None), ("land_border", None)]
    ways = [("sea", 80.0, False, False, False), ("sea", 81.0, False, False, False), ("land", 10.0, False, False, True), ("land", 10.0, True, True, True), ("land", 900.0, True, True, False), ("river_large", 900.0, False, False, False), ("x", 1.0, False, False, False)]
    found = spark.createDataFrame(ways, "k string, n double, f boolean, t boolean, u boolean").select(raster.passage_kind(F.col("k"), F.col("n"), 1000.0, F.col("f"), F.col("t"), F.col("u")))
    assert [r[0] for r in found.collect()] == ["strait", "sea_route", "underground_gateway", "underground_internal", "underground_gateway", "offmap_gateway", "explicit_passage"]


def test_merges_of_heavily_edited_texts():
    base = [f"line {i}" for i in range(6_000)]
    project = [x + " p" if i % 8 == 0 else x for i, x in enumerate(base)]
    target = [x + " t" if i % 8 == 4 else x for i, x in enumerate(base)]
    assert diff.merge_lines(base, project, target) == ([x + " p" if i % 8 == 0 else x + " t" if i % 8 == 4 else x for i, x in enumerate(base)], True)
    for side, want in (("project", ["1"]), ("target", ["2"]), (None, ["<<<<<<< project", "1", "=======", "2", ">>>>>>> target"])):
        assert diff.merge_lines(["a", "0", "b"], ["a", "1", "b"], ["a", "2", "b"], side) == (["a", *want, "b"], False)


def test_terms_of_queries(spark):
    assert search.asked_terms('"Rights, RÉSERVED" all "" 許可 all') == [["rights", "reserved"], ["all"], ["許可"]]
    d = spark.createDataFrame([(1, "許可 証 Über"), (2, "a b a b a"), (3, "")], "id long, text string")
    ids = lambda q: [r.id for r in search.bm25(d, "id", "text", q, 9).collect()]
    assert ids("許可") == [1] and ids("uber 証") == [1] and ids("?!") == [] and ids('"b a"') == [2] and ids('"a a"') == []


def test_two_writers_on_one_base(spark, tmp_path):
    store = publish.Store(spark, str(tmp_path / "s"))
    first, second = spark.range(3), spark.range(5)
    store.publish({"t": first}, 0)
    pinned = store.pin()
    late = publish.Store(spark, store.root, {"generation": 1, "status": "ready", "reason": None, "tables": ["t"], "folder": None})
    assert store.publish({"t": second}, 1) == 2
    with pytest.raises(publish.Stale):
        late.publish({"t": first}, 1)
    assert (pinned.read("t").count(), store.read("t").count()) == (3, 5)
    store.mark_stale("test")
    assert store.state()["status"] == "stale" and store.read("t").count() == 5


def test_losers_tie_by_name(spark):
    rows = [("p", "beta", True, n) for n in "xy"] + [("p", "alpha", True, n) for n in "xy"] + [("p", "gamma", True, n) for n in "xy"] + [("p", "win", False, "x")]
    got = layers.partial_overrides(spark.createDataFrame(rows, "rel_path string, source_name string, overridden boolean, name string")).first()
    assert (got.winner, got.loser, got.loser_count) == ("win", "alpha", 2)
