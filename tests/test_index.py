"""A small project over a game, from files to answers."""

import pytest

from palimpsest.index import Index, Layer

FILES = {
    "game/events/old.txt": "old.1 = { trigger_event = old.2 title = old.1.t option = { } }\nold.2 = { option = { } }",
    "game/common/traits/t.txt": "brave = { cost = 5 icon = gfx/brave.dds }\nmeek = { cost = 1 }",
    "game/localization/english/a.yml": 'l_english:\n old.1.t:0 "The old title"\n brave:0 "Brave"\n',
    "game/gfx/brave.dds": "x",
    "mod/events/old.txt": "old.1 = { trigger_event = gone.9 title = old.1.t has_trait = brave option = { } }",
    "mod/common/traits/u.txt": "brave = { cost = 7 opposite = meek }\nbroken = {",
    "mod/localization/english/replace/b.yml": ' brave:1 "Bold"\n',
}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("layers")
    for p, t in FILES.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)
    kinds = {"trigger_event": "event", "title": "localization", "has_trait": "trait", "icon": "resource", "opposite": "trait"}
    sources = [Layer("mod", str(root / "mod"), 0, "project"), Layer("game", str(root / "game"), 5)]
    return Index.build(spark, sources, str(root / "store"), {"common/traits/": "trait", "events/": "event"}, kinds)


def test_what_holds(index):
    assert [(r.rel_path, r.source_name, r.override_by_source) for r in index.overrides().collect()] == [("events/old.txt", "game", "mod")]
    assert {(r.source_name, r.row_status) for r in index.definitions("trait:brave").collect()} == {("mod", "active"), ("game", "shadowed_by_source_priority")}
    assert {r.object_type: r.n for r in index.object_types().collect()} == {"trait": 4, "event": 1}
    assert [(r.value, r.source_name) for r in index.localized("brave").collect()] == [("Bold", "mod")]
    assert index.resource("brave").first()["step"] == "stem"


def test_references_and_diagnostics(index):
    states = {(r.from_name, r.ref_name): r.state for r in index._table("refs").collect()}
    assert states == {("old.1", "gone.9"): "unresolved", ("old.1", "old.1.t"): "resolved", ("old.1", "brave"): "resolved", ("brave", "gfx/brave.dds"): "resolved", ("brave", "meek"): "resolved"}
    assert {r.code for r in index.diagnostics().collect()} == {"missing_object_reference", "parse_error"}
    assert index.preflight("event:old.1").first()["verdict"] == "blocked"
    assert {(r.node, r.hops) for r in index.dependencies("old.1", 2).collect()} >= {("old.1", 0), ("gone.9", 1), ("brave", 1), ("meek", 2)}
    assert {r.node for r in index.call_chain("meek", 2, callers=True).collect()} == {"meek", "brave", "old.1"}


def test_search_patterns_and_compare(index):
    hits = [(r.kind, r.name, r.source_name) for r in index.search("brave", 9).orderBy("place").collect()]
    assert hits[0] == ("object", "brave", "mod") and {h[0] for h in hits[:5]} == {"object", "reference", "localization"}
    assert hits[5:] == [("resource", "gfx/brave.dds", "game")]
    assert [r.name for r in index.search("old title").collect()] == ["old.1.t"]
    assert {(r.field, r.value_shape, r.n) for r in index.patterns("trait").collect()} == {("cost", "integer", 3), ("icon", "path", 1), ("opposite", "atom", 1)}
    assert {r.field: r.status for r in index.compare("trait:brave", "mod", "game").collect()} == {"cost": "changed", "icon": "removed", "opposite": "added"}
    assert dict((r.what, r.n) for r in index.overview().collect())["overridden"] == 1


def test_patch(index, spark):
    objects = spark.createDataFrame([("common/traits/t.txt", "trait", "timid")], "rel_path string, object_type string, name string")
    refs = spark.createDataFrame([("common/traits/t.txt", "trait", "nobody")], "rel_path string, ref_kind string, ref_name string")
    assert {(r.ref_name, r.origin) for r in index.preflight_patch(objects, refs).collect()} == {("nobody", "patch"), ("meek", "others")}
