"""Operators on small fixtures whose results are plain to see."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import scalars
from palimpsest.operators import diagnostics, diff, graph, layers, metrics, raster, references, search, temporal
from palimpsest.sources import publish, readers, script


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_replaced_folders_and_ranks(spark):
    files = spark.createDataFrame([("a/x.txt", "project", 0), ("a/x.txt", "game", 2), ("b/c/y.txt", "game", 2), ("b/z.txt", "mod", 1)], "rel_path string, source_name string, source_rank int")
    replaced = spark.createDataFrame([("project", 0, "b/c/"), ("mod", 1, "b")], "source_name string, source_rank int, prefix string")
    out = {(r.rel_path, r.source_name): (r.overridden, r.override_reason, r.override_by_source, r.override_rule) for r in layers.resolve_files(files, replaced).collect()}
    assert out["a/x.txt", "project"] == (False, None, None, None)
    assert out["a/x.txt", "game"] == (True, "same_relative_path", "project", "rel_path")
    assert out["b/c/y.txt", "game"] == (True, "descriptor_replace_path", "project", "b/c")
    assert out["b/z.txt", "mod"][0] is False


def test_definitions(spark):
    d = spark.createDataFrame([("a", 0), ("a", 1), ("b", 1), ("b", 1), ("b", 2), ("c", 5), ("on", 0), ("on", 3)], "name string, source_rank int")
    out = layers.resolve_definitions(d, ["name"], merged=F.col("name") == "on")
    assert {(r.name, r.source_rank, r.group_status, r.row_status, r.active_count) for r in out.collect()} == {
        ("a", 0, "source_priority", "active", 1), ("a", 1, "source_priority", "shadowed_by_source_priority", 1),
        ("b", 1, "ambiguous", "ambiguous_top_priority", 0), ("b", 2, "ambiguous", "shadowed_by_source_priority", 0),
        ("c", 5, "unique", "active", 1), ("on", 0, "merged", "merged", 2), ("on", 3, "merged", "merged", 2),
    }


def test_resource_ladder(spark):
    res = spark.createDataFrame([("gfx/icons/Sword.dds",), ("gfx/flags/a.dds",), ("sound/x/y.wav",)], "path string")
    asked = spark.createDataFrame([("gfx\\icons//sword.dds",), ("a.dds",), ("icons/sword.dds",), ("y",), ("sound/x",), ("nothing",)], "name string")
    assert {(r.name, r.step) for r in references.find_resources(asked, res).collect()} == {("gfx\\icons//sword.dds", "exact"), ("a.dds", "basename"), ("icons/sword.dds", "suffix"), ("y", "stem"), ("sound/x", "prefix"), ("nothing", "none")}


def test_dates_and_shapes(spark):
    t = spark.createDataFrame([("867.1.1",), ("1066.2.31",), ("12000",), ("x",), ("1.13.1",)], "t string")
    assert [r[0] for r in t.select(scalars.date_key(F.col("t"))).collect()] == [8670101, 10660231, 120000101, None, None]
    v = spark.createDataFrame([("yes",), ("12",), ("-0.5",), ("867.1.1",), ("{ }",), ("{ a = b }",), ("{ a b }",), ('"s"',), ("@c",), ("culture:x",), ("a/b",), ("word",), (" ",), (None,)], "t string")
    assert [r[0] for r in v.select(scalars.value_shape(F.col("t"))).collect()] == ["boolean", "integer", "decimal", "date", "empty_block", "block", "list", "string", "constant", "scoped", "path", "atom", "empty", "empty"]


def test_segment_distance(spark):
    p = spark.createDataFrame([(0.0, 1.0), (3.0, 0.0), (-1.0, 0.0)], "x double, y double")
    z, two = F.lit(0.0), F.lit(2.0)
    assert [round(r[0], 6) for r in p.select(scalars.segment_distance(F.col("x"), F.col("y"), z, z, two, z)).collect()] == [1.0, 1.0, 1.0]


def test_script_round_trip(spark):
    text = '# note\nevent = {\n  id = "a b" # in line\n  when >= 3\n  colour = rgb { 1 2 3 }\n  867.1.1 = { holder = character:9 }\n  list = { x y }\n}\nlone'
    top, errors = script.parse(text)
    assert not errors and [n.key for n in top] == ["event", None]
    assert [(c.key, c.op, c.value, c.kind) for c in top[0].children] == [("id", "=", "a b", "string"), ("when", ">=", "3", "atom"), ("colour", "=", "rgb", "block"), ("867.1.1", "=", None, "block"), ("list", "=", None, "block")]
    assert script.parse("a = {")[1] and script.parse("a = }")[1] and script.parse("}")[1]
    same = script.parse("event={id=\"a b\" when>=3 colour=rgb{1 2 3} 867.1.1={holder=character:9} list={x y}}")[0][0]
    assert script.canonical_hash(same) == script.canonical_hash(top[0])
    nodes = script.read_nodes(spark.createDataFrame([(1, text), (2, None), (3, "")], "file_id long, text string"))
    fields = script.object_fields(nodes)
    assert {(r.field, r.date_key) for r in fields.collect()} == {("id", 0), ("when", 0), ("colour", 0), ("list", 0), ("holder", 8670101)}
    kinds = spark.createDataFrame([("id", "event")], "key string, ref_kind string")
    assert {(r.ref_kind, r.ref_name) for r in script.references(nodes, kinds).collect()} == {("event", "a b"), ("character", "9")}
    typed = spark.createDataFrame([(1, "event")], "file_id long, object_type string")
    assert rows(script.objects(nodes, typed).select("object_type", "name", "line", "end_line")) == [("event", "event", 2, 8)]


def test_text_readers(spark):
    f = spark.createDataFrame([("localization/english/replace/a.yml", '﻿l_english:\n key.a:0 "Hello $key_b$ [x"\n # note\n key_b: "GetGlobalVariable(\'v\') it.Var(\'w\')"')], "rel_path string, text string")
    loc = readers.localization(f)
    assert rows(loc.select("language", "replaced", "line", "key")) == [("english", True, 2, "key.a"), ("english", True, 4, "key_b")]
    assert rows(readers.runtime_references(loc)) == [("key_b", "global_var", "v"), ("key_b", "variable", "w")]
    assert rows(readers.expand_keys(loc, 3)) == [("key.a", "key_b")]
    assert rows(readers.localization_problems(loc).select("line", "code")) == [(2, "unbalanced_brackets")]
    m = spark.createDataFrame([("sea_zones = LIST { 1 2 }\nlakes = LIST { 2 3 }\nrivers = RANGE { 4 9 }",)], "text string")
    assert rows(readers.blocked(m)) == [(1, "sea_zones"), (2, "lakes"), (3, "lakes")]
    log = spark.createDataFrame([("add_gold - gives gold\nSupported Scopes: character\n--------------------\nkill - ends\nSupported Targets: none, all\n",)], "text string")
    assert [(r.name, [tuple(x) for x in r.facts]) for r in readers.engine_log(log).orderBy("name").collect()] == [("add_gold", [("Supported Scopes", "character")]), ("kill", [("Supported Targets", "none, all")])]


def png(a: np.ndarray, filters: list[int]) -> bytes:
    """Encodes rows x columns x channels with the given filter for each row."""
    h, w, c = a.shape
    out, before = b"", np.zeros(w * c, np.int64)
    for y in range(h):
        line = a[y].ravel().astype(np.int64)
        left = np.r_[np.zeros(c, np.int64), line[:-c]]
        corner = np.r_[np.zeros(c, np.int64), before[:-c]]
        p = left + before - corner
        d = np.stack([abs(p - left), abs(p - before), abs(p - corner)])
        paeth = np.choose(np.argmin(d, 0), [left, before, corner])
        guess = [0, left, before, (left + before) // 2, paeth][filters[y]]
        out += bytes([filters[y]]) + ((line - guess) % 256).astype(np.uint8).tobytes()
        before = line
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("channels", [1, 3, 4])
def test_png(channels, spark):
    a = np.random.default_rng(1).integers(0, 256, (5, 7, channels), dtype=np.uint8)
    data = png(a, [0, 1, 2, 3, 4])
    assert (readers.decode_png(data) == a).all()
    if channels == 3:
        p = readers.pixels(spark.createDataFrame([(1, bytearray(data))], "k int, content binary"), "k").where("y = 2 and x = 3").first()
        assert p["value"] == (int(a[2, 3, 0]) << 16 | int(a[2, 3, 1]) << 8 | int(a[2, 3, 2]))


def test_tga():
    a = np.random.default_rng(2).integers(0, 256, (2, 3, 3), dtype=np.uint8)
    head = lambda kind: bytes([0, 0, kind]) + bytes(9) + struct.pack("<HHBB", 3, 2, 24, 32)
    assert (readers.decode_tga(head(2) + a.tobytes()) == a).all()
    packed = bytes([5]) + a.tobytes()
    assert (readers.decode_tga(head(10) + packed) == a).all()
    assert (readers.decode_tga(head(10) + bytes([133]) + b"abc") == np.frombuffer(b"abc" * 6, np.uint8).reshape(2, 3, 3)).all()


def test_scan_definitions_and_publication(spark, tmp_path):
    root = tmp_path / "mod"
    for p, t in (("common/a.txt", "x = 1"), ("localization/english/l.yml", "l:"), (".git/x.txt", ""), ("map_data/definition.csv", "0;0;0;0;x;x\n1;1;2;3;one;x\nbad;1;1;1;n;x\n")):
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)
    files = readers.scan(spark, str(root), "project", 0)
    assert rows(files.select("rel_path", "kind")) == [("common/a.txt", "script"), ("localization/english/l.yml", "localization"), ("map_data/definition.csv", "resource")]
    assert rows(readers.definitions(spark, str(root / "map_data/definition.csv"))) == [(1, 66051, "one")]
    store = publish.Store(spark, str(tmp_path / "store"))
    assert store.publish({"files": files.drop("content")}, 0) == 1
    assert store.read("files").count() == 3
    with pytest.raises(publish.Stale):
        store.publish({}, 0)
    (root / "common/a.txt").write_text("x = 2")
    (root / "common/b.txt").write_text("y = 2")
    now = readers.scan(spark, str(root), "project", 0)
    assert rows(publish.changed_files(store.read("files"), now)) == [("common/a.txt", "changed"), ("common/b.txt", "added")]
    store.mark_stale("edited")
    assert store.state()["status"] == "stale"


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (7, 8)], "u long, v long")
    assert rows(graph.strong_components(e)) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6)]
    assert rows(graph.components(e)) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (7, 7), (8, 7)]
    w = spark.createDataFrame([(1, 2, 1.0, 5.0), (2, 4, 1.0, 5.0), (1, 3, 1.1, 0.9), (3, 4, 1.1, 0.9)], "u long, v long, w double, scenic double")
    assert [r.node for r in graph.route(w, 1, 4, 10).collect()] == [1, 2, 4]
    kind, path = graph.scenic_or_shortest(w, 1, 4, 10)
    assert kind == "scenic" and [r.node for r in path.collect()] == [1, 3, 4]
    assert graph.scenic_or_shortest(w, 1, 4, 10, 1.05)[0] == "shortest"
    chain = graph.call_chain(e, spark.createDataFrame([(1,)], "node long"), 3)
    assert {(r.node, r.hops) for r in chain.collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}
    par = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "node long, parent long")
    assert graph.ancestors(par, 9).count() == 9


def test_components_against_union_find(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 420)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert rows(graph.components(spark.createDataFrame(pairs, "u long, v long"))) == sorted((x, find(x)) for x in root)


def test_colours_are_proper(spark):
    rng = random.Random(3)
    e = [(rng.randrange(30), rng.randrange(30)) for _ in range(90)]
    c = dict(rows(graph.colours(spark.createDataFrame(e, "u long, v long"), 64)))
    assert all(c[a] != c[b] for a, b in e if a != b)


def test_merging(spark):
    b = ["a", "b", "c", "d", "e"]
    assert diff.merge_lines(b, ["x", *b], [*b, "y"]) == (["x", *b, "y"], True)
    assert diff.merge_lines(b, b, ["q"]) == (["q"], True)
    assert diff.merge_lines(b, ["a", "B", "c", "d", "e"], ["a", "b", "c", "D", "e"]) == (["a", "B", "c", "D", "e"], True)
    assert diff.merge_lines(b, ["a", "1", "c"], ["a", "2", "c"])[1] is False
    t = [spark.createDataFrame(x, "k int, v string") for x in ([(1, "a"), (2, "a"), (3, "a"), (5, "a")], [(1, "b"), (2, "a"), (4, "p"), (5, "b")], [(1, "c"), (2, "c"), (3, "z"), (4, "q"), (5, "a")])]
    out = {r.k: (r.outcome, r.merged) for r in diff.three_way(*t, ["k"], "v").collect()}
    assert out == {1: ("conflict", None), 2: ("target", "c"), 3: ("delete_modify_conflict", None), 4: ("add_conflict", None), 5: ("project", "b")}
    s = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("c", "4")], "k string, v string")
    o = spark.createDataFrame([("a", "1"), ("b", "9"), ("c", "3"), ("d", "0")], "k string, v string")
    assert {r.k: r.status for r in diff.field_diff(s, o, ["k"], "v").collect()} == {"a": "same", "b": "changed", "c": "ambiguous", "d": "removed"}


def test_grids(spark):
    labels = [[1, 1, 2], [1, 2, 2], [0, 3, 3]]
    p = spark.createDataFrame([(y, x, v) for y, r in enumerate(labels) for x, v in enumerate(r)], "y long, x long, label long")
    runs = raster.runs(p)
    assert sorted(tuple(r) for r in raster.pixels_of(runs).select("y", "x", "label").collect()) == rows(p)
    packed = raster.pack_runs([(0, 1, 2), (3, 4, 5)])
    assert list(raster.unpack_runs(packed)) == [(0, 1, 2), (3, 4, 5)] and len(packed) == 24
    assert rows(raster.adjacency(p)) == [(1, 2, 3), (2, 3, 2)]
    assert {r.label: (r.area, r.perimeter) for r in raster.shapes(p).collect()} == {1: (3, 8), 2: (3, 8), 3: (2, 6)}
    owner = raster.grow([(0, x) for x in range(5)] + [(9, 9)], [(0, 0), (0, 4)], {(0, 3): 1.0}, 5.0)
    assert owner == {(0, 0): 0, (0, 1): 0, (0, 2): 0, (0, 3): 1, (0, 4): 1, (9, 9): 1}


def test_gradients_against_numpy(spark):
    a = np.random.default_rng(4).random((6, 5))
    h = spark.createDataFrame([(y, x, float(a[y, x])) for y in range(6) for x in range(5)], "y long, x long, h double")
    g = raster.gradients(h).where("y between 1 and 4 and x between 1 and 3").collect()
    for r in g:
        box = a[r.y - 1 : r.y + 2, r.x - 1 : r.x + 2]
        assert r.dx == pytest.approx((a[r.y, r.x + 1] - a[r.y, r.x - 1]) / 2)
        assert r.ruggedness == pytest.approx(box.max() - box.min())
        assert r.curvature == pytest.approx(a[r.y, r.x] - (box.sum() - a[r.y, r.x]) / 8)


def test_metrics_and_search(spark):
    r = spark.createDataFrame([("a", "x", 3), ("a", "y", 3), ("b", "x", 1), ("b", "", 9)], "k string, v string, w int")
    assert rows(metrics.mode(r, ["k"], "v").select("k", "v")) == [("a", "x"), ("b", "x")]
    assert {x.k: x.diversity for x in metrics.diversity(r, ["k"], "v").collect()} == {"a": pytest.approx(1.0), "b": 0.0}
    share = spark.createDataFrame([("a", 0.5), ("a", 0.5), ("a", 0.0)], "k string, s double")
    assert metrics.effective_categories(share, ["k"], "s", 4).first()["effective"] == pytest.approx(2)
    assert [search.quota(n) for n in (1, 4, 8, 20)] == [1, 1, 2, 4]
    hidden = layers.public_only(spark.createDataFrame([("A",), ("b",), (None,)], "source_name string"), spark.createDataFrame([("a", True)], "name string, private boolean"))
    assert hidden.count() == 2
    tl = spark.createDataFrame([("c", 1, "set", 5.0), ("c", 2, "add", 1.0), ("c", 3, "set", 7.0), ("c", 4, "add", 2.0), ("d", 1, "add", 4.0)], "k string, at int, how string, v double")
    assert rows(temporal.timeline_total(tl, ["k"], ["at"], F.col("how") == "set", F.col("v")).select("k", "total")) == [("c", 9.0), ("d", 4.0)]


def test_diagnostics(spark):
    d = spark.createDataFrame([(1, "w", "missing_resource", "p", 1, "no 'A'", "high", 2), (2, "w", "missing_resource", "q", 9, "none 'a'", "high", None), (3, "error", "scope_x", "p", 1, "m", "high", 1)], "seq int, severity string, code string, path string, line int, message string, confidence string, occurrences int")
    assert {(r.code, r.path, r.occurrences, r["rank"]) for r in diagnostics.aggregate(d).collect()} == {("missing_resource", "p", 3, 2), ("scope_x", "p", 1, 0)}


@pytest.mark.parametrize("f", [lambda s: graph.components(s), lambda s: graph.strong_components(s), lambda s: graph.degrees(s)])
def test_empty_graphs(f, spark):
    assert f(spark.createDataFrame([], "u long, v long")).count() == 0


def test_strong_components_of_many_rounds(spark):
    """Each round peels the least of 52 cycles, all of which lead to all later ones."""
    pairs = [(2 * i, 2 * i + 1) for i in range(52)]
    e = [x for u, v in pairs for x in ((u, v), (v, u))] + [(2 * i, 2 * j) for i in range(52) for j in range(i + 1, 52)]
    got = rows(graph.strong_components(spark.createDataFrame(e, "u long, v long")))
    assert got == [(v, v // 2 * 2) for v in range(104)]
