"""An index of layered content: built from source folders, published by generation, and asked by name.

    store = Index.build(spark, [Layer("project", "/mod", 0, "project"), Layer("game", "/game", 9)], "/shared/index")
    Index(spark, "/shared/index").search("example", 20).show()
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.scalars import typed_id
from .operators import diagnostics, diff, graph, layers, references, rules, search
from .shared import cut
from .sources import publish, readers, script


@dataclass
class Layer:
    """A source of files. A lower rank is a higher priority; rows of private layers are kept from public results."""

    name: str
    root: str
    rank: int
    role: str = "reference"
    private: bool = False
    replaces: list[str] = field(default_factory=list)


def _object_type(path: Column, types: dict[str, str]) -> Column:
    """The type of the longest prefix that a path starts with, else its second folder without a plural s."""
    out = F.regexp_replace(F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(2)), F.lit("object")), r"s?(\.[^.]*)?$", "")
    for prefix in sorted(types, key=len):
        out = F.when(path.startswith(prefix), types[prefix]).otherwise(out)
    return out


class Index:
    """Questions about the current generation of an index."""

    def __init__(self, spark: SparkSession, root: str, store: publish.Store | None = None) -> None:
        self.spark, self.store = spark, store or publish.Store(spark, root)

    @classmethod
    def build(cls, spark: SparkSession, sources: list[Layer], root: str, types: dict[str, str] | None = None, ref_kinds: dict[str, str] | None = None, facts: DataFrame | None = None) -> Index:
        """Scans all layers and publishes the next generation: layers, files, nodes, objects, fields, refs, localization, resources, schema and diagnostics."""
        store = publish.Store(spark, root)
        base = store.state()["generation"]
        scanned = None
        for s in sources:
            part = readers.scan(spark, s.root, s.name, s.rank)
            scanned = part if scanned is None else scanned.unionByName(part)
        replaced = [(s.name, s.rank, p) for s in sources for p in s.replaces]
        rule = spark.createDataFrame(replaced, "source_name string, source_rank int, prefix string") if replaced else None
        files = layers.resolve_files(scanned.drop("content"), rule).withColumn("file_id", F.xxhash64("source_name", "rel_path"))
        files = cut(files)
        active = files.where("not overridden").select("file_id", "source_name", "source_rank", "rel_path", "kind")
        texts = scanned.where("kind in ('script', 'localization', 'schema')").select(F.xxhash64("source_name", "rel_path").alias("file_id"), F.decode("content", "UTF-8").alias("text")).join(active, "file_id")
        nodes = cut(script.read_nodes(texts.where("kind = 'script'").select("file_id", "text")))
        typed = active.where("kind = 'script'").select("file_id", _object_type(F.col("rel_path"), types or {}).alias("object_type"))
        where = active.select("file_id", "source_name", "source_rank", "rel_path")
        objects = cut(script.objects(nodes, typed).join(where, "file_id"))
        kinds = spark.createDataFrame(sorted((ref_kinds or {}).items()) or [("", "")], "key string, ref_kind string")
        owned = layers.owner_of(script.references(nodes, kinds), objects.select("file_id", "line", "object_type", "name"), ["file_id"], "line", "line", "name", ["object_type", "name"])
        loc = readers.localization(texts.where("kind = 'localization'").withColumn("rel_path", F.concat_ws("\t", F.col("file_id").cast("string"), "rel_path")))
        loc = loc.withColumn("file_id", F.split_part("path", F.lit("\t"), F.lit(1)).cast("long")).drop("path").join(where, "file_id")
        loc = loc.withColumn("language", F.regexp_extract("rel_path", r"^localization/(?:replace/)?([^/]+)/", 1))
        resources = active.where("kind = 'resource'").select("file_id", "source_name", "source_rank", F.col("rel_path").alias("path"))
        known = facts if facts is not None else spark.createDataFrame([], "kind string, name string")
        refs = references.resolve(owned.join(where, "file_id"), objects, loc, resources, known)
        refs = cut(refs.withColumnRenamed("owner_object_type", "from_type").withColumnRenamed("owner_name", "from_name"))
        project = next((s.rank for s in sources if s.role == "project"), min(s.rank for s in sources))
        broken = nodes.where("value_kind = 'error'").join(where, "file_id").select(F.lit("error").alias("severity"), F.lit("parse_error").alias("code"), F.col("rel_path").alias("path"), F.col("start_line").alias("line"), F.col("error").alias("message"), F.lit("high").alias("confidence"))
        dangling = refs.where((F.col("state") == "unresolved") & (F.col("source_rank") == project))
        code = F.when(F.col("ref_kind") == "localization", "missing_localization").when(F.col("ref_kind") == "resource", "missing_resource").otherwise("missing_object_reference")
        dangling = dangling.select(F.lit("warning").alias("severity"), code.alias("code"), F.col("rel_path").alias("path"), "line", F.concat(F.col("ref_kind"), F.lit(" '"), "ref_name", F.lit("' is not defined")).alias("message"), F.lit("high").alias("confidence"))
        lint = rules.lint(nodes).join(where, "file_id").select(F.lit("warning").alias("severity"), "code", F.col("rel_path").alias("path"), F.col("start_line").alias("line"), F.concat(F.lit("'"), "key", F.lit("'")).alias("message"), F.lit("medium").alias("confidence"))
        problems = broken.unionByName(dangling).unionByName(lint).withColumn("occurrences", F.lit(1)).withColumn("seq", F.xxhash64("path", "line", "message"))
        table = spark.createDataFrame([(s.name, s.rank, s.role, s.private) for s in sources], "name string, rank int, role string, private boolean")
        schema = readers.schema_fields(texts.where("kind = 'schema'"))
        store.publish({"layers": table, "files": files, "nodes": nodes, "objects": objects, "fields": script.object_fields(nodes), "refs": refs, "localization": loc, "resources": resources, "schema": schema, "diagnostics": diagnostics.aggregate(problems)}, base)
        return cls(spark, root)

    def _table(self, name: str, public: bool = False) -> DataFrame:
        rows = self.store.read(name)
        return layers.public_only(rows, self.store.read("layers")) if public and "source_name" in rows.columns else rows

    def overview(self) -> DataFrame:
        """(what, n): the sizes of the generation's tables, and how many files are overridden and references dangle."""
        out = None
        for t in ("files", "objects", "refs", "localization", "resources", "diagnostics"):
            part = self._table(t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("what"), "n")
            out = part if out is None else out.union(part)
        out = out.union(self._table("files").where("overridden").agg(F.count(F.lit(1))).select(F.lit("overridden"), F.col("count(1)")))
        return out.union(self._table("refs").where("state = 'unresolved'").agg(F.count(F.lit(1))).select(F.lit("unresolved"), F.col("count(1)")))

    def object_types(self) -> DataFrame:
        return self._table("objects").groupBy("object_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "object_type")

    def definitions(self, key: str) -> DataFrame:
        """All definitions of `type:name` or a bare name, with which of them hold."""
        t, n = (self.spark.range(1).select(c).first()[0] for c in typed_id(F.lit(key)))
        rows = self._table("objects").where(F.col("name") == n)
        rows = rows.where(F.col("object_type") == t) if t else rows
        rows = rows.withColumn("domain", layers.definition_domain(F.col("object_type"), F.col("rel_path")))
        return layers.resolve_definitions(rows, ["object_type", "name", "domain"], merged=F.col("object_type") == "on_action")

    def references(self, key: str, direction: str = "in") -> DataFrame:
        """References to a name, or from an object."""
        n = key.split(":", 1)[-1]
        return self._table("refs").where((F.col("ref_name") if direction == "in" else F.col("from_name")) == n)

    def localized(self, key: str, language: str | None = None) -> DataFrame:
        rows = self._table("localization").where(F.col("key") == key)
        rows = rows.where(F.col("language") == language) if language else rows
        return layers.first_by(rows, ["key", "language"], [F.desc("replaced"), F.col("source_rank").asc(), F.desc("line")])

    def resource(self, name: str) -> DataFrame:
        return references.find_resources(self.spark.createDataFrame([(name,)], "name string"), self._table("resources"))

    def pinned(self) -> Index:
        """This index at the generation that is current now, so that one request sees one generation."""
        return Index(self.spark, self.store.root, self.store.pin())

    def search(self, query: str, limit: int = 20, public: bool = True) -> DataFrame:
        """Names that start with the query, in all tables of one generation; if there are none, localized values that contain it."""
        return self.pinned()._search(query, limit, public)

    def _search(self, query: str, limit: int, public: bool) -> DataFrame:
        project = self._table("layers").where("role = 'project'").select("name")
        own = [r[0] for r in project.collect()]
        cols = {"object": ("objects", "name", "rel_path"), "reference": ("refs", "ref_name", "rel_path"), "localization": ("localization", "key", "rel_path"), "resource": ("resources", "path", "path")}
        hits = None
        for i, (kind, (t, name, path)) in enumerate(cols.items()):
            part = search.prefix(self._table(t, public), name, query).select(F.lit(i).alias("branch"), F.lit(kind).alias("kind"), F.col(name).alias("name"), F.col(path).alias("path"), "source_name", "source_rank")
            hits = part if hits is None else hits.unionByName(part)
        hits = cut(search.rank_results(hits, query, F.col("source_name").isin(*own) if own else F.lit(False), limit, [F.col("branch").asc(), F.col("source_rank").asc(), F.col("name").asc(), F.col("path").asc()], ["kind", "name", "path"]))
        if not hits.isEmpty():
            return self._filled(hits.drop("branch"), query, limit, public)
        rows = search.contains(self._table("localization", public), "value", query)
        return rows.limit(limit).select(F.lit("text").alias("kind"), F.col("key").alias("name"), F.col("rel_path").alias("path"), "source_name", "source_rank", F.row_number().over(Window.orderBy(F.length("value"), "key")).alias("place"))

    def corpus(self, public: bool = True) -> DataFrame:
        """(kind, name, path, source_name, source_rank, text): what full-text search reads."""
        o = self._table("objects", public).select(F.lit("object").alias("kind"), "name", F.col("rel_path").alias("path"), "source_name", "source_rank", F.concat_ws(" ", "object_type", "name").alias("text"))
        r = self._table("resources", public).select(F.lit("resource").alias("kind"), F.col("path").alias("name"), "path", "source_name", "source_rank", F.col("path").alias("text"))
        loc = self._table("localization", public).where("language in ('english', 'simp_chinese')").select(F.lit("localization").alias("kind"), F.col("key").alias("name"), F.col("rel_path").alias("path"), "source_name", "source_rank", F.concat_ws(" ", "key", "value").alias("text"))
        return o.unionByName(r).unionByName(loc)

    def _filled(self, hits: DataFrame, query: str, limit: int, public: bool) -> DataFrame:
        """hits, with free places filled from full-text search, best first."""
        have = hits.count()
        if have >= limit:
            return hits
        docs = self.corpus(public).withColumn("_key", F.concat_ws("\t", "kind", "name", "path"))
        ranked = search.bm25(docs, "_key", "text", query, 4 * limit)
        more = docs.join(F.broadcast(ranked), "_key").join(hits.select("kind", "name", "path"), ["kind", "name", "path"], "left_anti").dropDuplicates(["kind", "name", "path"])
        more = more.withColumn("place", F.row_number().over(Window.orderBy("score", "name", "path")) + have).where(F.col("place") <= limit)
        return hits.unionByName(more.select(*hits.columns))

    def dependencies(self, key: str, depth: int = 2) -> DataFrame:
        """(node, hops) of what a name touches by references, either way."""
        edges = self._table("refs").where("from_name is not null").select(F.col("from_name").alias("u"), F.col("ref_name").alias("v"))
        start = self.spark.createDataFrame([(key.split(":", 1)[-1],)], "node string")
        return graph.hops(graph.undirected(edges), start, depth).select("node", "hops")

    def call_chain(self, key: str, depth: int = 3, callers: bool = False) -> DataFrame:
        edges = self._table("refs").where("from_name is not null").select(F.col("from_name").alias("u"), F.col("ref_name").alias("v"))
        edges = edges.select(F.col("v").alias("u"), F.col("u").alias("v")) if callers else edges
        return graph.call_chain(edges, self.spark.createDataFrame([(key.split(":", 1)[-1],)], "node string"), depth)

    def diagnostics(self, code: str | None = None, prefix: str | None = None, confidence: str | None = None) -> DataFrame:
        rows = self._table("diagnostics")
        rows = rows.where(F.col("code") == code) if code else rows
        rows = rows.where(F.col("path").startswith(prefix)) if prefix else rows
        rows = rows.where(F.col("confidence") == confidence) if confidence else rows
        return rows.orderBy("rank", "code", "path", "line")

    def overrides(self) -> DataFrame:
        return self._table("files").where("overridden").select("rel_path", "source_name", "override_reason", "override_by_source", "override_rule").orderBy("rel_path", "source_name")

    def patterns(self, object_type: str) -> DataFrame:
        """(field, value_shape, n, example) of a type's objects; the example is the first by layer, path and line."""
        objects = self._table("objects").where(F.col("object_type") == object_type).select("file_id", F.col("name").alias("object"), "source_rank", "rel_path", "line")
        rows = self._table("fields").join(objects, ["file_id", "object"])
        return rows.groupBy("field", "value_shape").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("object", "rel_path", "value"), F.struct("source_rank", "rel_path", "line")).alias("example")).orderBy(F.desc("n"), "field", "value_shape")

    def compare(self, key: str, source: str, base: str) -> DataFrame:
        """The fields of a definition in one layer against another's."""
        n = key.split(":", 1)[-1]
        objects = self._table("objects").where(F.col("name") == n).select("file_id", F.col("name").alias("object"), "source_name")
        rows = self._table("fields").join(objects, ["file_id", "object"])
        value = F.coalesce("value", "value_shape")
        sides = [rows.where(F.col("source_name") == s).select("field", value.alias("v")) for s in (source, base)]
        return diff.field_diff(sides[0], sides[1], ["field"], "v").orderBy("field")

    def preflight(self, key: str) -> DataFrame:
        n = key.split(":", 1)[-1]
        paths = self._table("objects").where(F.col("name") == n).select(F.col("rel_path").alias("path")).distinct()
        errors = self._table("diagnostics").join(paths, "path", "left_semi").select(F.lit(n).alias("name"), "severity")
        refs = self._table("refs").where(F.col("from_name") == n).select(F.lit(n).alias("name"), "ref_kind", "state")
        return diagnostics.preflight(refs, errors, "name")

    def preflight_patch(self, objects: DataFrame, refs: DataFrame) -> DataFrame:
        """What would dangle if a patch's objects (rel_path, object_type, name) and refs (rel_path, ref_kind, ref_name) replaced its paths."""
        mine = self._table("objects").select("rel_path", "object_type", "name")
        return rules.patch_preflight(mine, self._table("refs").select("rel_path", "ref_kind", "ref_name"), objects, refs)
