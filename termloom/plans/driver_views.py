"""The driver's tables as a terminology: as DataFrames, and as DuckDB SQL for the oracles."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.operators import hierarchy as H
from termloom.operators.concepts import Terminology
from termloom.operators.search import inverted_index
from termloom.tables import table


#: Closures of table folders that the caller has built and written (as a release build does); queries over them build none.
CLOSURES: dict[str, DataFrame] = {}
#: Word indexes (word, designation_id) of active designations, in the same way.
INDEXES: dict[str, DataFrame] = {}


def _ymd(c: str):  # noqa: ANN202
    return F.date_format(c, "yyyyMMdd").cast("int")


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def code(self, *codes: str) -> DataFrame:
        return self.spark.createDataFrame([(c,) for c in codes], "code string") if codes else self.spark.createDataFrame([], "code string")

    @cached_property
    def concepts(self) -> DataFrame:
        """code, active, module, effective_time, definition_status, display"""
        raw = self.raw

        def rows(df: DataFrame, module: str, code: F.Column, display: F.Column, active=F.lit(True), time=F.lit(20000101), status="primitive"):  # noqa: ANN001, ANN202
            return df.select(code.alias("code"), active.alias("active"), F.lit(module).alias("module"), time.alias("effective_time"), F.lit(status).alias("definition_status"), display.alias("display"))

        c = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
        part = raw("part")
        parts = [
            rows(raw("region"), "region", c("R:", "r_regionkey"), F.col("r_name")),
            rows(raw("nation"), "nation", c("N:", "n_nationkey"), F.col("n_name")),
            rows(raw("customer"), "customer", c("C:", "c_custkey"), F.col("c_name")),
            rows(raw("supplier"), "supplier", c("S:", "s_suppkey"), F.col("s_name")),
            rows(raw("orders"), "orders", c("O:", "o_orderkey"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")), F.col("o_orderstatus") != "F", _ymd("o_orderdate"), "defined"),
            rows(part, "part", c("P:", "p_partkey"), F.col("p_name")),
            rows(part.select("p_brand").distinct(), "brand", c("B:", "p_brand"), F.col("p_brand")),
            rows(part.select("p_type").distinct(), "type", c("T:", "p_type"), F.col("p_type")),
            rows(self.code("PART", "WORLD"), "root", F.col("code"), F.col("code")),
        ]
        return reduce(DataFrame.unionByName, parts)

    @cached_property
    def edges(self) -> DataFrame:
        """child, parent"""
        raw, c = self.raw, lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
        pair = lambda df, a, b: df.select(a.alias("child"), b.alias("parent"))
        part = raw("part")
        brands, types = part.select("p_brand").distinct(), part.select("p_type").distinct()
        return reduce(DataFrame.unionByName, [
            pair(raw("region"), c("R:", "r_regionkey"), F.lit("WORLD")),
            pair(raw("nation"), c("N:", "n_nationkey"), c("R:", "n_regionkey")),
            pair(raw("customer"), c("C:", "c_custkey"), c("N:", "c_nationkey")),
            pair(raw("supplier"), c("S:", "s_suppkey"), c("N:", "s_nationkey")),
            pair(raw("orders"), c("O:", "o_orderkey"), c("C:", "o_custkey")),
            pair(part, c("P:", "p_partkey"), c("B:", "p_brand")),
            pair(part, c("P:", "p_partkey"), c("T:", "p_type")),
            pair(brands, c("B:", "p_brand"), F.lit("PART")),
            pair(types, c("T:", "p_type"), F.lit("PART")),
        ])

    @cached_property
    def closure(self) -> DataFrame:
        """descendant, ancestor, min_depth: a table that was built before (CLOSURES), or built here"""
        return CLOSURES[self.sf_dir] if self.sf_dir in CLOSURES else H.transitive_closure(self.edges)

    @cached_property
    def attributes(self) -> DataFrame:
        """source, role_group (from 0), row_id, kind, target, number, text: five rows a line item"""
        line = self.raw("lineitem").select(
            F.concat(F.lit("O:"), F.col("l_orderkey").cast("string")).alias("source"), (F.col("l_linenumber") - 1).alias("role_group"),
            "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag", F.monotonically_increasing_id().alias("_line"),
        )
        null, s = F.lit(None).cast("string"), lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
        no = F.lit(None).cast("double")
        made = [
            ("has_part", s("P:", "l_partkey"), no, null), ("has_supplier", s("S:", "l_suppkey"), no, null),
            ("quantity", null, F.col("l_quantity"), null), ("discount", null, F.col("l_discount"), null), ("returnflag", null, no, F.col("l_returnflag")),
        ]
        rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("kind"), t.alias("target"), n.alias("number"), x.alias("text")) for i, (k, t, n, x) in enumerate(made)])
        return line.select("source", "role_group", "_line", F.inline(rows)).select("source", "role_group", (F.col("_line") * 5 + F.col("i")).alias("row_id"), "kind", "target", "number", "text")

    @cached_property
    def members(self) -> DataFrame:
        """refset_id, code, active, effective_time, module, fields"""
        segment = self.raw("customer").select(
            F.concat(F.lit("SEG:"), "c_mktsegment").alias("refset_id"), F.concat(F.lit("C:"), F.col("c_custkey").cast("string")).alias("code"), (F.col("c_acctbal") >= 0).alias("active"),
            F.lit(20000101).alias("effective_time"), F.lit("segment").alias("module"), F.create_map(F.lit("balance"), F.col("c_acctbal").cast("decimal(18,2)").cast("string")).alias("fields"),
        )
        priority = self.raw("orders").select(
            F.concat(F.lit("PRI:"), "o_orderpriority").alias("refset_id"), F.concat(F.lit("O:"), F.col("o_orderkey").cast("string")).alias("code"), (F.col("o_orderstatus") != "F").alias("active"),
            _ymd("o_orderdate").alias("effective_time"), F.lit("priority").alias("module"),
            F.create_map(F.lit("targetComponentId"), F.concat(F.lit("C:"), F.col("o_custkey").cast("string"))).alias("fields"),
        )
        return segment.unionByName(priority)

    @cached_property
    def refset_concepts(self) -> DataFrame:
        return self.members.select(F.col("refset_id").alias("code")).distinct()

    @cached_property
    def designations(self) -> DataFrame:
        """designation_id, code, term, language, use_code, active, effective_time, module"""
        def rows(df, prefix, key, term, language, use, active=F.lit(True)):  # noqa: ANN001, ANN202
            code = F.concat(F.lit(prefix), F.col(key).cast("string"))
            return df.select(F.concat(code, F.lit(f"/{language}/{use}")).alias("designation_id"), code.alias("code"), term.alias("term"), F.lit(language).alias("language"), F.lit(use).alias("use_code"), active.alias("active"),
                             F.lit(20000101).alias("effective_time"), F.lit("names").alias("module"))
        part = self.raw("part")
        return reduce(DataFrame.unionByName, [
            rows(part, "P:", "p_partkey", F.col("p_name"), "en", "synonym"),
            rows(part, "P:", "p_partkey", F.concat_ws(" ", "p_name", F.lower("p_type"), "p_brand"), "en", "full"),
            rows(part, "P:", "p_partkey", F.concat(F.lit("artículo "), F.col("p_name")), "es", "synonym", F.col("p_size") <= 25),
            rows(self.raw("customer"), "C:", "c_custkey", F.col("c_name"), "en", "full"),
            rows(self.raw("supplier"), "S:", "s_suppkey", F.col("s_name"), "en", "full"),
        ])

    @cached_property
    def word_index(self) -> DataFrame:
        """word, designation_id of active designations: a sorted file that was written before (INDEXES), or made here"""
        return INDEXES[self.sf_dir] if self.sf_dir in INDEXES else inverted_index(self.designations.filter("active"))

    @cached_property
    def acceptability(self) -> DataFrame:
        """designation_id, refset_id, acceptability: synonyms preferred in their language's set, full names acceptable"""
        return self.designations.select("designation_id", F.concat(F.lit("LANG:"), "language").alias("refset_id"), F.when(F.col("use_code") == "synonym", "preferred").otherwise("acceptable").alias("acceptability"))

    @cached_property
    def properties(self) -> DataFrame:
        """code, property, value_text"""
        part = self.raw("part").select(F.concat(F.lit("P:"), F.col("p_partkey").cast("string")).alias("code"), "p_brand", "p_type", "p_size")
        rows = F.array(
            F.struct(F.lit("brand").alias("property"), F.col("p_brand").alias("value_text")), F.struct(F.lit("type").alias("property"), F.col("p_type").alias("value_text")),
            F.struct(F.lit("size").alias("property"), F.when(F.col("p_size") > 10, F.col("p_size").cast("string")).alias("value_text")),
        )
        return part.select("code", F.inline(rows)).filter("value_text IS NOT NULL")

    @cached_property
    def map_elements(self) -> DataFrame:
        """map, group_no, source, target, code, target_code, relationship, no_map: part to brand; brand to type"""
        part = self.raw("part")
        first = part.filter("p_size <= 40").select(
            F.lit("part-brand").alias("map"), F.lit("parts").alias("source"), F.lit("brands").alias("target"), F.concat(F.lit("P:"), F.col("p_partkey").cast("string")).alias("code"),
            F.when(F.col("p_size") > 3, F.concat(F.lit("B:"), "p_brand")).alias("target_code"),
            F.when(F.col("p_size") > 3, F.lit("source-is-narrower-than-target")).alias("relationship"), (F.col("p_size") <= 3).alias("no_map"),
        )
        counts = part.groupBy("p_brand", "p_type").count()
        best = counts.groupBy("p_brand").agg(F.min_by("p_type", F.struct(-F.col("count"), "p_type")).alias("p_type"))
        second = best.select(F.lit("brand-type").alias("map"), F.lit("brands").alias("source"), F.lit("types").alias("target"), F.concat(F.lit("B:"), "p_brand").alias("code"), F.concat(F.lit("T:"), "p_type").alias("target_code"),
                             F.lit("related-to").alias("relationship"), F.lit(False).alias("no_map"))
        return first.unionByName(second).withColumn("group_no", F.lit(0))

    @cached_property
    def map_unmapped(self) -> DataFrame:
        """map, group_no, mode, code, relationship, other_map"""
        rows = [("part-brand", 0, "fixed", "B:OTHER", "source-is-narrower-than-target", None), ("brand-type", 0, "use-source-code", None, "equivalent", None)]
        return self.spark.createDataFrame(rows, "map string, group_no int, mode string, fixed_code string, relationship string, other_map string")

    @cached_property
    def terminology(self) -> Terminology:
        return Terminology(self.concepts, self.edges, self.closure, self.attributes, self.members, self.designations, self.acceptability)


#: DuckDB forms of the views; `closure` is recursive.
SQL: dict[str, str] = {
    "concepts": """
SELECT 'R:' || r_regionkey AS code, true AS active, 'region' AS module, 20000101 AS effective_time, 'primitive' AS definition_status, r_name AS display FROM region
UNION ALL SELECT 'N:' || n_nationkey, true, 'nation', 20000101, 'primitive', n_name FROM nation
UNION ALL SELECT 'C:' || c_custkey, true, 'customer', 20000101, 'primitive', c_name FROM customer
UNION ALL SELECT 'S:' || s_suppkey, true, 'supplier', 20000101, 'primitive', s_name FROM supplier
UNION ALL SELECT 'O:' || o_orderkey, o_orderstatus <> 'F', 'orders', CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER), 'defined', 'order ' || o_orderkey FROM orders
UNION ALL SELECT 'P:' || p_partkey, true, 'part', 20000101, 'primitive', p_name FROM part
UNION ALL SELECT DISTINCT 'B:' || p_brand, true, 'brand', 20000101, 'primitive', p_brand FROM part
UNION ALL SELECT DISTINCT 'T:' || p_type, true, 'type', 20000101, 'primitive', p_type FROM part
UNION ALL SELECT code, true, 'root', 20000101, 'primitive', code FROM (VALUES ('PART'), ('WORLD')) t(code)""",
    "edges": """
SELECT 'R:' || r_regionkey AS child, 'WORLD' AS parent FROM region
UNION ALL SELECT 'N:' || n_nationkey, 'R:' || n_regionkey FROM nation
UNION ALL SELECT 'C:' || c_custkey, 'N:' || c_nationkey FROM customer
UNION ALL SELECT 'S:' || s_suppkey, 'N:' || s_nationkey FROM supplier
UNION ALL SELECT 'O:' || o_orderkey, 'C:' || o_custkey FROM orders
UNION ALL SELECT 'P:' || p_partkey, 'B:' || p_brand FROM part
UNION ALL SELECT 'P:' || p_partkey, 'T:' || p_type FROM part
UNION ALL SELECT DISTINCT 'B:' || p_brand, 'PART' FROM part
UNION ALL SELECT DISTINCT 'T:' || p_type, 'PART' FROM part""",
    "walks": """
SELECT child AS descendant, parent AS ancestor, 1 AS depth FROM edges
UNION SELECT w.descendant, e.parent, w.depth + 1 FROM walks w JOIN edges e ON w.ancestor = e.child""",
    "closure": "SELECT descendant, ancestor, min(depth) AS min_depth FROM walks GROUP BY ALL",
    "attributes": """
SELECT 'O:' || l_orderkey AS source, l_linenumber - 1 AS role_group, k.i + 5 * line AS row_id, k.kind,
  CASE k.kind WHEN 'has_part' THEN 'P:' || l_partkey WHEN 'has_supplier' THEN 'S:' || l_suppkey END AS target,
  CASE k.kind WHEN 'quantity' THEN l_quantity WHEN 'discount' THEN l_discount END AS number,
  CASE k.kind WHEN 'returnflag' THEN l_returnflag END AS text
FROM (SELECT *, row_number() OVER () AS line FROM lineitem) l, (VALUES (0, 'has_part'), (1, 'has_supplier'), (2, 'quantity'), (3, 'discount'), (4, 'returnflag')) k(i, kind)""",
    "members": """
SELECT 'SEG:' || c_mktsegment AS refset_id, 'C:' || c_custkey AS code, c_acctbal >= 0 AS active, 20000101 AS effective_time, 'segment' AS module,
  CAST(CAST(c_acctbal AS DECIMAL(18, 2)) AS VARCHAR) AS balance, CAST(NULL AS VARCHAR) AS targetComponentId FROM customer
UNION ALL SELECT 'PRI:' || o_orderpriority, 'O:' || o_orderkey, o_orderstatus <> 'F', CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER), 'priority', CAST(NULL AS VARCHAR), 'C:' || o_custkey FROM orders""",
    "designations": """
SELECT 'P:' || p_partkey || '/en/synonym' AS designation_id, 'P:' || p_partkey AS code, p_name AS term, 'en' AS language, 'synonym' AS use_code, true AS active FROM part
UNION ALL SELECT 'P:' || p_partkey || '/en/full', 'P:' || p_partkey, p_name || ' ' || lower(p_type) || ' ' || p_brand, 'en', 'full', true FROM part
UNION ALL SELECT 'P:' || p_partkey || '/es/synonym', 'P:' || p_partkey, 'artículo ' || p_name, 'es', 'synonym', p_size <= 25 FROM part
UNION ALL SELECT 'C:' || c_custkey || '/en/full', 'C:' || c_custkey, c_name, 'en', 'full', true FROM customer
UNION ALL SELECT 'S:' || s_suppkey || '/en/full', 'S:' || s_suppkey, s_name, 'en', 'full', true FROM supplier""",
    "acceptability": "SELECT designation_id, 'LANG:' || language AS refset_id, CASE WHEN use_code = 'synonym' THEN 'preferred' ELSE 'acceptable' END AS acceptability FROM designations",
    "properties": """
SELECT 'P:' || p_partkey AS code, 'brand' AS property, p_brand AS value_text FROM part
UNION ALL SELECT 'P:' || p_partkey, 'type', p_type FROM part
UNION ALL SELECT 'P:' || p_partkey, 'size', CAST(p_size AS VARCHAR) FROM part WHERE p_size > 10""",
    "map_elements": """
SELECT 'part-brand' AS map, 'parts' AS source, 'brands' AS target, 'P:' || p_partkey AS code, CASE WHEN p_size > 3 THEN 'B:' || p_brand END AS target_code,
  CASE WHEN p_size > 3 THEN 'source-is-narrower-than-target' END AS relationship, p_size <= 3 AS no_map FROM part WHERE p_size <= 40
UNION ALL SELECT 'brand-type', 'brands', 'types', 'B:' || p_brand, 'T:' || p_type, 'related-to', false FROM
  (SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS place FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY p_brand, p_type)) WHERE place = 1""",
}
_NEEDS = {"closure": ["edges", "walks"], "walks": ["edges"], "acceptability": ["designations"]}


def sql(body: str, *views: str) -> str:
    """body after the views it names and those that they are made from."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for v in views:
        add(v)
    return "WITH RECURSIVE " + ",\n".join(f"{v} AS ({SQL[v]})" for v in order) + ("\n" if body.lstrip().startswith("SELECT") else ",\n") + body.strip() if order else body
