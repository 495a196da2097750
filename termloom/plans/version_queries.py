"""Registered queries over several versions of one system, with their SQL.

The orders' system has three versions: orders come in with the first, second or third by their date, and the third has dropped some and made others inactive.
"""

from __future__ import annotations

from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.operators import codes as K
from termloom.operators import valuesets as VS
from termloom.operators import versioned as VV
from termloom.plans.driver_views import Views, sql
from termloom.plans.registry import query
from termloom.plans.valueset_queries import SYSTEM, Sets
from termloom.tables import cut

WORLD = ("1.9", "1.10", "2")
#: Which versions hold an order, in SQL that both engines read.
_HELD = "(v = '1.9' AND o_orderdate < DATE '1995-01-01') OR (v = '1.10' AND o_orderdate < DATE '1997-01-01') OR (v = '2' AND NOT (o_orderstatus = 'F' AND o_orderkey % 7 = 0))"

_VERSIONED = f"""
world_versions AS (SELECT * FROM (VALUES ('1.9', 1), ('1.10', 2), ('2', 3)) t(v, n)),
contents AS (
  SELECT 'world' AS system, v, n, 'O:' || o_orderkey AS code, CASE WHEN v = '2' THEN o_orderstatus <> 'F' ELSE true END AS active FROM orders, world_versions WHERE {_HELD}
  UNION ALL SELECT 'world', v, n, code, active FROM concepts, world_versions WHERE module NOT IN ('orders', 'part', 'brand', 'type') AND code <> 'PART'
  UNION ALL SELECT 'parts', '2', 1, code, active FROM concepts WHERE module IN ('part', 'brand', 'type') OR code = 'PART')"""


class Versions:
    def __init__(self, v: Views) -> None:
        self.v = v

    @cached_property
    def releases(self) -> DataFrame:
        rows = [("world", x, False, "complete") for x in WORLD] + [("parts", "2", True, "complete")]
        return VV.number_releases(self.v.spark.createDataFrame(rows, "system string, version string, case_sensitive boolean, content string"))

    @cached_property
    def contents(self) -> DataFrame:
        """system, version, code, display, active, abstract, module of every release."""
        v = self.v
        c = v.concepts.withColumn("system", F.expr(SYSTEM.format("code"))).withColumn("abstract", F.lit(False)).select("system", "code", "display", "active", "abstract", "module")
        rest = c.filter("module != 'orders'").join(self.releases.select("system", "version"), "system")
        dated = v.raw("orders").select("o_orderkey", "o_orderdate", "o_orderstatus", F.explode(F.array(*[F.lit(x) for x in WORLD])).alias("v")).filter(_HELD)
        orders = dated.select(F.lit("world").alias("system"), F.col("v").alias("version"), F.concat(F.lit("O:"), F.col("o_orderkey").cast("string")).alias("code"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("display"),
                              ((F.col("v") != "2") | (F.col("o_orderstatus") != "F")).alias("active"), F.lit(False).alias("abstract"), F.lit("orders").alias("module"))
        return rest.unionByName(orders)

    @cached_property
    def intervals(self) -> DataFrame:
        return VV.code_intervals(self.contents, self.releases)

    @cached_property
    def tables(self) -> VS.SystemTables:
        """Edges of an order are there as long as the order is."""
        v = self.v
        edges = v.edges.withColumn("system", F.expr(SYSTEM.format("child")))
        intervals = cut(self.intervals, "intervals")
        orders = intervals.filter("module = 'orders'").select(F.col("code").alias("child"), "from_no", "to_no")
        dated = edges.filter("child LIKE 'O:%'").join(orders, "child")
        always = edges.filter("child NOT LIKE 'O:%'").withColumns({"from_no": F.lit(1), "to_no": F.lit(len(WORLD))})
        return replace(Sets(v).tables, concepts=intervals.drop("key"), edges=always.unionByName(dated.select(*always.columns)), systems=self.releases)


@query("version_intervals", sql(f"""{_VERSIONED},
marked AS (SELECT *, n - row_number() OVER (PARTITION BY system, code, active ORDER BY n) AS run FROM contents)
SELECT system, code, active, min(n) AS from_no, max(n) AS to_no FROM marked GROUP BY system, code, active, run""", "concepts"))
def version_intervals(v: Views) -> DataFrame:
    return Versions(v).intervals.select("system", "code", "active", "from_no", "to_no")


_ASKED = """CASE o_orderkey % 6 WHEN 1 THEN '1.9' WHEN 2 THEN '1.x' WHEN 3 THEN '2' WHEN 4 THEN '99' WHEN 5 THEN 'x' END"""
_FACTS = f"""facts AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 50 = 0 THEN 'elsewhere' ELSE 'world' END AS system, 'o:' || (o_orderkey + o_orderkey % 3) AS code, {_ASKED} AS version FROM orders),
resolved AS (SELECT *, CASE WHEN system = 'world' THEN CASE version WHEN '1.9' THEN '1.9' WHEN '1.x' THEN '1.10' WHEN '99' THEN NULL ELSE '2' END END AS release FROM facts)"""


def _facts(v: Views) -> DataFrame:
    key = F.col("o_orderkey")
    return v.raw("orders").select(
        key.alias("id"), F.when(key % 50 == 0, "elsewhere").otherwise("world").alias("system"), F.concat(F.lit("o:"), (key + key % 3).cast("string")).alias("code"), F.expr(_ASKED).alias("version"),
    )


@query("validate_codes_versions", sql(f"""{_VERSIONED}, {_FACTS}
SELECT id, release, r.system = 'world' AND c.code IS NOT NULL AS result,
  CASE WHEN r.system <> 'world' THEN 'unknown-system' WHEN release IS NULL THEN 'unknown-version' WHEN c.code IS NULL THEN 'unknown-code' WHEN NOT c.active THEN 'inactive,case-differs' ELSE 'case-differs' END AS reasons
FROM resolved r LEFT JOIN contents c ON c.system = r.system AND c.v = r.release AND lower(c.code) = r.code""", "concepts"))
def validate_codes_versions(v: Views) -> DataFrame:
    """Each fact in the version that it names (a pattern, none, or one that is not there): one row a fact."""
    s = Versions(v)
    out = K.validate_codes(_facts(v), s.intervals, s.releases)
    return out.select("id", "release", "result", F.array_join("issues.reason", ",").alias("reasons"))


@query("lookup_versions", sql(f"""{_VERSIONED}, {_FACTS}
SELECT id, r.release AS version, c.active, CASE WHEN c.code IS NOT NULL THEN 'order ' || substr(c.code, 3) END AS name
FROM resolved r LEFT JOIN contents c ON c.system = r.system AND c.v = r.release AND lower(c.code) = r.code""", "concepts"))
def lookup_versions(v: Views) -> DataFrame:
    s, sets = Versions(v), Sets(v)
    return K.lookup(_facts(v), s.intervals, s.releases, sets.designations, sets.tables.properties).select("id", "version", "active", "name")


def _pinned(s: Sets) -> DataFrame:
    """A set a nation in the version that its key gives; sets of regions over them in one version, less what ends with 7."""
    pin = F.get(F.array(F.lit(None).cast("string"), F.lit("1.9"), F.lit("1.x"), F.lit("99")), (F.regexp_extract("url", r"(\d+)$", 1).cast("int") % 4))
    nations = s.rules.filter("url LIKE 'nation/%'").withColumn("system_version", pin)
    regions = s.rules.filter("url LIKE 'region/%'").withColumn("system_version", F.when(F.col("system").isNotNull(), "1.9"))
    brands = s.rules.filter("url LIKE 'brand/%'").withColumn("system_version", F.when(F.col("rule_no") == 1, "3"))
    return nations.unionByName(regions).unionByName(brands)


_PINS = "CASE n_nationkey % 4 WHEN 0 THEN '2' WHEN 1 THEN '1.9' WHEN 2 THEN '1.10' END"


@query("vs_compose_versions", sql(f"""{_VERSIONED},
pins AS (SELECT n_nationkey, n_regionkey, {_PINS} AS v FROM nation),
inside AS (
  SELECT 'N:' || n_nationkey AS top, 'N:' || n_nationkey AS code FROM nation UNION ALL SELECT 'N:' || c_nationkey, 'C:' || c_custkey FROM customer
  UNION ALL SELECT 'N:' || s_nationkey, 'S:' || s_suppkey FROM supplier UNION ALL SELECT 'N:' || c_nationkey, 'O:' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey),
nations AS (SELECT n_nationkey, n_regionkey, p.v AS version, i.code FROM pins p JOIN inside i ON top = 'N:' || n_nationkey JOIN contents c ON c.system = 'world' AND c.v = p.v AND c.code = i.code)
SELECT 'nation/' || n_nationkey AS url, 'world' AS system, version, code FROM nations
UNION ALL SELECT 'region/' || n_regionkey, 'world', version, code FROM nations WHERE NOT (version = '1.9' AND code LIKE 'O:%7')
UNION ALL SELECT 'brand/' || p_brand, 'parts', '2', 'P:' || p_partkey FROM part WHERE p_size <= 10""", "concepts"))
def vs_compose_versions(v: Views) -> DataFrame:
    """Rules pinned to versions, by pattern and by default; a pin to an absent version gives nothing but an error row."""
    s = Versions(v)
    out, _ = VV.expand_versions(_pinned(Sets(v)), s.tables, s.releases)
    return out.select("url", "system", "version", "code")


@query("vs_version_errors", f"""
SELECT 'nation/' || n_nationkey AS url, 0 AS rule_no, 'world' AS system, '99' AS system_version, 'unknown-version' AS error FROM nation WHERE n_nationkey % 4 = 3
UNION ALL SELECT DISTINCT 'brand/' || p_brand, 1, 'parts', '3', 'unknown-version' FROM part UNION ALL SELECT 'nowhere', 0, 'nowhere', NULL, 'unknown-system'""")
def vs_version_errors(v: Views) -> DataFrame:
    s, sets = Versions(v), Sets(v)
    rules = _pinned(sets).unionByName(sets.literal(VS.implicit("all", "nowhere", url="nowhere")))
    return VV.expand_versions(rules, s.tables, s.releases)[1].select("url", "rule_no", "system", "system_version", "error")
