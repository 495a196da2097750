"""Registered queries over value sets, with their SQL. Value sets are derived from nations, regions and brands."""

from __future__ import annotations

from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.operators import concepts as C
from termloom.operators import valuesets as VS
from termloom.plans.driver_views import CLOSURES, SQL, Views, sql
from termloom.plans.registry import query

SYSTEM = "CASE WHEN {0} LIKE 'P:%' OR {0} LIKE 'B:%' OR {0} LIKE 'T:%' OR {0} = 'PART' THEN 'parts' ELSE 'world' END"


class Sets:
    def __init__(self, v: Views) -> None:
        self.v = v

    @cached_property
    def tables(self) -> VS.SystemTables:
        v = self.v
        of = lambda c: F.expr(SYSTEM.format(c))
        concepts = v.concepts.withColumn("system", of("code")).withColumn("abstract", F.col("module").isin("root", "region"))
        closure = lambda: v.closure.withColumn("system", of("descendant"))
        systems = v.spark.sql("SELECT * FROM VALUES ('parts', '2', true, 'complete'), ('world', '1.10', false, 'fragment') AS t(system, version, case_sensitive, content)")
        return VS.SystemTables(
            concepts, v.edges.withColumn("system", of("child")), closure() if v.sf_dir in CLOSURES else closure, v.properties.withColumn("system", F.lit("parts")), systems,
            v.members.withColumn("system", F.lit("world")), designations=self.designations,
        )

    @property
    def designations(self) -> DataFrame:
        return self.v.designations.withColumn("system", F.expr(SYSTEM.format("code")))

    @cached_property
    def rules(self) -> DataFrame:
        """A value set a nation (its subtree), a region (references to its nations' sets, less its first order customers) and a brand (listed parts)."""
        v, null = self.v, lambda kind="string": F.lit(None).cast(kind)

        def rows(df, url, no=0, side="include", system=None, concept_no=None, code=None, display=None, filter_no=None, prop=None, op=None, value=None, ref=None):  # noqa: ANN001, ANN202
            s = lambda x, kind="string": null(kind) if x is None else x
            return df.select(url.alias("url"), F.lit(side).alias("side"), F.lit(no).alias("rule_no"), s(system).alias("system"), null().alias("system_version"), s(concept_no, "int").alias("concept_no"), s(code).alias("code"), s(display).alias("display"),
                             s(filter_no, "int").alias("filter_no"), s(prop).alias("property"), s(op).alias("op"), s(value).alias("value"), s(ref).alias("ref_url"))

        nation, part = v.raw("nation"), v.raw("part")
        c = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
        world, parts, zero, concept = F.lit("world"), F.lit("parts"), F.lit(0), F.lit("concept")
        return (
            rows(nation, c("nation/", "n_nationkey"), system=world, filter_no=zero, prop=concept, op=F.lit("is-a"), value=c("N:", "n_nationkey"))
            .unionByName(rows(nation, c("region/", "n_regionkey"), no=1, ref=c("nation/", "n_nationkey")).withColumn("rule_no", F.regexp_extract("ref_url", r"(\d+)$", 1).cast("int")))
            .unionByName(rows(nation.select("n_regionkey").distinct(), c("region/", "n_regionkey"), side="exclude", system=world, filter_no=zero, prop=concept, op=F.lit("regex"), value=F.lit("O:.*7")))
            .unionByName(rows(part.filter("p_size <= 10"), c("brand/", "p_brand"), system=parts, concept_no=F.col("p_partkey").cast("int"), code=c("P:", "p_partkey"), display=F.when(F.col("p_size") == 1, F.upper("p_name"))))
            .unionByName(rows(part.select("p_brand").distinct(), c("brand/", "p_brand"), no=1, system=parts, filter_no=zero, prop=F.lit("size"), op=F.lit("="), value=F.lit("20")))
            .unionByName(rows(part.select("p_brand").distinct(), c("brand/", "p_brand"), no=1, system=parts, filter_no=F.lit(1), prop=F.lit("brand"), op=F.lit("="), value=F.col("p_brand")))
        )

    def literal(self, rows: list[tuple]) -> DataFrame:
        return self.v.spark.createDataFrame(rows, VS.RULES)

    def expand(self, *rows: list[tuple], **options) -> DataFrame:  # noqa: ANN003
        return VS.expand(self.literal([r for part in rows for r in part]), self.tables, **options)


_PART = "SELECT code FROM concepts WHERE {0}".format


def _codes(s: str) -> str:
    return f"SELECT DISTINCT code FROM ({s})"


@query("vs_filter_code", sql("""
SELECT 'a' AS url, code FROM concepts WHERE regexp_full_match(code, 'P:1.*') UNION ALL SELECT 'b', code FROM concepts WHERE code IN ('B:Brand#11', 'T:STANDARD')
UNION ALL SELECT 'c', code FROM concepts WHERE (code LIKE 'B:%' OR code LIKE 'T:%' OR code LIKE 'P:%' OR code = 'PART') AND code NOT IN ('PART')""", "concepts"))  # fmt: skip
def vs_filter_code(v: Views) -> DataFrame:
    made = VS.rule("a", "include", 0, "parts", filters=[("code", "regex", "P:1.*")]), VS.rule("b", "include", 0, "parts", filters=[("concept", "in", "B:Brand#11, T:STANDARD, none")]), VS.rule("c", "include", 0, "parts", filters=[("code", "not-in", "PART")])
    return Sets(v).expand(*made, refuse=False).select("url", "code")  # one listed code is unknown


@query("vs_filter_hierarchy", sql("""
SELECT 'is-a' AS url, code FROM (SELECT descendant AS code FROM closure WHERE ancestor = 'R:1' UNION SELECT 'R:1')
UNION ALL SELECT 'descendent-of', descendant FROM closure WHERE ancestor = 'N:3'
UNION ALL SELECT 'is-not-a', code FROM concepts WHERE (code LIKE 'B:%' OR code LIKE 'T:%' OR code LIKE 'P:%' OR code = 'PART') AND code <> 'B:Brand#11' AND code NOT IN (SELECT descendant FROM closure WHERE ancestor = 'B:Brand#11')
UNION ALL SELECT 'generalizes', code FROM (SELECT ancestor AS code FROM closure WHERE descendant = 'P:5' UNION SELECT 'P:5')
UNION ALL SELECT 'child-of', child FROM edges WHERE parent = 'WORLD'
UNION ALL SELECT 'descendent-leaf', descendant FROM closure WHERE ancestor = 'N:3' AND descendant NOT IN (SELECT parent FROM edges)""", "concepts", "closure"))  # fmt: skip
def vs_filter_hierarchy(v: Views) -> DataFrame:
    named = [("is-a", "world", "R:1"), ("descendent-of", "world", "N:3"), ("is-not-a", "parts", "B:Brand#11"), ("generalizes", "parts", "P:5"), ("child-of", "world", "WORLD"), ("descendent-leaf", "world", "N:3")]
    return Sets(v).expand(*[VS.rule(op, "include", 0, s, filters=[("concept", op, x)]) for op, s, x in named]).select("url", "code")


@query("vs_filter_property", sql("""
SELECT 'eq' AS url, code FROM properties WHERE property = 'type' AND value_text = 'STANDARD'
UNION ALL SELECT 'not-in', code FROM concepts WHERE (code LIKE 'B:%' OR code LIKE 'T:%' OR code LIKE 'P:%' OR code = 'PART') AND code NOT IN (SELECT code FROM properties WHERE property = 'size' AND value_text IN ('20', '30'))
UNION ALL SELECT 'regex', code FROM properties WHERE property = 'brand' AND regexp_full_match(value_text, 'Brand#1.')
UNION ALL SELECT 'no-size', code FROM concepts WHERE (code LIKE 'B:%' OR code LIKE 'T:%' OR code LIKE 'P:%' OR code = 'PART') AND code NOT IN (SELECT code FROM properties WHERE property = 'size')""", "concepts", "properties"))  # fmt: skip
def vs_filter_property(v: Views) -> DataFrame:
    named = [("eq", "type", "=", "STANDARD"), ("not-in", "size", "not-in", "20,30"), ("regex", "brand", "regex", "Brand#1."), ("no-size", "size", "exists", "false")]
    return Sets(v).expand(*[VS.rule(u, "include", 0, "parts", filters=[f]) for u, *f in named]).select("url", "code")


@query("vs_filter_parent_child", sql("SELECT 'p' AS url, child AS code FROM edges WHERE parent = 'B:Brand#12' UNION ALL SELECT 'c', parent FROM edges WHERE child = 'P:7'", "edges"))
def vs_filter_parent_child(v: Views) -> DataFrame:
    return Sets(v).expand(VS.rule("p", "include", 0, "parts", filters=[("parent", "=", "B:Brand#12")]), VS.rule("c", "include", 0, "parts", filters=[("child", "=", "P:7")])).select("url", "code")


@query("vs_filter_refset", sql("SELECT DISTINCT refset_id AS url, code FROM members WHERE active AND refset_id LIKE 'SEG:%'", "members"))
def vs_filter_refset(v: Views) -> DataFrame:
    s = Sets(v)
    names = v.raw("customer").filter("c_mktsegment IS NOT NULL").select(F.concat(F.lit("SEG:"), "c_mktsegment").alias("url")).distinct().withColumn("value", F.col("url"))
    made = s.literal(VS.implicit("members", "world"))
    rules = made.drop("url", "value").crossJoin(names).select(*made.columns)
    return VS.expand(rules, s.tables).select("url", "code")


@query("vs_filter_constraint", sql("""
SELECT 'constraint' AS url, descendant AS code FROM closure WHERE ancestor = 'R:1' AND descendant NOT IN (SELECT code FROM members WHERE refset_id = 'PRI:1-URGENT' AND active)
UNION ALL SELECT 'both', descendant FROM closure WHERE ancestor = 'R:1' AND descendant LIKE 'O:%1' AND descendant NOT IN (SELECT code FROM members WHERE refset_id = 'PRI:1-URGENT' AND active)""", "closure", "members"))
def vs_filter_constraint(v: Views) -> DataFrame:
    """A set made by the set operators (below a region, less a reference set) in a rule, alone and with a pattern."""
    s = Sets(v)
    urgent = C.ConceptSet(v.terminology, C.member_of(v.code("PRI:1-URGENT"), v.members))
    calm = v.terminology.concept("R:1").descendants().minus(urgent)
    tables = replace(s.tables, sets=VS.named_sets({"calm": ("world", calm.df)}))
    rules = s.literal([*VS.implicit("constraint", "world", "calm", "constraint"), *VS.rule("both", "include", 0, "world", filters=[("constraint", "=", "calm"), ("code", "regex", "O:.*1")])])
    return VS.expand(rules, tables).select("url", "code")


@query("vs_enumerated", sql("""
SELECT 'listed' AS url, code, CASE code WHEN 'N:1' THEN 'First' ELSE display END AS display, concept_no FROM concepts JOIN (VALUES ('N:1', 0), ('R:2', 1), ('PART', 4)) t(c, concept_no) ON c = code""", "concepts"))  # fmt: skip
def vs_enumerated(v: Views) -> DataFrame:
    made = VS.rule("listed", "include", 0, "world", codes=[("n:1", "First"), "r:2", "none"]), [("listed", "include", 1, "parts", None, 4, "PART", None, None, None, None, None, None), ("listed", "include", 1, "parts", None, 5, "part", None, None, None, None, None, None)]
    return Sets(v).expand(*made).select("url", "code", "display", "concept_no")


@query("vs_include", sql("""
SELECT code FROM properties WHERE property = 'type' AND value_text = 'STANDARD' INTERSECT SELECT descendant FROM closure WHERE ancestor = 'B:Brand#11' INTERSECT SELECT code FROM concepts WHERE code LIKE '%1'""", "concepts", "closure", "properties"))  # fmt: skip
def vs_include(v: Views) -> DataFrame:
    ends = VS.rule("ends", "include", 0, "parts", filters=[("code", "regex", ".*1")])
    made = VS.rule("both", "include", 0, "parts", filters=[("type", "=", "STANDARD"), ("concept", "descendent-of", "B:Brand#11")], refs=["ends"])
    return Sets(v).expand(ends, made).filter("url = 'both'").select("code")


_ALL = """
nations AS (SELECT 'nation/' || substr(ancestor, 3) AS url, descendant AS code FROM closure WHERE ancestor LIKE 'N:%' UNION SELECT 'nation/' || n_nationkey, 'N:' || n_nationkey FROM nation),
expanded AS (
  SELECT * FROM nations
  UNION ALL SELECT 'region/' || n_regionkey, code FROM nations JOIN nation ON url = 'nation/' || n_nationkey WHERE NOT (code LIKE 'O:%7')
  UNION ALL SELECT 'brand/' || p_brand, 'P:' || p_partkey FROM part WHERE p_size <= 10 OR p_size = 20)"""


@query("vs_compose", sql(f"{_ALL} SELECT url, code FROM expanded", "closure"))
def vs_compose(v: Views) -> DataFrame:
    s = Sets(v)
    return VS.expand(s.rules, s.tables).select("url", "code")


@query("vs_references", sql("""
nations AS (SELECT 'nation/' || substr(ancestor, 3) AS url, descendant AS code FROM closure WHERE ancestor LIKE 'N:%' UNION SELECT 'nation/' || n_nationkey, 'N:' || n_nationkey FROM nation)
SELECT 'region/' || n_regionkey AS url, code FROM nations JOIN nation ON url = 'nation/' || n_nationkey WHERE NOT (code LIKE 'O:%7')""", "closure"))  # fmt: skip
def vs_references(v: Views) -> DataFrame:
    """Value sets made of references, resolved from the ones below up."""
    s = Sets(v)
    return VS.expand(s.rules.filter("url NOT LIKE 'brand%'"), s.tables).filter("url LIKE 'region%'").select("url", "code")


@query("vs_used_versions", """
SELECT 'region/' || n_regionkey AS url, 'value-set' AS kind, 'nation/' || n_nationkey AS used FROM nation
UNION ALL SELECT 'region/' || r_regionkey, kind, 'world|1.10' FROM region, (VALUES ('system'), ('fragment')) t(kind) UNION ALL SELECT 'nation/' || n_nationkey, kind, 'world|1.10' FROM nation, (VALUES ('system'), ('fragment')) t(kind)
UNION ALL SELECT DISTINCT 'brand/' || p_brand, 'system', 'parts|2' FROM part UNION ALL SELECT DISTINCT 'brand/' || p_brand, 'supplement', 'urn:es|3' FROM part
UNION ALL SELECT 'nation/3', 'supplement', 'urn:names|1' UNION ALL SELECT 'region/' || n_regionkey, 'supplement', 'urn:names|1' FROM nation WHERE n_nationkey = 3""")
def vs_used_versions(v: Views) -> DataFrame:
    """Systems, fragments, value sets and the supplements that sets ask for; a supplement of another system than a set draws on is not used."""
    s = Sets(v)
    supplements = v.spark.createDataFrame([("parts", "urn:es", "3"), ("world", "urn:names", "1")], "system string, supplement_url string, version string")
    both = F.explode(F.array(F.lit("urn:es"), F.lit("urn:other"))).alias("supplement_url")
    asked = s.rules.filter("url LIKE 'brand/%'").select("url").distinct().select("url", both).unionByName(v.spark.sql("SELECT * FROM VALUES ('nation/3', 'urn:names'), ('nation/3', 'urn:es') AS t(url, supplement_url)"))
    return VS.used_versions(s.rules, s.tables.systems, supplements, asked)


@query("vs_reference_cycles", "SELECT 'nation/' || n_nationkey AS url FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'region/1'")
def vs_reference_cycles(v: Views) -> DataFrame:
    s = Sets(v)
    back = v.raw("nation").filter("n_regionkey = 1").select(F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string")).alias("url"), F.lit("region/1").alias("ref_url"))
    return VS.reference_cycles(s.rules.select("url", "ref_url").unionByName(back))


@query("vs_active_only", sql(f"{_ALL} SELECT url, code FROM expanded WHERE code NOT IN (SELECT code FROM concepts WHERE NOT active)", "closure", "concepts"))
def vs_active_only(v: Views) -> DataFrame:
    s = Sets(v)
    return VS.expand(s.rules, s.tables, active_only=True).select("url", "code")


@query("vs_exclude_abstract", sql("SELECT code FROM concepts WHERE code NOT IN (SELECT code FROM concepts WHERE module IN ('root', 'region', 'brand', 'type', 'part'))", "concepts"))
def vs_exclude_abstract(v: Views) -> DataFrame:
    return Sets(v).expand(VS.implicit("all", "world"), selectable_only=True).select("code")


_WORDS = "list_filter(string_split_regex(lower(term), '[^a-záéíóú0-9]+'), lambda w: w <> '')"


@query("vs_text", sql(f"""
texts AS (SELECT code, display AS term FROM concepts UNION ALL SELECT code, term FROM designations WHERE active),
words AS (SELECT DISTINCT code, unnest({_WORDS}) AS word FROM texts WHERE code LIKE 'P:%' OR code LIKE 'B:%'),
asked AS (SELECT p_brand, lower(substr(min(p_name), 1, 2)) AS start FROM part GROUP BY p_brand),
inside AS (SELECT 'B:' || p_brand AS brand, 'B:' || p_brand AS code FROM part UNION SELECT 'B:' || p_brand, 'P:' || p_partkey FROM part)
SELECT DISTINCT p_brand AS url, code FROM asked JOIN inside ON brand = 'B:' || p_brand JOIN words USING (code) WHERE starts_with(word, start)""", "concepts", "designations"))
def vs_text(v: Views) -> DataFrame:
    """A set and a text of its own for each brand: words of the display or of any active designation, met through the word index."""
    s, brands = Sets(v), v.raw("part").groupBy("p_brand").agg(F.substring(F.min("p_name"), 1, 2).alias("text"))
    head = s.literal([]).columns
    rules = brands.select(F.col("p_brand").alias("url"), F.lit("include").alias("side"), F.lit(0).alias("rule_no"), F.lit("parts").alias("system"), F.lit(0).alias("filter_no"), F.lit("concept").alias("property"), F.lit("is-a").alias("op"), F.concat(F.lit("B:"), "p_brand").alias("value"))
    rules = s.literal([]).unionByName(rules, allowMissingColumns=True).select(*head)
    return VS.expand(rules, s.tables, text=brands.select(F.col("p_brand").alias("url"), "text")).select("url", "code")


@query("vs_text_all", sql("""
texts AS (SELECT code, display AS term FROM concepts UNION ALL SELECT code, term FROM designations WHERE active)
SELECT code FROM concepts WHERE module IN ('part', 'brand', 'type', 'root') AND code NOT IN ('WORLD') AND code IN (
  SELECT code FROM texts WHERE len(list_filter(string_split_regex(lower(term), '[^a-z0-9]+'), lambda w: starts_with(w, 'b'))) > 0)""", "concepts", "designations"))
def vs_text_all(v: Views) -> DataFrame:
    """One text for the whole system."""
    return Sets(v).expand(VS.implicit("all", "parts"), text="B").select("code")


@query("vs_page", sql(f"""{_ALL}
SELECT * FROM (SELECT url, code, row_number() OVER (PARTITION BY url ORDER BY CASE WHEN url LIKE 'region%' THEN CAST(nat AS INTEGER) WHEN url LIKE 'brand%' AND size > 10 THEN 1 ELSE 0 END,
  CASE WHEN url LIKE 'brand%' AND size <= 10 THEN key ELSE 0 END, code) - 1 AS place, count(*) OVER (PARTITION BY url) AS total
  FROM (SELECT e.url, e.code, p_size AS size, p_partkey AS key, substr(n.url, 8) AS nat FROM expanded e LEFT JOIN part ON e.code = 'P:' || p_partkey LEFT JOIN nations n ON e.url LIKE 'region%' AND n.code = e.code))
WHERE place BETWEEN 5 AND 14""", "closure"))  # fmt: skip
def vs_page(v: Views) -> DataFrame:
    s = Sets(v)
    return VS.pages(VS.expand(s.rules, s.tables), 5, 10).select("url", "code", "place", "total")


@query("vs_designations", sql("""
SELECT code, list(term ORDER BY use_code, term) AS terms FROM designations WHERE active AND language = 'en' AND code IN (SELECT 'P:' || p_partkey FROM part WHERE p_size <= 10 OR p_size = 20) GROUP BY code""", "designations"))  # fmt: skip
def vs_designations(v: Views) -> DataFrame:
    s = Sets(v)
    out = VS.with_designations(VS.expand(s.rules.filter("url LIKE 'brand%'"), s.tables), s.designations, languages=["en"])
    return out.select("code", F.col("designations.term").alias("terms"))


@query("vs_properties", sql("""
SELECT c.code, max(value_text) FILTER (property = 'type') AS type, max(value_text) FILTER (property = 'size') AS size, CASE WHEN NOT bool_and(active) THEN 'inactive' END AS status
FROM concepts c LEFT JOIN properties p ON p.code = c.code GROUP BY c.code""", "concepts", "properties"))  # fmt: skip
def vs_properties(v: Views) -> DataFrame:
    s = Sets(v)
    out = VS.with_properties(s.expand(VS.implicit("all", "world", url="u"), VS.implicit("all", "parts", url="w")), s.tables.properties, ["type", "size"])
    return out.select("code", *[F.col("properties")[k].alias(k) for k in ("type", "size", "status")])


@query("vs_pin_versions", """
SELECT url, CASE system WHEN 'world' THEN '9' ELSE '2' END AS resolved, system = 'parts' AS pin_error FROM (
  SELECT 'nation/' || n_nationkey AS url, 'world' AS system FROM nation UNION ALL SELECT DISTINCT 'brand/' || p_brand, 'parts' FROM part)
UNION ALL SELECT DISTINCT 'region/' || n_regionkey, CASE WHEN n_nationkey = 3 THEN '2.10' ELSE '2.9' END, n_nationkey = 4 FROM nation
UNION ALL SELECT DISTINCT 'region/' || n_regionkey, '9', false FROM nation""")
def vs_pin_versions(v: Views) -> DataFrame:
    s = Sets(v)
    pins = v.spark.createDataFrame([("world", "8", None, "9"), ("parts", None, "1", None)], "system string, default_version string, check_version string, force_version string")
    names = v.raw("nation").select(F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string")).alias("url"))
    value_sets = names.withColumn("version", F.explode(F.array(F.lit("2.9"), F.lit("1.30"))))
    set_pins = v.spark.createDataFrame([("nation/3", None, None, "2.10"), ("nation/4", None, "1.30", None)], "url string, default_version string, check_version string, force_version string")
    return VS.pin_versions(s.rules, pins, s.tables.systems, set_pins, value_sets, ["elsewhere"]).select("url", "resolved", "pin_error").distinct()


@query("vs_contains", sql(f"""{_ALL},
asked AS (SELECT 'region/' || (l_linenumber % 5) AS url, 'O:' || l_orderkey AS code FROM lineitem)
SELECT a.url, a.code, e.code IS NOT NULL AS inside FROM asked a LEFT JOIN expanded e USING (url, code)""", "closure"))
def vs_contains(v: Views) -> DataFrame:
    s = Sets(v)
    asked = v.raw("lineitem").select(F.concat(F.lit("region/"), (F.col("l_linenumber") % 5).cast("string")).alias("url"), F.lit("world").alias("system"), F.concat(F.lit("O:"), F.col("l_orderkey").cast("string")).alias("code"))
    return VS.contains(asked, s.rules, s.tables).select("url", "code", "inside")


@query("vs_implicit", sql("""
SELECT 'all' AS url, code FROM concepts WHERE module IN ('part', 'brand', 'type') OR code = 'PART' UNION ALL SELECT 'sub', code FROM (SELECT descendant AS code FROM closure WHERE ancestor = 'R:3' UNION SELECT 'R:3')
UNION ALL SELECT DISTINCT 'mem', code FROM members WHERE active AND refset_id = 'PRI:2-HIGH' UNION ALL SELECT 'below', descendant FROM closure WHERE ancestor = 'R:3'""", "concepts", "closure", "members"))  # fmt: skip
def vs_implicit(v: Views) -> DataFrame:
    return Sets(v).expand(VS.implicit("all", "parts", url="all"), VS.implicit("subtree", "world", "R:3", "sub"), VS.implicit("members", "world", "PRI:2-HIGH", "mem"), VS.implicit("below", "world", "R:3", "below")).select("url", "code")


@query("vs_fragment_flag", sql("SELECT code, module IN ('part', 'brand', 'type') OR code = 'PART' AS provable FROM concepts", "concepts"))
def vs_fragment_flag(v: Views) -> DataFrame:
    s = Sets(v)
    return VS.fragment_flags(s.expand(VS.implicit("all", "world", url="u"), VS.implicit("all", "parts", url="u2")), s.tables.systems).select("code", "provable")


@query("vs_echo", """
SELECT 'P:' || p_partkey AS code, CASE WHEN p_size = 1 THEN upper(p_name) ELSE p_name END AS display, CASE WHEN p_size <= 3 THEN 'own ' || p_size ELSE 'size ' || p_size END AS label,
  CASE WHEN p_size <= 3 THEN p_partkey WHEN p_size <> 20 THEN p_size END AS concept_order, CASE WHEN p_size = 20 THEN 'bold' END AS style, CASE WHEN p_size = 2 THEN 'two' ELSE p_type END AS definition FROM part WHERE p_size <= 10 OR p_size = 20""")
def vs_echo(v: Views) -> DataFrame:
    """What small parts' sets state on them, and what the system states on all."""
    s, part = Sets(v), v.raw("part")
    code, size = F.concat(F.lit("P:"), F.col("p_partkey").cast("string")).alias("code"), F.col("p_size").cast("string")
    stated = part.filter("p_size <= 3").select(F.concat(F.lit("brand/"), "p_brand").alias("url"), F.lit("parts").alias("system"), code, F.concat(F.lit("own "), size).alias("label"), F.col("p_partkey").alias("concept_order"), F.when(F.col("p_size") == 2, "two").alias("definition"))
    defined = part.select(F.lit("parts").alias("system"), code, F.concat(F.lit("size "), size).alias("label"), F.when(F.col("p_size") != 20, F.col("p_size")).alias("concept_order"), F.when(F.col("p_size") == 20, "bold").alias("style"), F.col("p_type").alias("definition"))
    out = VS.with_echoes(VS.expand(s.rules.filter("url LIKE 'brand%'"), s.tables), stated, defined, definitions=True)
    return out.select("code", "display", "label", "concept_order", "style", "definition")


@query("vs_check_rules", "SELECT 'brand/' || p_brand AS url, 'include' AS side, 0 AS rule_no, 'vsd-2' AS error FROM part WHERE p_size <= 10 GROUP BY ALL UNION ALL SELECT 'brand/' || p_brand, 'include', 0, 'vsd-1' FROM part WHERE p_size <= 10 GROUP BY ALL UNION ALL SELECT 'both', 'include', 0, 'vsd-3'")
def vs_check_rules(v: Views) -> DataFrame:
    s = Sets(v)
    broken = s.rules.filter("url LIKE 'brand%' AND rule_no = 0").withColumn("system", F.lit(None).cast("string"))
    return VS.check_rules(broken.unionByName(s.literal(VS.rule("both", "include", 0, "parts", codes=["PART"], filters=[("code", "exists", "true")]))))


@query("vs_undeclared", "SELECT DISTINCT 'brand/' || p_brand AS url, 'property' AS reason FROM part UNION ALL SELECT 'nation/' || n_nationkey, 'code' FROM nation")
def vs_undeclared(v: Views) -> DataFrame:
    s = Sets(v)
    rules = s.rules.filter("filter_no = 0 AND url NOT LIKE 'region%'").withColumn("property", F.when(F.col("property") == "size", "weight").otherwise(F.col("property"))).withColumn("value", F.concat("value", F.lit("?")))
    return VS.undeclared(rules, s.tables).select("url", "reason")


@query("vs_refused", """
SELECT 'op/' || n_nationkey AS url, 0 AS rule_no, CASE n_nationkey % 7 WHEN 0 THEN 'unknown-operator' WHEN 1 THEN 'unknown-operator' WHEN 2 THEN 'unknown-code' WHEN 3 THEN 'unsupported-operator' WHEN 4 THEN 'undeclared-property' WHEN 5 THEN 'bad-value' ELSE 'unsupported-operator' END AS reason FROM nation
UNION ALL SELECT 'list', 0, 'unknown-code' FROM nation WHERE n_nationkey = 0""")
def vs_refused(v: Views) -> DataFrame:
    """A rule a nation that is refused, one with an absent code in a list, and the rules of all value sets, which are sound."""
    s, k = Sets(v), F.col("n_nationkey") % 7
    kinds = [("concept", "frobnicate", "true"), ("type", "about", "x"), ("concept", "is-a", "N:none"), ("parent", "in", "R:1"), ("weight", "=", "1"), ("type", "exists", "perhaps"), ("type", "is-a", "STANDARD")]
    chosen = F.get(F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("property", "op", "value"), f)]) for f in kinds]), k)
    rules = v.raw("nation").select(F.concat(F.lit("op/"), F.col("n_nationkey").cast("string")).alias("url"), F.lit("include").alias("side"), F.lit(0).alias("rule_no"), F.lit("parts").alias("system"), F.lit(0).alias("filter_no"), chosen.alias("f")).select("*", "f.*").drop("f")
    more = s.literal(VS.rule("list", "include", 0, "world", filters=[("code", "not-in", "N:0, N:none")]))
    return VS.refused(more.unionByName(rules, allowMissingColumns=True).unionByName(s.rules), s.tables).select("url", "rule_no", "reason")
