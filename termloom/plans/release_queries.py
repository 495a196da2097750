"""Registered queries for versions, release quality and system-specific selections, with their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions.versions import version_matches
from termloom.operators import codes as K
from termloom.operators import releases as R
from termloom.operators import systems as Y
from termloom.operators import valuesets as VS
from termloom.plans.driver_views import Views, sql
from termloom.plans.registry import query
from termloom.plans.valueset_queries import SYSTEM, Sets


def s(prefix: str, column: str):  # noqa: ANN201
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def _versions(v: Views) -> DataFrame:
    """Each customer's orders as versions year.month.key of one url."""
    o = v.raw("orders")
    return o.select(s("u", "o_custkey").alias("url"), F.concat_ws(".", F.year("o_orderdate").cast("string"), F.month("o_orderdate").cast("string"), F.col("o_orderkey").cast("string")).alias("version"))


_VERSIONS = "versions AS (SELECT 'u' || o_custkey AS url, year(o_orderdate) || '.' || month(o_orderdate) || '.' || o_orderkey AS version, year(o_orderdate) AS y, month(o_orderdate) AS m, o_orderkey AS k FROM orders)"


@query("version_order", f"WITH {_VERSIONS} SELECT url, version, row_number() OVER (PARTITION BY url ORDER BY y, m, k) AS place FROM versions")
def version_order(v: Views) -> DataFrame:
    return R.order_versions(_versions(v))


@query("version_match", f"WITH {_VERSIONS} SELECT url, version, y = 1997 AND m = 3 AS fits FROM versions")
def version_match(v: Views) -> DataFrame:
    return _versions(v).withColumn("fits", version_matches(F.col("version"), F.lit("1997.03.x")))


@query("resolve_version", f"""WITH {_VERSIONS},
asked AS (SELECT DISTINCT url, w.wanted FROM versions, (VALUES (NULL), ('1996.x.x'), ('1998.X')) w(wanted))
SELECT a.url, a.wanted, (SELECT version FROM versions v WHERE v.url = a.url AND (a.wanted IS NULL OR (a.wanted = '1996.x.x' AND y = 1996)) ORDER BY y DESC, m DESC, k DESC LIMIT 1) AS resolved FROM asked a""")
def resolve_version(v: Views) -> DataFrame:
    versions = _versions(v)
    asked = versions.select("url").distinct().withColumn("wanted", F.explode(F.array(F.lit(None).cast("string"), F.lit("1996.x.x"), F.lit("1998.X"))))
    return R.resolve_version(asked, versions)


@query("resolve_system_version", f"WITH {_VERSIONS} SELECT url, max(version) AS resolved FROM versions GROUP BY url")
def resolve_system_version(v: Views) -> DataFrame:
    versions = _versions(v)
    asked = versions.select("url").distinct().withColumn("wanted", F.lit(None).cast("string"))
    return R.resolve_version(asked, versions, kind="code-system").select("url", "resolved")


@query("layer_releases", "SELECT 'P:' || p_partkey AS code, CASE WHEN p_size > 40 THEN upper(p_name) ELSE p_name END AS display FROM part")
def layer_releases(v: Views) -> DataFrame:
    part = v.raw("part")
    base = part.select(s("P:", "p_partkey").alias("code"), F.col("p_name").alias("display"))
    upper = part.filter("p_size > 40").select(s("P:", "p_partkey").alias("code"), F.upper("p_name").alias("display"))
    return R.layer([base, upper], ["code"])


@query("apply_supplement", "SELECT 'P:' || p_partkey AS code, CASE WHEN p_size <= 10 THEN 'onderdeel ' || p_name WHEN p_size <= 25 THEN 'artículo ' || p_name ELSE p_name END AS display FROM part")
def apply_supplement(v: Views) -> DataFrame:
    """Dutch terms of a supplement for small parts; asked for Dutch, then Spanish, then English."""
    part = v.raw("part").filter("p_size <= 10")
    extra = part.select(F.concat(s("P:", "p_partkey"), F.lit("/nl")).alias("designation_id"), s("P:", "p_partkey").alias("code"), F.concat(F.lit("onderdeel "), "p_name").alias("term"), F.lit("nl").alias("language"),
                        F.lit("synonym").alias("use_code"), F.lit(True).alias("active"), F.lit("urn:nl").alias("supplement_url"))
    more = part.select(s("P:", "p_partkey").alias("code"), F.lit("colour").alias("property"), F.lit("any").alias("value_text"), F.lit("urn:nl").alias("supplement_url"))
    terms, _ = R.apply_supplement(v.designations.filter("code LIKE 'P:%'"), v.properties, extra, more, extra, ["urn:nl"])
    return K.choose_display(terms, v.acceptability, K.language_ranks("nl, es;q=0.8, en;q=0.5", ["en", "es", "nl"])).select("code", "display")


@query("revalidate_value_sets", """
SELECT 'seg/' || c_mktsegment AS url, 'O:' || o_orderkey AS code, CASE WHEN o_orderkey % 7 = 0 THEN 'unknown' WHEN o_orderkey % 11 = 0 THEN 'outside' ELSE 'inactive' END AS finding
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 OR o_orderstatus = 'F'""")
def revalidate_value_sets(v: Views) -> DataFrame:
    """Orders listed by market segment, against a release without every seventh order; every eleventh is excluded again."""
    t = Sets(v)
    orders = v.raw("orders").join(v.raw("customer").hint("merge"), F.col("o_custkey") == F.col("c_custkey"))
    head = t.literal([]).columns
    of = lambda df, side: df.select(s("seg/", "c_mktsegment").alias("url"), F.lit(side).alias("side"), F.lit(0).alias("rule_no"), F.lit("world").alias("system"), F.lit(0).alias("concept_no"), s("O:", "o_orderkey").alias("code"))
    rules = t.literal([]).unionByName(of(orders, "include"), allowMissingColumns=True).unionByName(of(orders.filter("o_orderkey % 11 = 0"), "exclude"), allowMissingColumns=True).select(*head)
    release = t.tables.concepts.filter("NOT (module = 'orders' AND CAST(substr(code, 3) AS BIGINT) % 7 = 0)")
    expansion = VS.expand(rules, replace(t.tables, concepts=release))
    return R.revalidate_value_sets(rules, release, "2", expansion).select("url", "code", "finding")


@query("revalidate_maps", sql("""
named AS (SELECT 'http://map|' || substr(code, 3, 1) AS map, code, target_code FROM map_elements WHERE map = 'part-brand')
SELECT map, 'source' AS side, code, 'unknown' AS finding FROM named WHERE code LIKE '%3'
UNION SELECT map, 'target', target_code, 'unknown' FROM named WHERE target_code LIKE '%3'""", "map_elements"))
def revalidate_maps(v: Views) -> DataFrame:
    """Maps by their names with a version after a bar."""
    elements = v.map_elements.filter("map = 'part-brand'").withColumn("source_system", F.lit("parts")).withColumn("target_system", F.lit("parts"))
    elements = elements.withColumn("map", F.concat(F.lit("http://map|"), F.substring("code", 3, 1)))
    release = Sets(v).tables.concepts.filter("code NOT LIKE '%3'")
    return R.revalidate_maps(elements, release, "2").select("map", "side", "code", "finding")


@query("feed_select", """
WITH offers AS (SELECT o_orderkey AS key, o_custkey AS id, o_orderpriority AS category, o_orderdate AS date, o_orderstatus FROM orders)
SELECT key, CASE WHEN category NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'category' WHEN id % 3 = 0 THEN 'not-subscribed' WHEN o_orderstatus = 'P' THEN 'no-content' WHEN date <= TIMESTAMP '1997-01-01' AND id % 2 = 0 THEN 'not-newer' END AS reason FROM offers""")
def feed_select(v: Views) -> DataFrame:
    o = v.raw("orders")
    offered = o.select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("category"), F.col("o_orderdate").alias("date"), F.when(F.col("o_orderstatus") != "P", "link").alias("content_link"))
    customers = v.raw("customer").select(F.col("c_custkey").alias("id"))
    held = customers.filter("id % 2 = 0").withColumn("date", F.lit("1997-01-01").cast("timestamp_ntz"))
    return R.feed_select(offered, customers.filter("id % 3 != 0"), held, ["1-URGENT", "2-HIGH", "3-MEDIUM"]).select("key", "reason")


@query("feed_unseen", "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def feed_unseen(v: Views) -> DataFrame:
    return R.feed_unseen(v.raw("customer").select(F.col("c_custkey").alias("id")), v.raw("orders").select(F.col("o_custkey").alias("id")))


@query("retain_releases", "SELECT system, version FROM (SELECT o_custkey AS system, o_orderkey AS version, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 3")
def retain_releases(v: Views) -> DataFrame:
    return R.retain_releases(v.raw("orders").select(F.col("o_custkey").alias("system"), F.col("o_orderkey").alias("version"), F.col("o_orderdate").alias("date")), 3).select("system", "version")


@query("duplicate_resources", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_resources(v: Views) -> DataFrame:
    return R.duplicate_resources(v.raw("lineitem"), ["l_orderkey", "l_linenumber"])


@query("dangling_edges", sql("SELECT child, parent, 'parent' AS missing FROM edges WHERE parent LIKE 'N:%' UNION ALL SELECT child, parent, 'child' FROM edges WHERE child LIKE 'N:%'", "edges"))
def dangling_edges(v: Views) -> DataFrame:
    return R.dangling(v.edges, v.concepts.filter("module != 'nation'"))


@query("system_stats", sql("""
SELECT 'concepts' AS name, count(*) AS n FROM concepts UNION ALL SELECT 'modules', count(DISTINCT module) FROM concepts UNION ALL SELECT 'edges', count(*) FROM edges
UNION ALL SELECT 'members', count(*) FROM members UNION ALL SELECT 'sets', count(DISTINCT refset_id) FROM members UNION ALL SELECT 'designations', count(*) FROM designations UNION ALL SELECT 'languages', count(DISTINCT language) FROM designations""", "concepts", "edges", "members", "designations"))
def system_stats(v: Views) -> DataFrame:
    tables = {"concepts": v.concepts, "edges": v.edges, "members": v.members.drop("fields"), "designations": v.designations}
    return R.system_stats(tables, {"modules": ("concepts", "module"), "sets": ("members", "refset_id"), "languages": ("designations", "language")})


@query("definition_diff", "SELECT 'P:' || p_partkey AS code, CASE WHEN p_size > 45 THEN 'removed' WHEN p_size <= 5 THEN 'added' ELSE 'changed' END AS change, CASE WHEN p_size BETWEEN 6 AND 45 THEN 'display' END AS field FROM part WHERE p_size <= 5 OR p_size > 45 OR p_size % 2 = 0")
def definition_diff(v: Views) -> DataFrame:
    p = v.raw("part")
    old = p.filter("p_size > 5").select(s("P:", "p_partkey").alias("code"), F.col("p_name").alias("display"), "p_type", F.lit(1).alias("saved"))
    new = p.filter("p_size <= 45").select(s("P:", "p_partkey").alias("code"), F.when(F.col("p_size") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("display"), "p_type", F.lit(2).alias("saved"))
    return R.definition_diff(old, new, ["code"], ignore=["saved"]).select("code", "change", F.array_join("fields", ",").alias("field"))


@query("snapshot_from_full", "SELECT o_custkey AS id, max(CAST(strftime(o_orderdate, '%Y%m%d') AS BIGINT) * 1000000 + o_orderkey) AS effective_time FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY o_custkey")
def snapshot_from_full(v: Views) -> DataFrame:
    """Orders by their date; keys of over six digits reach into the days after it, so the date alone says what is released."""
    date = F.date_format("o_orderdate", "yyyyMMdd").cast("long")
    full = v.raw("orders").select(F.col("o_custkey").alias("id"), (date * 1_000_000 + F.col("o_orderkey")).alias("effective_time"), date.alias("released"), "o_orderstatus")
    return R.snapshot_from_full(full, "id", 19971231, released="released").select("id", "effective_time")


@query("release_diff", "SELECT 'O:' || o_orderkey AS code, CASE WHEN o_orderkey % 10 = 0 THEN 'added' WHEN o_orderkey % 10 = 1 THEN 'removed' WHEN o_orderkey % 10 = 2 THEN 'moved' ELSE 'retired' END AS change FROM orders WHERE o_orderkey % 10 < 3 OR (o_orderkey % 10 > 2 AND o_orderstatus = 'F')")
def release_diff(v: Views) -> DataFrame:
    o, k = v.raw("orders"), F.col("o_orderkey") % 10
    old = o.filter(k != 0).select(s("O:", "o_orderkey").alias("code"), F.lit(True).alias("active"), F.array(s("C:", "o_custkey")).alias("parents"), F.lit("x").alias("display"))
    new = o.filter(k != 1).select(s("O:", "o_orderkey").alias("code"), ((F.col("o_orderstatus") != "F") | (k < 3)).alias("active"), F.array(F.when(k == 2, "C:none").otherwise(s("C:", "o_custkey"))).alias("parents"), F.lit("x").alias("display"))
    return R.release_diff(old, new)


# system-specific selections: parts as terms with a brand axis, line items as links


def _terms(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = v.raw("part")
    terms = p.select(s("P:", "p_partkey").alias("code"), F.col("p_type").alias("TYPE"), F.col("p_brand").alias("BRAND"))
    links = p.filter("p_size > 20").select(s("P:", "p_partkey").alias("code"), s("LP:", "p_type").alias("part"), F.lit("TYPE").alias("axis"))
    parts = p.select(s("LP:", "p_type").alias("part"), F.lower("p_type").alias("name")).distinct()
    return terms, links, parts


@query("loinc_axis_filter", "SELECT 'P:' || p_partkey AS code FROM part WHERE (p_size > 20 AND p_type IN ('STANDARD', 'SMALL')) OR p_type = 'PROMO'")
def loinc_axis_filter(v: Views) -> DataFrame:
    terms, links, parts = _terms(v)
    return Y.axis_filter(terms, links, parts, "TYPE", "in", ["LP:STANDARD", "small", "PROMO"])


@query("loinc_part_filter", sql("SELECT descendant AS code FROM closure WHERE ancestor = 'R:2' UNION SELECT child FROM edges WHERE parent = 'R:1'", "closure"))
def loinc_part_filter(v: Views) -> DataFrame:
    parts = v.concepts.select(F.col("code").alias("part"), F.col("display").alias("name"))
    name = v.raw("region").filter("r_regionkey = 2").first()["r_name"]
    return Y.part_filter(v.edges, v.closure, parts, "ancestor", name).union(Y.part_filter(v.edges, v.closure, parts, "parent", "R:1")).distinct()


@query("loinc_answers", "SELECT DISTINCT 'O:' || o_orderkey AS code, 'P:' || l_partkey AS answer, l_linenumber AS sequence FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'")
def loinc_answers(v: Views) -> DataFrame:
    lists = v.raw("orders").select(s("O:", "o_orderkey").alias("code"), s("L:", "o_orderkey").alias("list"))
    answers = v.raw("lineitem").select(s("L:", "l_orderkey").alias("list"), s("P:", "l_partkey").alias("answer"), F.col("l_linenumber").alias("sequence"))
    return Y.answers_of(lists, answers, v.raw("orders").filter("o_orderstatus = 'P'").select(s("O:", "o_orderkey").alias("code")))


@query("loinc_document_axis", "SELECT 'P:' || p_partkey AS code FROM part WHERE p_size > 20 AND p_type = 'STANDARD'")
def loinc_document_axis(v: Views) -> DataFrame:
    _, links, parts = _terms(v)
    return Y.document_axis(links, parts, ["TYPE"], "standard")


@query("loinc_status", "SELECT 'O:' || o_orderkey AS code FROM orders WHERE o_orderstatus <> 'F'")
def loinc_status(v: Views) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "deprecated").when(F.col("o_orderstatus") == "O", "ACTIVE")
    return v.raw("orders").filter(Y.status_active(status)).select(s("O:", "o_orderkey").alias("code"))


@query("rxnorm_atom_rank", """
SELECT concept, atom, place FROM (SELECT l_orderkey AS concept, l_partkey * 10 + l_linenumber AS atom, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_returnflag = 'R' THEN l_linenumber ELSE 18 END,
  l_returnflag, tty, p_name, l_partkey * 10 + l_linenumber) AS place FROM (SELECT *, CASE l_linenumber WHEN 1 THEN 'SCD' WHEN 2 THEN 'SBD' WHEN 3 THEN 'GPCK' WHEN 4 THEN 'BPCK' WHEN 5 THEN 'SCDG' WHEN 6 THEN 'SBDG' ELSE 'SCDF' END AS tty FROM lineitem JOIN part ON l_partkey = p_partkey)) WHERE place <= 2""")
def rxnorm_atom_rank(v: Views) -> DataFrame:
    tty = F.get(F.array(*[F.lit(t) for t in Y.TERM_TYPES]), F.col("l_linenumber").cast("int") - 1)
    atoms = v.raw("lineitem").join(v.raw("part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("concept"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("atom"), F.col("l_returnflag").alias("source"), tty.alias("type"), F.col("p_name").alias("name"))
    return Y.rank_atoms(atoms, "R").filter("place <= 2").select("concept", "atom", "place")


@query("rxnorm_relations", "SELECT DISTINCT 'P:' || l_partkey AS source, kind, 'S:' || l_suppkey AS target FROM lineitem, (VALUES ('RB'), ('supplied_by')) k(kind) WHERE l_returnflag = 'A' AND (kind = 'RB' OR l_linenumber > 2)")
def rxnorm_relations(v: Views) -> DataFrame:
    """Some ends are given as atoms, which stand for their concepts."""
    line = v.raw("lineitem")
    null = F.lit(None).cast("string")
    by_atom = F.col("l_partkey") % 2 == 0
    rel = line.select(s("S:", "l_suppkey").alias("concept1"), null.alias("atom1"), F.when(~by_atom, s("P:", "l_partkey")).alias("concept2"), F.when(by_atom, s("A:", "l_partkey")).alias("atom2"), F.lit("RB").alias("rel"),
                      F.when(F.col("l_linenumber") > 2, "supplied_by").alias("rela"), F.col("l_returnflag").alias("source_name"))
    atoms = v.raw("part").select(s("A:", "p_partkey").alias("atom"), s("P:", "p_partkey").alias("concept"))
    return Y.atom_relations(rel, atoms, "A")


@query("rxnorm_relation_filter", sql("SELECT DISTINCT source AS code FROM attributes WHERE kind = 'has_supplier' AND target = 'S:3'", "attributes"))
def rxnorm_relation_filter(v: Views) -> DataFrame:
    atoms = v.raw("supplier").select(s("A:", "s_suppkey").alias("atom"), s("S:", "s_suppkey").alias("concept"))
    return Y.relation_filter(v.attributes.filter("target IS NOT NULL"), atoms, "has_supplier", "A:3")


@query("rxnorm_indexed_filter", sql("SELECT code FROM properties WHERE property = 'type' AND value_text IN ('PROMO', 'ECONOMY')", "properties"))
def rxnorm_indexed_filter(v: Views) -> DataFrame:
    return Y.indexed_filter(v.properties.select("code", F.col("property").alias("name"), F.col("value_text").alias("value")), "type", ["PROMO", "ECONOMY"])


@query("longest_prefix_parent", """
WITH known AS (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS code FROM orders WHERE o_orderkey % 3 = 0), fresh AS (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) || '.X' AS code, CAST(o_orderkey AS VARCHAR) AS bare FROM orders WHERE o_orderkey % 2 = 1)
SELECT f.code, (SELECT k.code FROM known k WHERE starts_with(f.bare, k.code) ORDER BY length(k.code) DESC LIMIT 1) AS parent FROM fresh f""")
def longest_prefix_parent(v: Views) -> DataFrame:
    o = v.raw("orders").select("o_orderkey").distinct()
    return Y.longest_prefix_parent(o.filter("o_orderkey % 2 = 1").select(F.concat(F.col("o_orderkey").cast("string"), F.lit(".X")).alias("code")), o.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").cast("string").alias("code")))


@query("prefix_level_parent", """
WITH codes AS (SELECT DISTINCT substr(lpad(CAST(c_custkey AS VARCHAR), 7, '0'), 1, n) AS code FROM customer, (VALUES (3), (4), (5), (7)) t(n) WHERE NOT (n = 5 AND c_custkey % 2 = 0)),
leveled AS (SELECT code, CASE length(code) WHEN 3 THEN 2 WHEN 4 THEN 3 WHEN 5 THEN 4 WHEN 7 THEN 5 END AS level, substr(code, 1, CASE length(code) WHEN 3 THEN 1 WHEN 4 THEN 3 WHEN 5 THEN 4 WHEN 7 THEN 5 END) AS parent FROM codes)
SELECT code, level, parent, parent NOT IN (SELECT code FROM codes) AS missing FROM leveled""")
def prefix_level_parent(v: Views) -> DataFrame:
    n = F.explode(F.array(F.lit(3), F.lit(4), F.lit(5), F.lit(7))).alias("n")
    codes = v.raw("customer").select("c_custkey", n).filter("NOT (n = 5 AND c_custkey % 2 = 0)").select(F.substring(F.lpad(F.col("c_custkey").cast("string"), 7, "0"), F.lit(1), F.col("n")).alias("code"))
    return Y.prefix_level_parent(codes)


@query("expand_modifiers", """
SELECT p_brand || '/' || m.t AS code, p_brand AS parent, 'Brand ' || p_brand || ', ' || lower(m.t) AS title FROM (SELECT DISTINCT p_brand FROM part) b, (SELECT DISTINCT p_type AS t FROM part) m
WHERE NOT EXISTS (SELECT 1 FROM part WHERE part.p_brand = b.p_brand AND p_type = m.t AND p_size = 7)""")
def expand_modifiers(v: Views) -> DataFrame:
    p = v.raw("part")
    brands = p.select(F.col("p_brand").alias("code"), F.concat(F.lit("Brand "), "p_brand").alias("title")).distinct()
    kinds = p.select(F.lit("type").alias("modifier"), F.concat(F.lit("/"), "p_type").alias("suffix"), F.lower("p_type").alias("title")).distinct()
    gone = p.filter("p_size = 7").select(F.col("p_brand").alias("code"), F.concat(F.lit("/"), "p_type").alias("suffix"))
    return Y.expand_modifiers(brands, brands.select("code", F.lit("type").alias("modifier")), kinds, gone)


@query("icd10cm_merge", "SELECT 'P:' || p_partkey AS code, CASE WHEN p_size > 10 THEN p_name ELSE 'long ' || p_name END AS title, CASE WHEN p_size <= 30 THEN upper(p_name) END AS short, p_size <= 30 AND p_size % 2 = 0 AS valid, p_size <= 10 AS new FROM part")
def icd10cm_merge(v: Views) -> DataFrame:
    p, code = v.raw("part"), s("P:", "p_partkey").alias("code")
    tabular = p.filter("p_size > 10").select(code, F.col("p_name").alias("title"))
    order = p.filter("p_size <= 30").select(code, (F.col("p_size") % 2 == 1).alias("header"), F.upper("p_name").alias("short"), F.concat(F.lit("long "), "p_name").alias("long"))
    return Y.merge_order(tabular, order)


@query("ladder_rollup", "SELECT 'O:' || o_orderkey AS code, 'C:' || o_custkey AS rung1, 'N:' || c_nationkey AS rung2, 'R:' || n_regionkey AS rung3 FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def ladder_rollup(v: Views) -> DataFrame:
    level = lambda t, p, k, q, up: v.raw(t).select(s(p, k).alias("code"), s(q, up).alias("parent"))
    return Y.ladder([level("orders", "O:", "o_orderkey", "C:", "o_custkey"), level("customer", "C:", "c_custkey", "N:", "c_nationkey"), level("nation", "N:", "n_nationkey", "R:", "n_regionkey")])


@query("axis_value_check", """
SELECT o_orderkey AS id, CASE WHEN n_regionkey = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'second' ELSE 'first' END WHEN n_regionkey = 1 THEN 'second' END AS axis FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def axis_value_check(v: Views) -> DataFrame:
    """Customers as values below regions; even orders have filled the first axis already."""
    scales = v.spark.createDataFrame([("stem", "first", True, 0, "R:0"), ("stem", "second", False, 1, "R:0"), ("stem", "second", False, 1, "R:1")], "stem string, axis string, required boolean, declared int, entity string")
    asked = v.raw("orders").select(F.col("o_orderkey").alias("id"), F.lit("stem").alias("stem"), s("C:", "o_custkey").alias("value"), F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("first"))).otherwise(F.array().cast("array<string>")).alias("filled"))
    return Y.axis_value_check(asked, scales, v.closure).select("id", "axis")


@query("normal_form_table", sql("""
pairs AS (SELECT source, role_group, kind || '=' || coalesce(target, '#' || printf('%.2f', number), '"' || text || '"') AS pair FROM attributes),
groups AS (SELECT source, role_group, string_agg(pair, ',' ORDER BY pair) AS t FROM pairs GROUP BY ALL),
per AS (SELECT source AS code, max(t) FILTER (role_group = 0) AS plain, string_agg('{' || t || '}', ',' ORDER BY '{' || t || '}') FILTER (role_group <> 0) AS braced FROM groups GROUP BY source),
up AS (SELECT child AS code, string_agg(DISTINCT parent, '+' ORDER BY parent) AS u FROM edges GROUP BY child)
SELECT code, concat_ws(':', u, nullif(concat_ws(',', plain, braced), '')) AS form FROM up FULL JOIN per USING (code)""", "attributes", "edges"))
def normal_form_table(v: Views) -> DataFrame:
    return Y.normal_form_table(v.edges, v.attributes)


@query("normal_form_terms", sql("""
named AS (SELECT code, any_value(display) AS display FROM concepts GROUP BY code),
pairs AS (SELECT source, role_group, kind || '=' || coalesce(target, '#' || printf('%.2f', number), '"' || text || '"') AS o,
  kind || '=' || coalesce(target || coalesce(' |' || display || '|', ''), '#' || printf('%.2f', number), '"' || text || '"') AS pair FROM attributes LEFT JOIN named ON code = target),
groups AS (SELECT source, role_group, string_agg(pair, ',' ORDER BY o, pair) AS t, string_agg(o, ',' ORDER BY o) AS o FROM pairs GROUP BY ALL),
per AS (SELECT source AS code, max(t) FILTER (role_group = 0) AS plain, string_agg('{' || t || '}', ',' ORDER BY '{' || o || '}', '{' || t || '}') FILTER (role_group <> 0) AS braced FROM groups GROUP BY source),
up AS (SELECT child AS code, string_agg(parent || ' |' || display || '|', '+' ORDER BY parent) AS u FROM (SELECT DISTINCT child, parent FROM edges) JOIN named ON code = parent GROUP BY child)
SELECT code, concat_ws(':', u, nullif(concat_ws(',', plain, braced), '')) AS form FROM up FULL JOIN per USING (code)""", "concepts", "attributes", "edges"))
def normal_form_terms(v: Views) -> DataFrame:
    """The forms with the terms of parents and targets."""
    return Y.normal_form_table(v.edges, v.attributes, v.concepts)


@query("classification_properties", sql("SELECT code, max(value_text) FILTER (property = 'brand') AS usage, max(value_text) FILTER (property = 'type') AS kind FROM properties GROUP BY code", "properties"))
def classification_properties(v: Views) -> DataFrame:
    return v.properties.groupBy("code").pivot("property", ["brand", "type"]).agg(F.max("value_text")).select("code", F.col("brand").alias("usage"), F.col("type").alias("kind"))


@query("fhir_status", "SELECT 'P:' || p_partkey AS code, p_size % 3 = 0 OR p_size % 5 = 0 AS inactive, p_type = 'PROMO' AS not_selectable FROM part")
def fhir_status(v: Views) -> DataFrame:
    p, code = v.raw("part"), s("P:", "p_partkey").alias("code")
    row = lambda test, name, value: p.filter(test).select(code, F.lit(name).alias("property"), F.lit(value).alias("value_text"))
    props = row("p_size % 3 = 0", "inactive", "true").unionByName(row("p_size % 5 = 0", "status", "retired")).unionByName(row("p_type = 'PROMO'", "notSelectable", "true"))
    return Y.resource_status(props, p.select(code))


@query("identifier_audit", """
WITH ids AS (SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN '0' || o_orderkey ELSE CAST(o_orderkey + 100000000 AS VARCHAR) || '00x' END AS id FROM orders)
SELECT CASE WHEN o_orderkey % 6 = 0 THEN 'leading-zero' ELSE 'not-digits' END AS reason, count(*) AS n FROM ids GROUP BY ALL""")
def identifier_audit(v: Views) -> DataFrame:
    k = F.col("o_orderkey")
    ids = v.raw("orders").select(F.when(k % 6 == 0, F.concat(F.lit("0"), k.cast("string"))).otherwise(F.concat((k + 100_000_000).cast("string"), F.lit("00x"))).alias("id"))
    return Y.identifier_audit(ids)


@query("identify_edition", """
WITH roots AS (SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS t, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey || '1000005109' ELSE o_orderkey || '00' || '9' END AS module FROM orders)
SELECT module, t AS effective_time, module LIKE '%1000005109' AS namespaced, coalesce(module = (SELECT min(module) FROM roots WHERE module LIKE '%1000005109' AND t = (SELECT max(t) FROM roots WHERE o_orderkey % 2 = 0)), false) AS picked FROM roots""")
def identify_edition(v: Views) -> DataFrame:
    """Orders as modules that depend on their customer's, and those on the core; every second has a namespace, and of these the one of the release date names the edition."""
    time, key = F.date_format("o_orderdate", "yyyyMMdd").cast("int"), F.col("o_orderkey").cast("string")
    o = v.raw("orders").withColumn("module", F.when(F.col("o_orderkey") % 2 == 0, F.concat(key, F.lit("1000005109"))).otherwise(F.concat(key, F.lit("009"))))
    deps = o.select("module", time.alias("source_time"), s("C:", "o_custkey").alias("target"), time.alias("target_time"))
    core = o.select(s("C:", "o_custkey").alias("module"), time.alias("source_time"), F.lit("CORE").alias("target"), time.alias("target_time"))
    return Y.identify_edition(deps.unionByName(core), "CORE", o.filter("o_orderkey % 2 = 0").agg(F.max(time)).first()[0])


@query("check_layer", "SELECT o_orderkey AS module, CASE WHEN o_custkey % 4 = 0 THEN 'missing' WHEN o_orderdate > TIMESTAMP '1998-01-01' THEN 'older' ELSE 'met' END AS outcome FROM orders")
def check_layer(v: Views) -> DataFrame:
    needs = v.raw("orders").select(F.col("o_orderkey").alias("module"), F.col("o_custkey").alias("target"), F.col("o_orderdate").alias("target_time"))
    edition = v.raw("customer").filter("c_custkey % 4 != 0").select(F.col("c_custkey").alias("module"), F.lit("1998-01-01").cast("timestamp_ntz").alias("effective_time"))
    return Y.check_layer(needs, edition).select("module", "outcome")
