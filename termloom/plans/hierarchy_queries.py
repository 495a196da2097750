"""Registered queries over hierarchies and sets of concepts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.operators import concepts as C
from termloom.operators import constraints as CS
from termloom.operators import hierarchy as H
from termloom.operators.concepts import AttributeTest as A
from termloom.operators.concepts import DescriptionTest as D
from termloom.plans.driver_views import SQL, Views, sql
from termloom.plans.registry import query

ASIA = "SELECT descendant AS code FROM closure WHERE ancestor = 'R:2'"


@query("transitive_closure", sql("SELECT descendant, ancestor, min_depth FROM closure", "closure"))
def transitive_closure(v: Views) -> DataFrame:
    return v.closure


def _looped(v: Views) -> DataFrame:
    """The edges and one from every region to a customer of each of its nations' first orders: cycles over real keys."""
    extra = v.raw("customer").filter("c_custkey % 50 = 7").select(F.concat(F.lit("N:"), F.col("c_nationkey").cast("string")).alias("child"), F.concat(F.lit("C:"), F.col("c_custkey").cast("string")).alias("parent"))
    return v.edges.unionByName(extra)


@query("detect_cycles", sql("""
looped AS (SELECT * FROM edges UNION ALL SELECT 'N:' || c_nationkey, 'C:' || c_custkey FROM customer WHERE c_custkey % 50 = 7),
onc AS (SELECT DISTINCT 'N:' || c_nationkey AS node FROM customer WHERE c_custkey % 50 = 7),
below AS (SELECT node FROM onc UNION SELECT l.child FROM looped l JOIN below b ON l.parent = b.node)
SELECT DISTINCT node FROM below""", "edges"))  # fmt: skip
def detect_cycles(v: Views) -> DataFrame:
    return H.detect_cycles(_looped(v))


@query("roots", sql("SELECT code FROM concepts WHERE code NOT IN (SELECT child FROM edges)", "concepts", "edges"))
def roots(v: Views) -> DataFrame:
    return H.roots(v.concepts, v.edges)


@query("leaves", sql("SELECT code FROM concepts WHERE code NOT IN (SELECT parent FROM edges)", "concepts", "edges"))
def leaves(v: Views) -> DataFrame:
    return H.leaves(v.concepts, v.edges)


@query("children", sql("SELECT DISTINCT child AS code FROM edges WHERE parent LIKE 'N:%'", "edges"))
def children(v: Views) -> DataFrame:
    return H.children(v.concepts.filter("module = 'nation'"), v.edges)


@query("parents", sql("SELECT DISTINCT parent AS code FROM edges WHERE child LIKE 'O:%'", "edges"))
def parents(v: Views) -> DataFrame:
    return H.parents(v.concepts.filter("module = 'orders'"), v.edges)


@query("descendants", sql("SELECT DISTINCT descendant AS code FROM closure WHERE ancestor IN ('R:1', 'T:STANDARD') UNION SELECT 'R:1'", "closure"))
def descendants(v: Views) -> DataFrame:
    return C.either(H.descendants(v.code("R:1"), v.closure, True), H.descendants(v.code("T:STANDARD"), v.closure))


@query("ancestors", sql("SELECT DISTINCT ancestor AS code FROM closure JOIN concepts ON descendant = code WHERE NOT active UNION SELECT code FROM concepts WHERE NOT active", "closure", "concepts"))
def ancestors(v: Views) -> DataFrame:
    return H.ancestors(v.concepts.filter("NOT active"), v.closure, True)


_PAIRS = """
pairs AS (SELECT 'O:' || l_orderkey AS a, 'C:' || (l_partkey % 100) AS b FROM lineitem UNION ALL SELECT 'C:' || o_custkey, 'O:' || o_orderkey FROM orders UNION ALL SELECT 'N:' || n_nationkey, 'N:' || n_nationkey FROM nation)"""
_OUTCOMES = """
outcomes AS (SELECT a, b, CASE WHEN a = b THEN 'equivalent' WHEN x.ancestor IS NOT NULL THEN 'subsumes' WHEN y.ancestor IS NOT NULL THEN 'subsumed-by' ELSE 'not-subsumed' END AS outcome
  FROM pairs LEFT JOIN closure x ON x.descendant = b AND x.ancestor = a LEFT JOIN closure y ON y.descendant = a AND y.ancestor = b)
SELECT * FROM outcomes"""


def _pairs(v: Views) -> DataFrame:
    s = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    return (
        v.raw("lineitem").select(s("O:", F.col("l_orderkey")).alias("a"), s("C:", F.col("l_partkey") % 100).alias("b"))
        .unionByName(v.raw("orders").select(s("C:", F.col("o_custkey")).alias("a"), s("O:", F.col("o_orderkey")).alias("b")))
        .unionByName(v.raw("nation").select(s("N:", F.col("n_nationkey")).alias("a"), s("N:", F.col("n_nationkey")).alias("b")))
    )


@query("subsumes_pairs", sql(f"{_PAIRS}, {_OUTCOMES}", "closure"))
def subsumes_pairs(v: Views) -> DataFrame:
    return H.subsumes_pairs(_pairs(v), v.closure)


@query("any_parent_in", sql("""
chosen AS (SELECT code FROM concepts WHERE module IN ('nation', 'customer', 'part'))
SELECT DISTINCT child AS code FROM edges WHERE child IN (SELECT code FROM chosen) AND parent IN (SELECT code FROM chosen)""", "concepts", "edges"))  # fmt: skip
def any_parent_in(v: Views) -> DataFrame:
    return H.any_parent_in(v.concepts.filter(F.col("module").isin("nation", "customer", "part")), v.edges)


@query("descendant_leaves", sql("SELECT DISTINCT descendant AS code FROM closure WHERE ancestor IN ('R:0', 'PART') AND descendant NOT IN (SELECT parent FROM edges)", "closure"))
def descendant_leaves(v: Views) -> DataFrame:
    return H.descendant_leaves(v.code("R:0", "PART"), v.closure, v.edges)


@query("rollup_counts", sql("""
facts AS (SELECT 'O:' || l_orderkey AS code, l_extendedprice * (1 - l_discount) AS revenue, l_quantity AS quantity FROM lineitem),
up AS (SELECT descendant, ancestor FROM closure UNION SELECT code, code FROM facts)
SELECT ancestor AS code, count(*) AS n, sum(revenue) AS revenue, sum(quantity) AS quantity FROM facts JOIN up ON facts.code = up.descendant GROUP BY ancestor""", "closure"))  # fmt: skip
def rollup_counts(v: Views) -> DataFrame:
    facts = v.raw("lineitem").withColumn("code", F.concat(F.lit("O:"), F.col("l_orderkey").cast("string")))
    return H.rollup_counts(facts, v.closure, "code", {"revenue": F.col("l_extendedprice") * (1 - F.col("l_discount")), "quantity": F.col("l_quantity")})


_WALK = """
inside AS (SELECT DISTINCT child, parent FROM edges),
walk AS (SELECT code, [code] AS path FROM concepts WHERE code NOT IN (SELECT child FROM inside) UNION ALL SELECT i.child, list_append(w.path, i.child) FROM walk w JOIN inside i ON i.parent = w.code),
firsts AS (SELECT code, min(path) AS path FROM walk GROUP BY code),
placed AS (SELECT code, len(path) - 1 AS depth, row_number() OVER (ORDER BY path) - 1 AS place, count(*) OVER () AS total FROM firsts)"""


@query("preorder_page", sql(f"{_WALK} SELECT place, code, depth, total FROM placed WHERE place >= total * 2 // 3 AND place < total * 2 // 3 + 100", "concepts", "edges"))
def preorder_page(v: Views) -> DataFrame:
    """A page deep inside the walk over all modules."""
    return H.preorder_page(v.concepts, v.edges, v.concepts.count() * 2 // 3, 100)


@query("preorder_numbers", sql(f"{_WALK} SELECT code, place, place + (SELECT count(*) FROM firsts f WHERE list_contains(f.path, p.code)) - 1 AS last FROM placed p", "concepts", "edges"))
def preorder_numbers(v: Views) -> DataFrame:
    """Every code's place in the walk, and the last place below it."""
    return H.preorder_numbers(v.concepts, v.edges)


@query("subsumes_labels", sql(f"{_PAIRS}, {_OUTCOMES}", "closure"))
def subsumes_labels(v: Views) -> DataFrame:
    """Subsumption as a range test on interval labels, without the closure."""
    return H.subsumes_by_labels(_pairs(v), *H.interval_labels(v.concepts, v.edges))


@query("subsumes_versions", """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'refused' WHEN o_orderkey % 3 = 1 AND o_orderkey % 5 = 0 THEN 'refused' ELSE 'subsumes' END AS outcome FROM orders""")
def subsumes_versions(v: Views) -> DataFrame:
    """Pairs of two versions of a system, or of two systems, are refused."""
    k = F.col("o_orderkey")
    pairs = v.raw("orders").select(
        k.alias("id"), F.concat(F.lit("C:"), F.col("o_custkey").cast("string")).alias("a"), F.concat(F.lit("O:"), k.cast("string")).alias("b"), F.lit("world").alias("system_a"), F.when((k % 3 == 1) & (k % 5 == 0), "parts").otherwise("world").alias("system_b"),
        F.when(k % 3 != 2, "1").alias("version_a"), F.when(k % 3 == 0, "2").otherwise("1").alias("version_b"),
    )
    return H.subsumes_pairs(pairs, v.closure).select("id", "outcome")


_CHANGES = """
removed AS (SELECT child, parent FROM edges WHERE child LIKE 'C:%0' OR (child LIKE 'O:%77' AND parent LIKE 'C:%') OR (child LIKE 'P:%3' AND parent LIKE 'T:%') OR (child = 'R:4' AND parent = 'WORLD')),
added AS (SELECT code AS child, 'N:7' AS parent FROM concepts WHERE code LIKE 'C:%0' UNION ALL SELECT code, 'S:1' FROM concepts WHERE code LIKE 'O:%77' UNION ALL SELECT 'R:4', 'R:3' UNION ALL SELECT code, 'PART' FROM concepts WHERE code LIKE 'P:%99' UNION ALL SELECT 'B:Brand#11', 'T:STANDARD')"""


@query("closure_maintained", f"""WITH RECURSIVE concepts AS ({SQL['concepts']}), edges AS ({SQL['edges']}), {_CHANGES},
after_edges AS (SELECT * FROM edges EXCEPT SELECT * FROM removed UNION SELECT * FROM added),
walks AS (SELECT child AS descendant, parent AS ancestor, 1 AS depth FROM after_edges UNION SELECT w.descendant, e.parent, w.depth + 1 FROM walks w JOIN after_edges e ON w.ancestor = e.child)
SELECT descendant, ancestor, min(depth) AS min_depth FROM walks GROUP BY ALL""")
def closure_maintained(v: Views) -> DataFrame:
    """All modules after customers, orders, parts and a region have moved: the closure before, changed where the edges were."""
    code = lambda pattern: v.concepts.filter(F.col("code").like(pattern)).select(F.col("code").alias("child"))
    removed = v.edges.filter("child LIKE 'C:%0' OR (child LIKE 'O:%77' AND parent LIKE 'C:%') OR (child LIKE 'P:%3' AND parent LIKE 'T:%') OR (child = 'R:4' AND parent = 'WORLD')")
    moved = v.spark.sql("SELECT * FROM VALUES ('R:4', 'R:3'), ('B:Brand#11', 'T:STANDARD') AS t(child, parent)")
    added = code("C:%0").withColumn("parent", F.lit("N:7")).unionByName(code("O:%77").withColumn("parent", F.lit("S:1"))).unionByName(code("P:%99").withColumn("parent", F.lit("PART"))).unionByName(moved)
    return H.maintain_closure(v.closure, v.edges, added, removed)[0]


_OF = "CASE WHEN {0} LIKE 'P:%' OR {0} LIKE 'B:%' OR {0} LIKE 'T:%' OR {0} = 'PART' THEN 'parts' ELSE 'world' END".format


@query("closure_delta", sql(f"""
held AS (SELECT code, code AS own FROM concepts WHERE module IN ('region', 'customer', 'orders', 'part')),
fresh AS (SELECT code, code AS own FROM concepts WHERE module IN ('nation', 'brand', 'type', 'root', 'supplier') UNION ALL SELECT lower(code), code FROM concepts WHERE module = 'customer' AND code LIKE '%5'),
everyone AS (SELECT *, false AS is_new FROM held UNION ALL SELECT *, true FROM fresh)
SELECT {_OF('d.code')} AS system, d.code AS source, a.code AS target, 'specializes' AS relation FROM closure JOIN everyone d ON d.own = descendant JOIN everyone a ON a.own = ancestor WHERE d.is_new OR a.is_new
UNION ALL SELECT 'world', f.code, h.code, 'equal' FROM fresh f JOIN held h ON h.own = f.own""", "concepts", "closure"))  # fmt: skip
def closure_delta(v: Views) -> DataFrame:
    """All modules, in two systems; some customers come once more in another case, which their system does not mind."""
    of = lambda c: F.expr(_OF(c)).alias("system")
    concepts = v.concepts.select(of("code"), "code", "module")
    held = concepts.filter("module IN ('region', 'customer', 'orders', 'part')")
    again = concepts.filter("module = 'customer' AND code LIKE '%5'").withColumn("code", F.lower("code"))
    new = concepts.filter("module IN ('region', 'nation', 'brand', 'type', 'root', 'supplier')").unionByName(again)
    systems = v.spark.sql("SELECT * FROM VALUES ('parts', true), ('world', false) AS t(system, case_sensitive)")
    return H.closure_delta(held, new, v.closure.withColumn("system", of("descendant")), concepts, systems)


@query("closure_table_versions", sql("""
named AS (SELECT code, CASE WHEN module IN ('region', 'part') THEN 1 WHEN module IN ('nation', 'brand') THEN 2 WHEN module IN ('customer', 'type') THEN 3 WHEN module = 'orders' THEN 4 ELSE 5 END AS version FROM concepts)
SELECT descendant AS source, ancestor AS target, 'specializes' AS relation, greatest(a.version, b.version) AS version
FROM closure JOIN named a ON a.code = descendant JOIN named b ON b.code = ancestor WHERE greatest(a.version, b.version) > 1""", "concepts", "closure"))  # fmt: skip
def closure_table_versions(v: Views) -> DataFrame:
    t = H.ClosureTable.init(v.closure, "1")
    for modules in (["region", "part"], ["nation", "brand"], ["nation"], ["customer", "type"], ["orders"], ["supplier", "root"]):
        t = t.extend(v.concepts.filter(F.col("module").isin(modules)), v.closure, "1")
    return t.since(1)


@query("ecl_self", sql("SELECT code FROM concepts WHERE code IN ('C:1', 'O:1', 'PART')", "concepts"))
def ecl_self(v: Views) -> DataFrame:
    return C.self_of(v.concepts, ["C:1", "O:1", "PART"], strict=False)


@query("ecl_any", sql("SELECT DISTINCT code FROM concepts", "concepts"))
def ecl_any(v: Views) -> DataFrame:
    return C.any_of(v.concepts)


@query("ecl_alt_identifier", "SELECT 'C:' || c_custkey AS code FROM customer WHERE c_name = (SELECT max(c_name) FROM customer)")
def ecl_alt_identifier(v: Views) -> DataFrame:
    identifiers = v.raw("customer").select(F.lit("NAME").alias("scheme"), F.col("c_name").alias("alt_code"), F.concat(F.lit("C:"), F.col("c_custkey").cast("string")).alias("code"))
    aliases = v.spark.createDataFrame([("NAME", "Customer Name")], "scheme string, term string")
    return C.by_alternate(identifiers, aliases, "CUSTOMER name", v.raw("customer").agg(F.max("c_name")).first()[0])


@query("ecl_descendant_of", sql(f"{ASIA} UNION SELECT 'R:2'", "closure"))
def ecl_descendant_of(v: Views) -> DataFrame:
    return v.terminology.concept("R:2").descendants(or_self=True).df


@query("ecl_child_of", sql("SELECT DISTINCT child AS code FROM edges WHERE parent IN ('PART', 'R:1') UNION SELECT 'R:1' UNION SELECT 'PART'", "edges"))
def ecl_child_of(v: Views) -> DataFrame:
    return v.terminology.concept("PART", "R:1").children(or_self=True).df


@query("ecl_ancestor_of", sql("SELECT DISTINCT ancestor AS code FROM closure WHERE descendant LIKE 'P:%'", "closure"))
def ecl_ancestor_of(v: Views) -> DataFrame:
    return H.ancestors(v.concepts.filter("module = 'part'"), v.closure)


@query("ecl_parent_of", sql("SELECT DISTINCT parent AS code FROM edges WHERE child LIKE 'P:%' OR child LIKE 'S:%'", "edges"))
def ecl_parent_of(v: Views) -> DataFrame:
    return H.parents(v.concepts.filter("module IN ('part', 'supplier')"), v.edges)


_MIXED = "mixed AS (SELECT code FROM concepts WHERE module IN ('nation', 'orders', 'part', 'type'))"


@query("ecl_top", sql(f"{_MIXED} SELECT code FROM mixed WHERE code NOT IN (SELECT descendant FROM closure WHERE ancestor IN (SELECT code FROM mixed))", "concepts", "closure"))
def ecl_top(v: Views) -> DataFrame:
    return C.top_of(v.concepts.filter("module IN ('nation', 'orders', 'part', 'type')"), v.closure)


@query("ecl_bottom", sql(f"{_MIXED} SELECT code FROM mixed WHERE code NOT IN (SELECT ancestor FROM closure WHERE descendant IN (SELECT code FROM mixed))", "concepts", "closure"))
def ecl_bottom(v: Views) -> DataFrame:
    return C.bottom_of(v.concepts.filter("module IN ('nation', 'orders', 'part', 'type')"), v.closure)


@query("ecl_over_all", sql("SELECT code FROM concepts WHERE code IN (SELECT parent FROM edges)", "concepts", "edges"))
def ecl_over_all(v: Views) -> DataFrame:
    return C.over_all(v.concepts, v.edges, "ancestors")


@query("ecl_and", sql(f"SELECT code FROM ({ASIA}) WHERE code IN (SELECT code FROM concepts WHERE NOT active)", "concepts", "closure"))
def ecl_and(v: Views) -> DataFrame:
    return C.both(H.descendants(v.code("R:2"), v.closure), v.concepts.filter("NOT active"))


@query("ecl_or", sql(f"SELECT code FROM ({ASIA}) UNION SELECT code FROM concepts WHERE module = 'brand'", "concepts", "closure"))
def ecl_or(v: Views) -> DataFrame:
    return C.either(H.descendants(v.code("R:2"), v.closure), v.concepts.filter("module = 'brand'"))


@query("ecl_minus", sql(f"SELECT code FROM ({ASIA}) EXCEPT SELECT code FROM concepts WHERE NOT active", "concepts", "closure"))
def ecl_minus(v: Views) -> DataFrame:
    return C.minus(H.descendants(v.code("R:2"), v.closure), v.concepts.filter("NOT active"))


@query("ecl_dotted", sql("""
SELECT DISTINCT target AS code FROM attributes WHERE kind = 'has_part' AND source IN (SELECT code FROM concepts WHERE NOT active)""", "concepts", "attributes"))  # fmt: skip
def ecl_dotted(v: Views) -> DataFrame:
    return C.dotted(v.concepts.filter("NOT active"), v.attributes, [v.code("has_part")])


@query("ecl_member_of", sql("SELECT DISTINCT code FROM members WHERE active AND refset_id LIKE 'SEG:B%'", "members"))
def ecl_member_of(v: Views) -> DataFrame:
    return C.member_of(v.refset_concepts.filter("code LIKE 'SEG:B%'"), v.members)


@query("ecl_member_fields", sql("SELECT DISTINCT targetComponentId AS code FROM members WHERE active AND refset_id = 'PRI:1-URGENT' AND targetComponentId IN (SELECT code FROM concepts)", "members", "concepts"))
def ecl_member_fields(v: Views) -> DataFrame:
    return C.member_fields(v.code("PRI:1-URGENT"), v.members, v.concepts, ["targetComponentId"])


@query("ecl_refsets_containing", sql("SELECT DISTINCT refset_id AS code FROM members WHERE active AND code IN ('C:1', 'C:2', 'O:1', 'O:3')", "members"))
def ecl_refsets_containing(v: Views) -> DataFrame:
    return C.refsets_containing(v.code("C:1", "C:2", "O:1", "O:3"), v.members, v.refset_concepts)


@query("ecl_member_filter", sql(f"""
SELECT code FROM members WHERE module = 'priority' AND effective_time >= 19960101 AND targetComponentId IN ({ASIA})
UNION ALL SELECT code FROM members WHERE TRY_CAST(balance AS DOUBLE) > 5000""", "members", "closure"))  # fmt: skip
def ecl_member_filter(v: Views) -> DataFrame:
    asia = H.descendants(v.code("R:2"), v.closure)
    first = C.member_filter(v.members, time=(">=", 19960101), module=["priority"], fields={"targetComponentId": ("concept", "=", asia)})
    return first.select("code").unionByName(C.member_filter(v.members, fields={"balance": ("number", ">", 5000)}).select("code"))


@query("ecl_refine_attribute", sql("SELECT DISTINCT source AS code FROM attributes WHERE kind = 'has_part' AND target IN (SELECT descendant FROM closure WHERE ancestor = 'B:Brand#11')", "attributes", "closure"))
def ecl_refine_attribute(v: Views) -> DataFrame:
    return C.refine(v.concepts, v.attributes, A(["has_part"], H.descendants(v.code("B:Brand#11"), v.closure)))


@query("ecl_attribute_compare", sql("SELECT DISTINCT source AS code FROM attributes WHERE (kind = 'quantity' AND number >= 49) OR (kind = 'returnflag' AND text <> 'N' AND text = 'R')", "attributes"))
def ecl_attribute_compare(v: Views) -> DataFrame:
    return C.either(C.refine(v.concepts, v.attributes, A(["quantity"], (">=", 49))), C.refine(v.concepts, v.attributes, A(["returnflag"], ("=", "R"))))


@query("ecl_attribute_cardinality", sql("""
SELECT code FROM concepts LEFT JOIN (SELECT source, count(*) AS n FROM attributes WHERE kind = 'discount' AND number > 0.05 GROUP BY source) ON source = code
WHERE module = 'orders' AND coalesce(n, 0) <= 1""", "concepts", "attributes"))  # fmt: skip
def ecl_attribute_cardinality(v: Views) -> DataFrame:
    return C.refine(v.concepts.filter("module = 'orders'"), v.attributes, A(["discount"], (">", 0.05), least=0, most=1))


_GROUPS = """
grouped AS (SELECT source, CASE role_group WHEN 0 THEN 'r' || row_id ELSE 'g' || role_group END AS g,
  count(*) FILTER (kind = 'quantity' AND number >= 25) AS q, count(*) FILTER (kind = 'returnflag' AND text = 'R') AS r FROM attributes GROUP BY ALL)"""


@query("ecl_attribute_group", sql(f"{_GROUPS} SELECT source AS code FROM grouped WHERE q >= 1 AND r >= 1 GROUP BY source HAVING count(*) >= 2", "attributes"))
def ecl_attribute_group(v: Views) -> DataFrame:
    return C.refine_group(v.concepts, v.attributes, [A(["quantity"], (">=", 25)), A(["returnflag"], ("=", "R"))], "and", 2)


@query("ecl_refine_and_or", sql(f"""{_GROUPS}
SELECT code FROM concepts WHERE module = 'orders' AND (
  code NOT IN (SELECT source FROM grouped WHERE q >= 1 AND r >= 1) OR code IN (SELECT source FROM attributes WHERE kind = 'has_supplier' AND target = 'S:1'))""", "concepts", "attributes"))  # fmt: skip
def ecl_refine_and_or(v: Views) -> DataFrame:
    orders = v.concepts.filter("module = 'orders'")
    none = C.refine_group(orders, v.attributes, [A(["quantity"], (">=", 25)), A(["returnflag"], ("=", "R"))], "and", 0, 0)
    return C.either(none, C.refine(orders, v.attributes, A(["has_supplier"], v.code("S:1"))))


@query("ecl_reverse_attribute", sql("""
SELECT code FROM concepts LEFT JOIN (SELECT target, count(*) AS n FROM attributes WHERE kind = 'has_part' AND source IN (SELECT code FROM concepts WHERE active) GROUP BY target) ON target = code
WHERE module = 'part' AND coalesce(n, 0) BETWEEN 0 AND 20""", "concepts", "attributes"))  # fmt: skip
def ecl_reverse_attribute(v: Views) -> DataFrame:
    return C.refine_reverse(v.concepts.filter("module = 'part'"), v.attributes, v.concepts.filter("active"), ["has_part"], 0, 20)


@query("ecl_concept_filter", sql("SELECT code FROM concepts WHERE active AND definition_status = 'defined' AND effective_time < 19970101", "concepts"))
def ecl_concept_filter(v: Views) -> DataFrame:
    return C.concept_filter(v.concepts, v.concepts, active=True, definition=["defined"], time=("<", 19970101))


@query("ecl_description_filter", sql("""
SELECT DISTINCT d.code FROM designations d JOIN acceptability a USING (designation_id)
WHERE active AND language = 'es' AND use_code = 'synonym' AND a.refset_id = 'LANG:es' AND acceptability = 'preferred' AND strip_accents(lower(term)) LIKE 'articulo %'""", "designations", "acceptability"))  # fmt: skip
def ecl_description_filter(v: Views) -> DataFrame:
    return C.description_filter(v.concepts, v.designations, D(words=["artic"], languages=["es"], uses=["synonym"], dialects={"LANG:es": ["preferred"]}), v.acceptability)


@query("ecl_term_match", sql("""
SELECT DISTINCT code FROM designations WHERE active AND len(list_filter(string_split_regex(strip_accents(lower(term)), '[^a-z0-9]+'), lambda w: starts_with(w, 'b'))) > 0
  AND len(list_filter(string_split_regex(strip_accents(lower(term)), '[^a-z0-9]+'), lambda w: starts_with(w, 'brand'))) > 0""", "designations"))  # fmt: skip
def ecl_term_match(v: Views) -> DataFrame:
    return C.description_filter(v.concepts, v.designations, D(words=["BRAND b"]))


@query("ecl_term_wild", sql("SELECT DISTINCT code FROM designations WHERE active AND regexp_matches(lower(term), '^c.*#.*1$')", "designations"))
def ecl_term_wild(v: Views) -> DataFrame:
    return C.description_filter(v.concepts, v.designations, D(wild=["C*#*1"]))


@query("ecl_dialect_filter", sql("""
SELECT DISTINCT code FROM designations JOIN acceptability USING (designation_id)
WHERE active AND ((refset_id = 'LANG:en' AND acceptability = 'acceptable') OR (refset_id = 'LANG:es' AND acceptability = 'preferred'))""", "designations", "acceptability"))  # fmt: skip
def ecl_dialect_filter(v: Views) -> DataFrame:
    """A set with acceptabilities of its own, and one by alias that takes the shared ones."""
    return C.description_filter(v.concepts, v.designations, D(dialects={"LANG:en": ["acceptable"], "ES-x": None}, acceptabilities=["preferred"], aliases={"es-x": "LANG:es"}), v.acceptability)


@query("ecl_history", sql(f"""
asia AS ({ASIA} AND descendant LIKE 'C:%')
SELECT code FROM asia UNION SELECT code FROM members WHERE active AND refset_id IN ('PRI:1-URGENT', 'PRI:2-HIGH') AND targetComponentId IN (SELECT code FROM asia)""", "members", "closure"))  # fmt: skip
def ecl_history(v: Views) -> DataFrame:
    asia = C.both(H.below(v.code("R:2"), v.edges, lambda: v.closure), v.concepts.filter("module = 'customer'"))
    return C.with_history(asia, v.members, ["PRI:1-URGENT", "PRI:2-HIGH"])


_LINES = """
lines AS (SELECT 'O:' || l_orderkey AS code, l_linenumber AS no, p_brand AS brand, s_nationkey AS nation, l_returnflag AS flag, l_quantity AS q, l_discount AS d
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
big AS (SELECT DISTINCT code FROM lines WHERE q >= 45),
by_group AS (SELECT code, no, bool_or(flag = 'R') AS r, bool_or(q < 10 OR d > 0.08) AS low, bool_or(brand = 'Brand#11') AS b11 FROM lines WHERE no > 1 GROUP BY code, no),
brands AS (SELECT DISTINCT code, no, brand FROM lines WHERE no > 1),
nations AS (SELECT DISTINCT code, no, nation FROM lines WHERE no > 1)"""


@query("ecl_constraints", sql(f"""{_LINES}
SELECT DISTINCT 'returned/' || brand AS constraint_id, code FROM brands JOIN by_group USING (code, no) WHERE r AND code NOT IN (SELECT code FROM big)
UNION ALL (SELECT 'often/' || brand, code FROM brands JOIN by_group USING (code, no) WHERE low GROUP BY brand, code HAVING count(*) >= 2 UNION SELECT 'often/' || brand, code FROM lines GROUP BY brand, code HAVING count(*) >= 3)
UNION ALL SELECT 'once/' || nation, code FROM (
  SELECT nation, code FROM nations JOIN by_group USING (code, no) WHERE NOT b11 UNION ALL SELECT nation, code FROM lines WHERE no = 1) JOIN concepts USING (code) WHERE active GROUP BY nation, code HAVING count(*) = 1
UNION ALL SELECT 'without', code FROM (SELECT code, 1 AS n FROM by_group WHERE NOT r UNION ALL SELECT code, 4 + CASE WHEN flag <> 'R' THEN 1 ELSE 0 END FROM lines WHERE no = 1) GROUP BY code HAVING sum(n) >= 8""", "concepts"))
def ecl_constraints(v: Views) -> DataFrame:
    """Three constraints a brand or nation (nested and, or and not inside role groups, counts of groups and rows), and one that role groups meet by what they lack, in one plan."""
    part, both = v.raw("part"), lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    brands, nations = part.select("p_brand").distinct(), v.raw("nation")
    sets = part.select(F.col("p_brand").alias("set_name"), both("P:", "p_partkey").alias("code")).unionByName(v.raw("supplier").select(F.col("s_nationkey").cast("string").alias("set_name"), both("S:", "s_suppkey").alias("code")))
    # trees once for a set that stands for all, whose name then comes from the tables
    returned = CS.And(CS.Group(CS.And(CS.Test("has_part", "?"), CS.Test("returnflag", ("=", "R")))), CS.Not(CS.Test("quantity", (">=", 45))))
    often = CS.Or(CS.Group(CS.And(CS.Test("has_part", "?"), CS.Or(CS.Test("quantity", ("<", 10)), CS.Test("discount", (">", 0.08)))), least=2), CS.Test("has_part", "?", least=3))
    once = CS.Group(CS.And(CS.Test("has_supplier", "?"), CS.Not(CS.Test("has_part", "Brand#11"))), least=1, most=1)
    without = CS.Group(CS.Not(CS.Test("returnflag", ("=", "R"))), least=8)
    made = CS.frames(v.spark, {"returned": returned, "often": often, "once": once, "without": without})
    names = brands.select(F.explode(F.array(F.lit("returned"), F.lit("often"))).alias("shape"), F.col("p_brand").alias("own")).unionByName(nations.select(F.lit("once").alias("shape"), F.col("n_nationkey").cast("string").alias("own")))
    names = names.withColumn("name", F.concat_ws("/", "shape", "own")).unionByName(v.spark.sql("SELECT 'without' AS shape, '' AS own, 'without' AS name"))

    def each(df: DataFrame) -> DataFrame:
        columns = [c for c in df.columns if c != "constraint_id"]
        out = df.join(names, F.col("constraint_id") == F.col("shape")).select(F.col("name").alias("constraint_id"), "own", *columns)
        return (out.withColumn("set_name", F.when(F.col("set_name") == "?", F.col("own")).otherwise(F.col("set_name"))) if "set_name" in columns else out).drop("own")

    orders = v.concepts.filter("module = 'orders'").select("code", F.explode(F.when(F.col("active"), F.array(F.lit("all"), F.lit("active"))).otherwise(F.array(F.lit("all")))).alias("domain"))
    focus = names.select(F.col("name").alias("constraint_id"), F.when(F.col("shape") == "once", "active").otherwise("all").alias("domain"))
    return CS.select_all(focus, v.attributes, *[each(df) for df in made], sets, orders)
