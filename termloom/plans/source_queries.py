"""Registered queries for readers and table builds: release files written from the driver's tables, then read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.plans.driver_views import Views, sql
from termloom.plans.registry import query
from termloom.sources import rf2
from termloom.sources import terminologies as T
from termloom.sources import written as W
from termloom.tables import new_path


def s(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def _write(df: DataFrame, path: str, **options: object) -> None:
    df.write.options(header=True, **options).csv(path)


_TSV = {"sep": "\t", "quote": "", "escapeQuotes": False, "emptyValue": "", "nullValue": ""}


def rf2_folder(v: Views) -> str:
    """Customers and nations as concepts, names as descriptions, nationality as is-a, balances as concrete values, segments and languages as sets."""
    folder, name = new_path(v.spark, "rf2"), "Snapshot_INT_20260101.txt"
    c, n = v.raw("customer"), v.raw("nation")
    time, module = F.lit(20260101).alias("effectiveTime"), F.lit("900").alias("moduleId")
    on = (F.col("c_acctbal") >= 0).cast("int").alias("active")
    put = lambda df, file: _write(df, f"{folder}/{file}{'' if 'Refset' in file else '_'}{name}", **_TSV)
    concepts = c.select(s("1", "c_custkey").alias("id"), time, on, module, F.lit("900000000000074008").alias("definitionStatusId"))
    concepts = concepts.unionByName(n.select(s("2", "n_nationkey").alias("id"), time, F.lit(1).alias("active"), module, F.lit("900000000000074008").alias("definitionStatusId")))
    put(concepts, "sct2_Concept")
    put(c.select(s("3", "c_custkey").alias("id"), time, F.lit(1).alias("active"), module, F.when(F.col("c_custkey") % 10 == 0, "absent").otherwise(s("1", "c_custkey")).alias("conceptId"), F.lit("en").alias("languageCode"),
                 F.lit("900000000000003001").alias("typeId"), F.concat(F.lit('"'), "c_name").alias("term"), F.lit("x").alias("caseSignificanceId")), "sct2_Description")
    kind = F.when(F.col("c_custkey") % 5 == 0, "900000000000010007").otherwise(rf2.INFERRED).alias("characteristicTypeId")
    put(c.select(s("4", "c_custkey").alias("id"), time, F.lit(1).alias("active"), module, s("1", "c_custkey").alias("sourceId"), s("2", "c_nationkey").alias("destinationId"), F.lit(0).alias("relationshipGroup"),
                 F.lit(rf2.IS_A).alias("typeId"), kind, F.lit("m").alias("modifierId")), "sct2_Relationship")
    put(c.select(s("5", "c_custkey").alias("id"), time, F.lit(1).alias("active"), module, s("1", "c_custkey").alias("sourceId"), F.concat(F.lit("#"), F.col("c_acctbal").cast("decimal(18,2)").cast("string")).alias("value"), F.lit(1).alias("relationshipGroup"),
                 F.lit("balance").alias("typeId"), F.lit(rf2.INFERRED).alias("characteristicTypeId"), F.lit("m").alias("modifierId")), "sct2_RelationshipConcreteValues")
    put(c.select(F.col("c_name").alias("alternateIdentifier"), time, on, module, F.lit("names").alias("identifierSchemeId"), s("1", "c_custkey").alias("referencedComponentId")), "sct2_Identifier")
    put(c.select(s("m", "c_custkey").alias("id"), time, on, module, F.col("c_mktsegment").alias("refsetId"), s("1", "c_custkey").alias("referencedComponentId"), s("2", "c_nationkey").alias("targetComponentId")), "der2_cRefset_Association")
    put(c.select(s("l", "c_custkey").alias("id"), time, F.lit(1).alias("active"), module, F.lit("lang").alias("refsetId"), s("3", "c_custkey").alias("referencedComponentId"),
                 F.when(F.col("c_custkey") % 2 == 0, rf2.PREFERRED).otherwise(rf2.ACCEPTABLE).alias("acceptabilityId")), "der2_cRefset_Language")
    put(c.select(s("x", "c_custkey").alias("id"), time, F.lit(1).alias("active"), module, F.lit("map").alias("refsetId"), s("1", "c_custkey").alias("referencedComponentId"), F.col("c_mktsegment").alias("mapTarget")), "der2_sRefset_SimpleMap")
    return folder


@query("read_rf2_components", "SELECT '1' || c_custkey AS id, 20260101 AS effective_time, c_acctbal >= 0 AS active FROM customer UNION ALL SELECT '2' || n_nationkey, 20260101, true FROM nation")
def read_rf2_components(v: Views) -> DataFrame:
    return rf2.read_component(v.spark, rf2_folder(v), "Concept").select("id", F.col("effectiveTime").alias("effective_time"), "active")


@query("read_rf2_refsets", """
SELECT c_mktsegment AS refset_id, 'association' AS kind, '1' || c_custkey AS code, c_acctbal >= 0 AS active, 'targetComponentId=2' || c_nationkey AS field FROM customer
UNION ALL SELECT 'lang', 'language', '3' || c_custkey, true, 'acceptabilityId=' || CASE WHEN c_custkey % 2 = 0 THEN '900000000000548007' ELSE '900000000000549004' END FROM customer
UNION ALL SELECT 'map', 'simple-map', '1' || c_custkey, true, 'mapTarget=' || c_mktsegment FROM customer""")
def read_rf2_refsets(v: Views) -> DataFrame:
    entries = F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rf2.read_refsets(v.spark, rf2_folder(v)).select("refset_id", "kind", "code", "active", F.array_join(entries, ",").alias("field"))


@query("refset_views", "SELECT '3' || c_custkey AS code, CASE WHEN c_custkey % 2 = 0 THEN '900000000000548007' ELSE '900000000000549004' END AS value FROM customer UNION ALL SELECT '1' || c_custkey, '2' || c_nationkey FROM customer UNION ALL SELECT '1' || c_custkey, c_mktsegment FROM customer")
def refset_views(v: Views) -> DataFrame:
    members = rf2.read_refsets(v.spark, rf2_folder(v))
    named = {"language": "acceptabilityId", "association": "targetComponentId", "simple-map": "mapTarget"}
    parts = [rf2.refset_view(members, k).select("code", F.col(c).alias("value")) for k, c in named.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("release_manifest", "SELECT * FROM (VALUES ('Concept', 20260101), ('Description', 20260101), ('Relationship', 20260101), ('RelationshipConcreteValues', 20260101), ('Identifier', 20260101), ('cRefset_Association', 20260101), ('cRefset_Language', 20260101), ('sRefset_SimpleMap', 20260101)) t(content, date)")
def release_manifest(v: Views) -> DataFrame:
    found = rf2.release_manifest(v.spark, rf2_folder(v))
    rf2.check_manifest(found)
    return found.select(F.concat_ws("_", "content", F.nullif("summary", F.lit(""))).alias("content"), "date").distinct()


@query("inferred_only", "SELECT '4' || c_custkey AS id FROM customer WHERE c_custkey % 5 <> 0")
def inferred_only(v: Views) -> DataFrame:
    return rf2.inferred_only(rf2.read_component(v.spark, rf2_folder(v), "Relationship"))[0].filter(F.col("typeId") == rf2.IS_A).select("id")


@query("build_concepts", "SELECT 'C' || c_custkey AS code, CASE WHEN c_custkey % 3 = 0 THEN 'edition' ELSE 'package' END AS module FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 2 = 0")
def build_concepts(v: Views) -> DataFrame:
    rows = lambda test, module: v.raw("customer").filter(test).select(s("C", "c_custkey").alias("id"), F.lit(1).alias("effectiveTime"), F.lit(True).alias("active"), F.lit(module).alias("moduleId"), F.lit("d").alias("definitionStatusId"))
    return rf2.build_concepts([rows("c_custkey % 3 = 0", "edition"), rows("c_custkey % 2 = 0", "package")]).select("code", "module")


@query("build_edges_attributes", """
SELECT 'edge' AS what, '1' || c_custkey AS code, '2' || c_nationkey AS value FROM customer WHERE c_custkey % 5 <> 0
UNION ALL SELECT 'number', '1' || c_custkey, CAST(CAST(c_acctbal AS DECIMAL(18, 2)) AS VARCHAR) FROM customer""")
def build_edges_attributes(v: Views) -> DataFrame:
    t = rf2.read_components(v.spark, rf2_folder(v), kinds=["Concept", "Relationship", "RelationshipConcreteValues"])
    edges, attributes, _ = rf2.build_edges_attributes(t["Relationship"], t["RelationshipConcreteValues"], rf2.build_concepts([t["Concept"]]))
    numbers = attributes.select(F.lit("number").alias("what"), F.col("source").alias("code"), F.col("number").cast("decimal(18,2)").cast("string").alias("value"))
    return edges.select(F.lit("edge").alias("what"), F.col("child").alias("code"), F.col("parent").alias("value")).unionByName(numbers)


@query("build_designations", "SELECT '3' || c_custkey AS designation_id, c_custkey % 10 <> 0 AS placed, '\"' || c_name AS term FROM customer")
def build_designations(v: Views) -> DataFrame:
    t = rf2.read_components(v.spark, rf2_folder(v), kinds=["Concept", "Description"])
    placed, skipped = rf2.build_designations(t["Description"], rf2.build_concepts([t["Concept"]]))
    return placed.select("designation_id", F.lit(True).alias("placed"), "term").unionByName(skipped.select("designation_id", F.lit(False).alias("placed"), "term"))


@query("build_acceptability", "SELECT '3' || c_custkey AS designation_id, CASE WHEN c_custkey % 2 = 0 THEN 'preferred' ELSE 'acceptable' END AS acceptability FROM customer")
def build_acceptability(v: Views) -> DataFrame:
    folder = rf2_folder(v)
    terms = rf2.read_component(v.spark, folder, "Description").select(F.col("id").alias("designation_id"))
    return rf2.build_acceptability(rf2.read_refsets(v.spark, folder), terms).select("designation_id", "acceptability")


@query("build_members", "SELECT '1' || c_custkey AS code, c_mktsegment AS refset_id, 'targetComponentId' AS concept_fields FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT '1' || c_custkey, 'map', '' FROM customer")
def build_members(v: Views) -> DataFrame:
    folder = rf2_folder(v)
    concepts = rf2.build_concepts([rf2.read_component(v.spark, folder, "Concept")])
    return rf2.build_members(rf2.read_refsets(v.spark, folder), concepts).select("code", "refset_id", F.array_join("concept_fields", ",").alias("concept_fields"))


@query("build_identifiers", "SELECT c_name AS alt_code, '1' || c_custkey AS code FROM customer WHERE c_acctbal >= 0")
def build_identifiers(v: Views) -> DataFrame:
    t = rf2.read_components(v.spark, rf2_folder(v), kinds=["Concept", "Identifier"])
    return rf2.build_identifiers(t["Identifier"], rf2.build_concepts([t["Concept"]])).select("alt_code", "code")


@query("read_loinc", """
SELECT 'concept:' || kind AS what, code, display AS value FROM (
  SELECT 'term' AS kind, 'P' || p_partkey AS code, p_name AS display FROM part UNION ALL SELECT DISTINCT 'part', 'LP' || p_type, p_type FROM part
  UNION ALL SELECT DISTINCT 'class-part', 'CP' || p_brand, 'class ' || p_brand FROM part UNION ALL SELECT DISTINCT 'list', 'LL' || p_size, 'list ' || p_size FROM part UNION ALL SELECT DISTINCT 'answer', 'LA' || p_size, 'answer' FROM part)
UNION ALL SELECT 'edge', 'P' || p_partkey, 'CP' || p_brand FROM part UNION ALL SELECT 'STATUS', 'P' || p_partkey, CASE WHEN p_size > 40 THEN 'DEPRECATED' ELSE 'ACTIVE' END FROM part
UNION ALL SELECT 'link', 'P' || p_partkey, 'LP' || p_type FROM part""")
def read_loinc(v: Views) -> DataFrame:
    folder, p = new_path(v.spark, "loinc"), v.raw("part")
    code, status = s("P", "p_partkey"), F.when(F.col("p_size") > 40, "DEPRECATED").otherwise("ACTIVE")
    _write(p.select(code.alias("LOINC_NUM"), F.col("p_type").alias("COMPONENT"), status.alias("STATUS"), F.col("p_name").alias("LONG_COMMON_NAME")), f"{folder}/Loinc.csv")
    _write(p.select(s("LP", "p_type").alias("PartNumber"), F.lit("COMPONENT").alias("PartTypeName"), F.col("p_type").alias("PartName"), F.col("p_type").alias("PartDisplayName"), F.lit("ACTIVE").alias("Status")).distinct(), f"{folder}/Part.csv")
    tree = p.select(code.alias("CODE"), s("CP", "p_brand").alias("IMMEDIATE_PARENT"), F.col("p_name").alias("CODE_TEXT")).unionByName(p.select(s("CP", "p_brand").alias("CODE"), F.lit(None).cast("string").alias("IMMEDIATE_PARENT"), F.concat(F.lit("class "), "p_brand").alias("CODE_TEXT")).distinct())
    _write(tree, f"{folder}/ComponentHierarchyBySystem.csv")
    _write(p.select(code.alias("LoincNumber"), s("LP", "p_type").alias("PartNumber"), F.col("p_type").alias("PartName"), F.lit("COMPONENT").alias("PartTypeName")), f"{folder}/LoincPartLink_Primary.csv")
    _write(p.select(s("LL", "p_size").alias("AnswerListId"), s("list ", "p_size").alias("AnswerListName"), s("LA", "p_size").alias("AnswerStringId"), F.lit("answer").alias("DisplayText"), F.lit(1).alias("SequenceNumber")).distinct(), f"{folder}/AnswerList.csv")
    _write(p.select(code.alias("LoincNumber"), s("LL", "p_size").alias("AnswerListId")), f"{folder}/LoincAnswerListLink.csv")
    t = T.read_loinc(v.spark, folder)
    row = lambda df, what, a, b: df.select(what.alias("what"), F.col(a).alias("code"), F.col(b).alias("value"))
    return (
        row(t["concepts"], F.concat(F.lit("concept:"), "kind"), "code", "display").unionByName(row(t["edges"], F.lit("edge"), "child", "parent"))
        .unionByName(row(t["properties"].filter("property = 'STATUS'"), F.col("property"), "code", "value_text")).unionByName(row(t["links"], F.lit("link"), "code", "part"))
    )


@query("read_loinc_variants", "SELECT 'P' || p_partkey AS code, 'nl-NL' AS language, 'long' AS use_code, 'onderdeel ' || p_name AS term FROM part UNION ALL SELECT 'P' || p_partkey, 'de-AT', 'short', upper(p_name) FROM part WHERE p_size > 10")
def read_loinc_variants(v: Views) -> DataFrame:
    """Two languages, of which one has short names alone, and some empty; a file of another name is left out."""
    folder, p = new_path(v.spark, "loinc"), v.raw("part")
    rows = lambda long, short: p.select(s("P", "p_partkey").alias("LOINC_NUM"), long.cast("string").alias("LONG_COMMON_NAME"), short.cast("string").alias("SHORTNAME"), F.lit(None).cast("string").alias("LinguisticVariantDisplayName"))
    _write(rows(F.concat(F.lit("onderdeel "), "p_name"), F.lit(None)), f"{folder}/nlNL22LinguisticVariant.csv")
    _write(rows(F.lit(None), F.when(F.col("p_size") > 10, F.upper("p_name"))), f"{folder}/deAT24LinguisticVariant.csv")
    _write(rows(F.col("p_name"), F.col("p_name")), f"{folder}/otherLinguisticVariant.csv")
    return T.read_loinc_variants(v.spark, folder)


@query("read_rxnorm", """
SELECT 'P' || p_partkey AS concept, 'A' || p_partkey AS atom, p_name AS name FROM part WHERE p_size % 2 = 0 UNION ALL SELECT 'P' || p_partkey, 'M' || p_partkey, upper(p_name) FROM part WHERE p_size % 2 = 0""")
def read_rxnorm(v: Views) -> DataFrame:
    return T.read_rxnorm(v.spark, rxnorm_folder(v))["atoms"].select("concept", "atom", "name")


def rxnorm_folder(v: Views) -> str:
    """Parts of even size have an own-source atom; every part has one of a free and one of a restricted source."""
    folder, p = new_path(v.spark, "rxnorm"), v.raw("part")

    def line(places: dict[int, Column], width: int) -> Column:
        return F.concat_ws("|", *[F.coalesce(places.get(i, F.lit("")), F.lit("")) for i in range(width)], F.lit(""))

    rows = [("A", "RXNORM", F.col("p_name"), "p_size % 2 = 0"), ("M", "MTHSPL", F.upper("p_name"), "true"), ("R", "CLOSED", F.col("p_name"), "true")]
    atoms = None
    for mark, source, name, test in rows:
        df = p.filter(test).select(line({0: s("P", "p_partkey"), 1: F.lit("ENG"), 7: s(mark, "p_partkey"), 11: F.lit(source), 12: F.lit("SCD"), 13: F.lit("c"), 14: name, 16: F.lit("N")}, 18))
        atoms = df if atoms is None else atoms.union(df)
    atoms.write.text(f"{folder}/RXNCONSO.RRF")
    values = F.explode(F.array(F.struct(F.lit("RXNORM").alias("s"), F.col("p_type").alias("x")), F.struct(F.lit("MTHSPL").alias("s"), F.col("p_type").alias("x")), F.struct(F.lit("CLOSED").alias("s"), F.col("p_name").alias("x")))).alias("a")
    p.select("p_partkey", values).select(line({0: s("P", "p_partkey"), 8: F.lit("NDC"), 9: F.col("a.s"), 10: F.col("a.x")}, 13)).write.text(f"{folder}/RXNSAT.RRF")
    p.select(line({0: s("P", "p_partkey"), 1: F.lit("T1"), 3: F.lit("Drug")}, 6)).write.text(f"{folder}/RXNSTY.RRF")
    p.select(line({0: s("P", "p_partkey"), 3: F.lit("RO"), 4: s("P", "p_size"), 7: F.lit("has"), 10: F.lit("RXNORM")}, 16)).write.text(f"{folder}/RXNREL.RRF")
    return folder


@query("rxnorm_attributes", "SELECT DISTINCT 'P' || p_partkey AS code, 'NDC' AS name, p_type AS value FROM part WHERE p_size % 2 = 0 UNION ALL SELECT 'P' || p_partkey, 'STY', 'Drug' FROM part WHERE p_size % 2 = 0")
def rxnorm_attributes(v: Views) -> DataFrame:
    """Distinct attribute values and semantic types of concepts with an own-source atom; a value of a restricted source is left out."""
    return T.read_rxnorm(v.spark, rxnorm_folder(v))["attributes"]


@query("read_icd10cm_order", "SELECT p_partkey AS \"order\", CASE WHEN length(c) > 3 THEN substr(c, 1, 3) || '.' || substr(c, 4) ELSE c END AS code, p_size > 25 AS header, p_name AS long FROM (SELECT *, 'A' || p_partkey AS c FROM part)")
def read_icd10cm_order(v: Views) -> DataFrame:
    path, p = new_path(v.spark, "order"), v.raw("part")
    pad = lambda c, n: F.rpad(c, n, " ")
    p.select(F.concat(F.lpad(F.col("p_partkey").cast("string"), 19, "0"), F.lit(" "), pad(s("A", "p_partkey"), 20), F.lit(" "), F.when(F.col("p_size") > 25, "0").otherwise("1"), F.lit(" "), pad(F.upper("p_name"), 60), F.lit(" "), F.col("p_name"))).write.text(path)
    return T.read_icd10cm_order(v.spark, path, order=19, code=20).select("order", "code", "header", "long")


@query("read_atc", "SELECT 'class' AS what, p_brand AS code, 'level ' || p_brand AS value FROM part GROUP BY p_brand UNION ALL SELECT 'dose', p_brand, CAST(p_size AS VARCHAR) FROM part WHERE p_size > 5")
def read_atc(v: Views) -> DataFrame:
    path, p = new_path(v.spark, "atc"), v.raw("part")
    _write(p.select(F.col("p_brand").alias("ATC code"), F.concat(F.lit("level "), "p_brand").alias("ATC level name"), F.when(F.col("p_size") > 5, F.col("p_size")).alias("DDD"), F.lit("g").alias("U"), F.lit("O").alias("Adm.R"), F.lit(None).cast("string").alias("Note")), path, sep=";")
    classes, doses = T.read_atc(v.spark, path, ";")
    return classes.select(F.lit("class").alias("what"), "code", F.col("title").alias("value")).unionByName(doses.select(F.lit("dose").alias("what"), "code", F.col("ddd").alias("value")))


@query("read_claml", "SELECT 'P' || p_partkey AS code, p_brand AS parent, p_name AS title, 'nl' AS language FROM part")
def read_claml(v: Views) -> DataFrame:
    path, p = new_path(v.spark, "claml"), v.raw("part")
    label = F.array(F.struct(F.col("p_name").alias("_VALUE"), F.lit("nl").alias("_xml:lang")))
    rows = p.select(s("P", "p_partkey").alias("_code"), F.lit("category").alias("_kind"), F.array(F.struct(F.col("p_brand").alias("_code"))).alias("SuperClass"), F.array(F.struct(F.lit("preferred").alias("_kind"), label.alias("Label"))).alias("Rubric"))
    rows.write.format("xml").option("rootTag", "ClaML").option("rowTag", "Class").option("validateName", False).save(path)
    t = T.read_claml(v.spark, path)
    return t["classes"].join(t["rubrics"].filter("kind = 'preferred'").drop("kind"), "code").select("code", "parent", F.col("text").alias("title"), "language")


@query("read_product_ladder", "SELECT CAST(p_partkey AS VARCHAR) AS code, p_name AS name, p_size <= 30 AS active FROM part WHERE p_size % 5 <> 0")
def read_product_ladder(v: Views) -> DataFrame:
    path, p = new_path(v.spark, "ladder"), v.raw("part")
    p.select(F.rpad(F.concat(F.lpad(F.col("p_partkey").cast("string"), 8, " "), F.when(F.col("p_size") % 5 == 0, "9").otherwise("0"), F.rpad("p_name", 40, " "), F.when(F.col("p_size") > 30, "20250101").otherwise("        ")), 64, "."))\
        .union(p.select(F.lit("short"))).write.text(path)
    return T.read_product_ladder(v.spark, path, {"code": (1, 8), "mutation": (9, 1), "name": (10, 40), "ended": (50, 8)}, 64).select("code", "name", "active")


@query("read_ladder", """
SELECT 'name:' || u AS what, kind, CAST(p_partkey + 1 AS VARCHAR) AS code, CASE u WHEN 'preferred' THEN p_name ELSE upper(p_name) END AS value FROM part, (VALUES ('gpk'), ('prk'), ('hpk'), ('article')) k(kind), (VALUES ('preferred'), ('short')) t(u)
UNION ALL SELECT 'form', 'gpk', CAST(p_partkey + 1 AS VARCHAR), CASE WHEN p_size > 25 THEN CAST(p_size AS VARCHAR) ELSE 'form ' || p_size END FROM part
UNION ALL SELECT 'brand', 'hpk', CAST(p_partkey + 1 AS VARCHAR), p_brand FROM part
UNION ALL SELECT 'gpk', kind, CAST(p_partkey + 1 AS VARCHAR), CAST(p_partkey + 1 AS VARCHAR) FROM part, (VALUES ('prk'), ('hpk'), ('article')) k(kind)
UNION ALL SELECT 'active', 'article', CAST(p_partkey + 1 AS VARCHAR), CASE WHEN p_size > 30 THEN 'false' ELSE 'true' END FROM part""")
def read_ladder(v: Views) -> DataFrame:
    """A part as a product on all four rungs, with one name and one label; forms up to 25 are on the list."""
    folder, p = new_path(v.spark, "ladder"), v.raw("part")

    def put(kind: str, df: DataFrame, fields: dict[str, Column]) -> None:
        file, length, places = T.LADDER[kind]
        cells, at = [F.lit("00010")], 6  # file number and mutation
        for name, (start, n) in sorted(places.items(), key=lambda x: x[1]):
            if start >= at:
                text = fields.get(name, F.lit(""))
                cells += [F.lit(" " * (start - at)), F.lpad(text, n, "0") if name in ("code", "name", "parent", "list", "form", "form_list", "removed") and name in fields else F.rpad(text, n, " ")]
                at = start + n
        df.select(F.rpad(F.concat(*cells), length, ".")).write.text(f"{folder}/{file}")

    key = (F.col("p_partkey") + 1).cast("string")
    put("gpk", p, {"code": key, "name": key, "form_list": F.lit("7"), "form": F.col("p_size").cast("string")})
    put("prk", p, {"code": key, "name": key, "parent": key})
    put("hpk", p, {"code": key, "name": key, "parent": key, "brand": F.col("p_brand")})
    put("article", p, {"code": key, "name": key, "parent": key, "removed": F.when(F.col("p_size") > 30, "20250101").otherwise("0")})
    put("names", p, {"code": key, "preferred": F.col("p_name"), "short": F.upper("p_name"), "label": F.col("p_name")})
    put("items", p.filter("p_size <= 25").select("p_size").distinct(), {"list": F.lit("7"), "code": F.col("p_size").cast("string"), "text": F.concat(F.lit("form  "), F.col("p_size").cast("string"))})
    t = T.read_ladder(v.spark, folder)
    row = lambda df, what, value: df.select(what.alias("what"), "kind", "code", value.alias("value"))
    return (
        row(t["names"], F.concat(F.lit("name:"), "use_code"), F.col("term")).unionByName(row(t["properties"].filter("property IN ('form', 'brand')"), F.col("property"), F.col("value_text")))
        .unionByName(row(t["rungs"], F.lit("gpk"), F.col("gpk"))).unionByName(row(t["products"].filter("kind = 'article'"), F.lit("active"), F.col("active").cast("string")))
    )


@query("read_thesaurus_delivery", """
SELECT 'laterality' AS what, 'P' || p_partkey AS code, p_type AS value FROM part UNION ALL SELECT 'active', 'P' || p_partkey, CASE WHEN p_size > 20 THEN 'true' ELSE 'false' END FROM part
UNION ALL SELECT 'preferred', 'P' || p_partkey, p_name FROM part UNION ALL SELECT 'replaced-by', 'P' || p_partkey, 'B' || p_brand FROM part WHERE p_size <= 20
UNION ALL SELECT 'umbrella', 'P' || p_partkey, p_type FROM part WHERE p_size > 10 UNION ALL SELECT 'role', 'P' || p_partkey, 'size=' || p_size || ' [' || p_brand || ']' FROM part
UNION ALL SELECT 'icd10', 'P' || p_partkey, p_brand FROM part UNION ALL SELECT 'dbc', 'P' || p_partkey, p_size || CASE WHEN p_size > 5 THEN ' (x)' ELSE '' END FROM part
UNION ALL SELECT 'za', 'P' || p_partkey, p_type FROM part UNION ALL SELECT 'mapping', 'P' || p_partkey, 'other: ' || p_name FROM part UNION ALL SELECT 'snomed', 'P' || p_partkey, 'S' || p_partkey FROM part""")
def read_thesaurus_delivery(v: Views) -> DataFrame:
    folder, p = new_path(v.spark, "thesaurus"), v.raw("part")
    code, none = s("P", "p_partkey").alias("ConceptID"), F.lit(None).cast("string").alias("Einddatum")
    put = lambda df, name: _write(df, f"{folder}/{name}.csv", quoteAll=True)
    put(p.select(code, F.lit("D").alias("TypeConcept"), F.col("p_type").alias("Lateraliteit"), F.when(F.col("p_size") <= 20, "20240101").alias("Einddatum")), "ThesaurusConcept")
    term = lambda kind, text, end: p.select(code, F.lit(kind).alias("TypeTerm"), F.lit("nl").alias("TaalCode"), text.alias("Omschrijving"), s("S", "p_partkey").alias("SnomedID"), end.alias("Einddatum"))
    put(term("Voorkeursterm", F.regexp_replace("p_name", " ", "  "), F.lit("20991231")).unionByName(term("synoniem", F.col("p_name"), F.lit("20240101"))).unionByName(term("FSN", F.col("p_name"), none)).unionByName(term("ander", F.col("p_name"), none)), "ThesaurusTerm")
    put(p.select(code.alias("ConceptID1"), s("B", "p_brand").alias("ConceptID2"), F.when(F.col("p_size") <= 20, "Vervanging").otherwise("verwant").alias("TypeRelatie"), F.lit("20200101").alias("Einddatum")), "ThesaurusConceptRelaties")
    put(p.select(F.col("p_type").alias("ConceptID1"), code.alias("ConceptID2"), F.when(F.col("p_size") <= 10, "20240101").alias("Einddatum")), "Parapluterm")
    put(p.select(code, F.lit("size").alias("Rolnaam"), F.col("p_size").alias("Rolwaarde"), F.col("p_brand").alias("SpecialismeGroepCode"), none), "ThesaurusConceptRol")
    put(p.select(code, F.col("p_brand").alias("ICD10"), F.lit(1).alias("Volgnummer"), none), "AfleidingICD10")
    put(p.select(code, F.col("p_size").alias("DBC_ID"), F.when(F.col("p_size") > 5, "x").alias("SpecialismeCode"), none), "AfleidingDBC")
    put(p.select(code, F.col("p_type").alias("ZA_Code"), none), "AfleidingZA")
    put(p.select(code, F.lit("other").alias("Codestelsel"), F.col("p_name").alias("Code"), none).unionByName(p.select(F.lit("unknown").alias("ConceptID"), F.lit("other").alias("Codestelsel"), F.col("p_name").alias("Code"), none)), "CodeMapping")
    t = T.read_thesaurus(v.spark, folder, 20250101)
    row = lambda df, what, value: df.select(what.alias("what"), "code", value.alias("value"))
    return (
        row(t["rubrics"], F.col("kind"), F.col("text")).unionByName(row(t["concepts"], F.lit("active"), F.col("active").cast("string")))
        .unionByName(row(t["terms"].filter("use_code != 'fsn'"), F.col("use_code"), F.col("term"))).unionByName(row(t["links"], F.col("kind"), F.col("target")))
    )


@query("thesaurus_maps", "SELECT CASE WHEN p_size <= 10 THEN 'equivalent' ELSE 'wider' END AS map, 'P' || p_partkey AS code, p_brand AS target_code FROM part WHERE p_size <= 20")
def thesaurus_maps(v: Views) -> DataFrame:
    kind = F.when(F.col("p_size") <= 10, "EQ").when(F.col("p_size") <= 20, "BT").otherwise("RT")
    links = v.raw("part").select(s("P", "p_partkey").alias("code"), F.col("p_brand").alias("target_code"), F.lit("brands").alias("target"), kind.alias("kind"))
    return T.thesaurus_maps(links, "EQ", "BT").select("map", "code", "target_code")


@query("read_labcodeset", "SELECT 'set' AS what, 'P' || p_partkey AS code, CAST(NULL AS VARCHAR) AS value FROM part WHERE p_size > 10 AND p_size <= 40 UNION ALL SELECT 'component', 'P' || p_partkey, p_type FROM part")
def read_labcodeset(v: Views) -> DataFrame:
    path, p = new_path(v.spark, "lab"), v.raw("part")
    loinc = F.struct(s("P", "p_partkey").alias("_loinc_num"), F.when(F.col("p_size") > 40, "DEPRECATED").otherwise("ACTIVE").alias("_status"), F.col("p_type").alias("component"))
    p.select(F.when(F.col("p_size") > 10, "active").otherwise("retired").alias("_status"), loinc.alias("loincConcept")).write.format("xml").option("rootTag", "publication").option("rowTag", "lab_concept").save(path)
    t = T.read_labcodeset(v.spark, path)
    return t["value_set"].select(F.lit("set").alias("what"), "code", F.lit(None).cast("string").alias("value")).unionByName(t["properties"].filter("property = 'component'").select(F.lit("component").alias("what"), "code", F.col("value_text").alias("value")))


@query("read_icd11_cache", "SELECT 'P' || p_partkey AS child, p_brand AS parent FROM part UNION ALL SELECT 'P' || p_partkey, p_type FROM part")
def read_icd11_cache(v: Views) -> DataFrame:
    """Parts without a code of their own parents' ids; a parent outside the cache is dropped."""
    path, p = new_path(v.spark, "icd11"), v.raw("part")
    title = lambda c: F.struct(c.alias("@value"), F.lit("en").alias("@language"))
    parts = p.select(s("id/P", "p_partkey").alias("@id"), s("P", "p_partkey").alias("code"), F.lit("category").alias("classKind"), F.array(s("id/", "p_brand"), s("id/", "p_type"), F.lit("id/none")).alias("parent"), title(F.col("p_name")).alias("title"))
    names = p.select(F.col("p_brand").alias("c")).union(p.select("p_type")).distinct()
    ups = names.select(s("id/", "c").alias("@id"), F.col("c").alias("code"), F.lit("block").alias("classKind"), F.array().cast("array<string>").alias("parent"), title(F.col("c")).alias("title"))
    parts.unionByName(ups).write.json(path)
    return T.read_icd11_cache(v.spark, path)["edges"]


@query("read_fhir_code_system", "SELECT 'P' || p_partkey AS child, p_brand AS parent FROM part UNION ALL SELECT 'P' || p_partkey, p_type FROM part")
def read_fhir_code_system(v: Views) -> DataFrame:
    """Brands with their parts nested; each part names its type as a parent property."""
    path, p = new_path(v.spark, "fhir-code-system"), v.raw("part")
    part = F.struct(s("P", "p_partkey").alias("code"), F.col("p_name").alias("display"), F.array(F.struct(F.lit("parent").alias("code"), F.col("p_type").alias("valueCode"))).alias("property"))
    brands = p.groupBy(F.col("p_brand").alias("code")).agg(F.collect_list(part).alias("concept"))
    brands.select(s("urn:", "code").alias("url"), F.lit("1").alias("version"), F.array(F.struct("code", "concept")).alias("concept")).write.json(path)
    return T.read_fhir_code_system(v.spark, path, 2)["edges"].select("child", "parent")


@query("read_fhir_value_set", "SELECT 'vs/' || p_brand AS url, CAST(p_partkey AS VARCHAR) AS code, CAST(NULL AS VARCHAR) AS op FROM part UNION ALL SELECT DISTINCT 'vs/' || p_brand, CAST(NULL AS VARCHAR), 'is-a' FROM part")
def read_fhir_value_set(v: Views) -> DataFrame:
    path, p = new_path(v.spark, "fhir-value-set"), v.raw("part")
    listed = F.struct(F.lit("parts").alias("system"), F.collect_list(F.struct(F.col("p_partkey").cast("string").alias("code"))).alias("concept"), F.array().cast("array<struct<property:string,op:string,value:string>>").alias("filter"))
    tree = F.struct(F.lit("parts").alias("system"), F.array().cast("array<struct<code:string>>").alias("concept"), F.array(F.struct(F.lit("concept").alias("property"), F.lit("is-a").alias("op"), F.lit("x").alias("value"))).alias("filter"))
    p.groupBy("p_brand").agg(F.array(listed, tree).alias("include")).select(s("vs/", "p_brand").alias("url"), F.struct("include").alias("compose")).write.json(path)
    return T.read_fhir_value_set(v.spark, path).select("url", "code", "op")


@query("read_fhir_concept_map", "SELECT 'P' || p_partkey AS code, CASE WHEN p_size > 5 THEN p_brand END AS target_code, CASE WHEN p_size > 5 THEN 'source-is-narrower-than-target' END AS relationship, p_size <= 5 AS no_map FROM part")
def read_fhir_concept_map(v: Views) -> DataFrame:
    path, p = new_path(v.spark, "fhir-concept-map"), v.raw("part")
    target = F.when(F.col("p_size") > 5, F.array(F.struct(F.col("p_brand").alias("code"), F.lit("wider").alias("equivalence"))))
    element = F.struct(s("P", "p_partkey").alias("code"), (F.col("p_size") <= 5).alias("noMap"), target.alias("target"))
    p.groupBy("p_type").agg(F.collect_list(element).alias("element")).select(s("map/", "p_type").alias("url"), F.array(F.struct(F.lit("parts").alias("source"), F.lit("brands").alias("target"), "element")).alias("group")).write.json(path)
    return T.read_fhir_concept_map(v.spark, path)[0].select("code", "target_code", "relationship", "no_map")


@query("write_tables", sql("SELECT 'concepts' AS name, count(*) AS rows FROM concepts UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'members', count(*) FROM members", "concepts", "edges", "members"))
def write_tables(v: Views) -> DataFrame:
    path = new_path(v.spark, "release")
    return W.write_tables({"concepts": v.concepts.drop("module"), "edges": v.edges, "members": v.members}, path, "tpch", "1")


@query("read_tables", sql("""
held AS (
  SELECT 'world' AS system, '1' AS version, code FROM concepts WHERE module IN ('orders', 'customer') AND code NOT LIKE '%3' UNION ALL SELECT 'world', '2', code FROM concepts WHERE module IN ('orders', 'customer')
  UNION ALL SELECT 'parts', '1', code FROM concepts WHERE module = 'part')
SELECT l_orderkey, l_linenumber, l_partkey, code, count(*) FILTER (system = 'world') AS world, count(*) FILTER (system = 'parts') AS parts, max(version) AS newest
FROM (SELECT *, unnest(['O:' || l_orderkey, 'P:' || l_partkey]) AS code FROM lineitem) JOIN held USING (code) GROUP BY ALL""", "concepts"))
def read_tables(v: Views) -> DataFrame:
    """Two systems and two versions are written, one version twice; all are read again and meet the line items in their buckets."""
    path, c = new_path(v.spark, "releases"), v.concepts
    world, parts = c.filter("module IN ('orders', 'customer')"), c.filter("module = 'part'")
    buckets = W.buckets_for(world.count() + parts.count())
    for system, version, rows in (("world", "1", world), ("parts", "1", parts), ("world", "2", world), ("world", "1", world.filter("code NOT LIKE '%3'"))):
        W.write_tables({"concepts": rows.select("code", "display", "active")}, path, system, version, buckets=buckets)
    lines = v.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.explode(F.array(s("O:", "l_orderkey"), s("P:", "l_partkey"))).alias("code"))
    held = W.read_tables(v.spark, path, "concepts")
    found = lines.join(held.hint("merge"), "code")
    count = lambda x: F.count_if(F.col("_system") == x)
    return found.groupBy("l_orderkey", "l_linenumber", "l_partkey", "code").agg(count("world").alias("world"), count("parts").alias("parts"), F.max("_version").alias("newest"))
