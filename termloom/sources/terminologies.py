"""Readers of other release formats: delimited, piped, fixed-length, XML and JSON files into tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.tables import cut

# delimited: laboratory terms


def _csv(spark: SparkSession, path: str, **options: object) -> DataFrame:
    return spark.read.options(header=True, quote='"', escape='"', multiLine=True, **options).csv(path)


def read_loinc(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """concepts (terms, parts, answer lists, answers), edges, properties (every term column by name), links, answers, lists.

    Parts that only the hierarchy file names become concepts with the hierarchy's text.
    """
    terms, parts = _csv(spark, f"{folder}/Loinc.csv"), _csv(spark, f"{folder}/Part.csv")
    tree, links = _csv(spark, f"{folder}/ComponentHierarchyBySystem.csv"), _csv(spark, f"{folder}/LoincPartLink_Primary.csv")
    answers, lists = _csv(spark, f"{folder}/AnswerList.csv"), _csv(spark, f"{folder}/LoincAnswerListLink.csv")
    row = lambda df, code, kind, display, status: df.select(F.col(code).alias("code"), F.lit(kind).alias("kind"), F.col(display).alias("display"), status.alias("active"))
    live = F.upper(F.coalesce("STATUS", F.lit("ACTIVE"))) != "DEPRECATED"
    known = row(terms, "LOINC_NUM", "term", "LONG_COMMON_NAME", live).unionByName(row(parts, "PartNumber", "part", "PartName", F.upper("Status") != "DEPRECATED"))
    named = row(tree.dropDuplicates(["CODE"]), "CODE", "class-part", "CODE_TEXT", F.lit(True)).join(known.select("code"), "code", "left_anti")
    more = row(answers.dropDuplicates(["AnswerListId"]), "AnswerListId", "list", "AnswerListName", F.lit(True)).unionByName(row(answers.dropDuplicates(["AnswerStringId"]), "AnswerStringId", "answer", "DisplayText", F.lit(True)))
    columns = [c for c in terms.columns if c != "LOINC_NUM"]
    properties = terms.unpivot(["LOINC_NUM"], columns, "property", "value_text").withColumnRenamed("LOINC_NUM", "code").filter("value_text IS NOT NULL")
    return {
        "concepts": reduce(DataFrame.unionByName, [known, named, more]),
        "edges": tree.filter("IMMEDIATE_PARENT IS NOT NULL").select(F.col("CODE").alias("child"), F.col("IMMEDIATE_PARENT").alias("parent")).distinct(),
        "properties": properties,
        "links": links.select(F.col("LoincNumber").alias("code"), F.col("PartNumber").alias("part"), F.col("PartTypeName").alias("axis")),
        "parts": parts.select(F.col("PartNumber").alias("part"), F.col("PartName").alias("name")),
        "answers": answers.select(F.col("AnswerListId").alias("list"), F.col("AnswerStringId").alias("answer"), F.col("SequenceNumber").cast("int").alias("sequence")),
        "lists": lists.select(F.col("LoincNumber").alias("code"), F.col("AnswerListId").alias("list")),
    }


def read_loinc_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Designations (code, language, use_code, term) of the linguistic variant files of a release.

    A file's name begins with its language, as nlNL for nl-NL; a file of another name is left out. A
    term's long name, short name and display name are told apart by use_code; empty ones are no rows.
    """
    df = _csv(spark, f"{folder}/*LinguisticVariant.csv").withColumn("_file", F.col("_metadata.file_path"))
    name = F.regexp_extract("_file", r"([^/]*)LinguisticVariant\.csv", 1)
    uses = {"long": "LONG_COMMON_NAME", "short": "SHORTNAME", "display": "LinguisticVariantDisplayName"}
    terms = F.array(*[F.struct(F.lit(use).alias("use_code"), F.col(c).alias("term")) for use, c in uses.items() if c in df.columns])
    language = F.concat_ws("-", F.regexp_extract(name, "^([a-z]{2})[A-Z]{2}", 1), F.regexp_extract(name, "^[a-z]{2}([A-Z]{2})", 1))
    return df.filter(name.rlike("^[a-z]{2}[A-Z]{2}")).select(F.col("LOINC_NUM").alias("code"), language.alias("language"), F.inline(terms)).filter("trim(term) != ''")


# piped: drug atoms

# Places (from 0) of the columns of the piped files.
_CONSO = {"concept": 0, "language": 1, "atom": 7, "source": 11, "type": 12, "source_code": 13, "name": 14, "suppress": 16}
_REL = {"concept1": 0, "atom1": 1, "rel": 3, "concept2": 4, "atom2": 5, "rela": 7, "source_name": 10}
_SAT = {"concept": 0, "atom": 3, "name": 8, "source": 9, "value": 10, "suppress": 11}
_STY = {"concept": 0, "semantic_code": 1, "semantic_type": 3}


def _piped(spark: SparkSession, path: str, places: dict[str, int]) -> DataFrame:
    width = max(places.values()) + 1
    columns = F.split("value", r"\|", -1)
    rows = spark.read.text(path).filter(F.size(columns) >= width)
    return rows.select(*[F.nullif(F.get(columns, F.lit(i)), F.lit("")).alias(n) for n, i in places.items()])


def read_rxnorm(spark: SparkSession, folder: str, own_source: str = "RXNORM", free_sources: tuple[str, ...] = ("RXNORM", "MTHSPL", "CVX", "ATC")) -> dict[str, DataFrame]:
    """atoms, relations, attributes, semantic types: unrestricted sources only, and concepts with an own-source atom."""
    atoms = _piped(spark, f"{folder}/RXNCONSO.RRF", _CONSO).filter(F.col("source").isin(*free_sources))
    own = atoms.filter(F.col("source") == own_source).select("concept").distinct()
    keep = lambda df: df.join(own, "concept", "left_semi")
    atoms = keep(atoms)
    attributes = keep(_piped(spark, f"{folder}/RXNSAT.RRF", _SAT).filter(F.col("source").isin(*free_sources)))
    types = keep(_piped(spark, f"{folder}/RXNSTY.RRF", _STY))
    values = attributes.select(F.col("concept").alias("code"), "name", "value").unionByName(types.select(F.col("concept").alias("code"), F.lit("STY").alias("name"), F.col("semantic_type").alias("value")))
    return {"atoms": atoms, "relations": _piped(spark, f"{folder}/RXNREL.RRF", _REL), "attributes": values.dropna().distinct()}


# fixed-length


def _fixed(df: DataFrame, places: dict[str, tuple[int, int]]) -> DataFrame:
    return df.select(*[F.nullif(F.trim(F.substring("value", start, n)), F.lit("")).alias(name) for name, (start, n) in places.items()])


def read_icd10cm_order(spark: SparkSession, path: str, order: int = 5, code: int = 7) -> DataFrame:
    """(order, code, header, short, long); codes over three characters get their period. order and code are the widths of these fields, for files of more rows than five digits number."""
    flag = order + code + 3
    df = _fixed(spark.read.text(path), {"order": (1, order), "code": (order + 2, code), "flag": (flag, 1), "short": (flag + 2, 60), "long": (flag + 63, 400)})
    code = F.when(F.length("code") > 3, F.concat(F.substring("code", 1, 3), F.lit("."), F.expr("substring(code, 4)"))).otherwise(F.col("code"))
    return df.select(F.col("order").cast("long").alias("order"), code.alias("code"), (F.col("flag") == "0").alias("header"), "short", "long")


def read_product_ladder(spark: SparkSession, path: str, places: dict[str, tuple[int, int]], length: int) -> DataFrame:
    """Records of a fixed length, by name and (start, length); others, and removed ones (mutation 9), are left out; ended ones are inactive."""
    df = _fixed(spark.read.text(path).filter(F.length("value") == length), places)
    df = df.filter(F.coalesce(F.col("mutation") != "9", F.lit(True))) if "mutation" in places else df
    return df.withColumn("active", F.col("ended").isNull()) if "ended" in places else df


# Files of the product ladder with their record length and the places (from 1) of their fields.
LADDER: dict[str, tuple[str, int, dict[str, tuple[int, int]]]] = {
    "gpk": ("BST711T", 160, {"code": (6, 8), "name": (34, 7), "substance": (41, 7), "strength": (48, 25), "form_list": (22, 3), "form": (25, 3), "route_list": (28, 3), "route": (31, 3), "atc": (119, 8)}),
    "prk": ("BST052T", 128, {"code": (6, 8), "name": (14, 7), "parent": (21, 8), "unit_list": (49, 4), "unit": (53, 6)}),
    "hpk": ("BST031T", 480, {"code": (6, 8), "parent": (14, 8), "name": (30, 7), "brand": (37, 50), "firm": (87, 50)}),
    "article": ("BST004T", 320, {"code": (6, 8), "parent": (14, 8), "name": (22, 7), "removed": (151, 8)}),
    "names": ("BST020T", 160, {"code": (6, 7), "label": (19, 27), "short": (46, 40), "preferred": (86, 50)}),
    "items": ("BST902T", 128, {"list": (6, 4), "code": (10, 6), "text": (62, 50)}),
}
_NUMBERS = {"code", "name", "parent", "substance", "list", "removed", "form_list", "form", "route_list", "route", "unit_list", "unit"}


def read_ladder(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """products (code, kind, active), names (code, kind, use_code, term), properties (code, kind, property, value_text), rungs (code, kind, prk, gpk) of a ladder's files.

    Records that are removed (mutation 9) or have no code are left out; shorter ones are an error. Codes
    and numbers lose their leading zeros. Names are looked up by number, an equal one counts once;
    forms, routes and units by list and item, where an unknown item stands for itself. An article
    that is taken off the market is inactive. A product's rungs are all those above it.
    """

    def records(kind: str) -> DataFrame:
        file, length, places = LADDER[kind]
        lines = spark.read.option("encoding", "ISO-8859-1").text(f"{folder}/{file}").filter(F.trim("value") != "")
        short = F.raise_error(F.lit(f"a record of {file} is shorter than {length}")).cast("string")
        lines = lines.withColumn("value", F.when(F.length("value") >= length, F.col("value")).otherwise(short))
        df = _fixed(lines, {"mutation": (5, 1), **places}).filter(F.coalesce(F.col("mutation") != "9", F.lit(True)))
        number = lambda c: F.when(F.regexp_like(c, F.lit("^[0-9]*[1-9][0-9]*$")), F.ltrim(F.col(c), F.lit("0")))
        text = lambda c: F.regexp_replace(c, " +", " ")
        return df.select(*[(number(c) if c in _NUMBERS else text(c)).alias(c) for c in places]).filter("code IS NOT NULL")

    held = {kind: records(kind) for kind in LADDER}
    names = held["names"].select(F.col("code").alias("name"), "preferred", "short", "label")
    items = held["items"].select(F.col("list").alias("_list"), F.col("code").alias("_item"), F.col("text").alias("_text"))
    kinds = ("gpk", "prk", "hpk", "article")
    every = {k: held[k].withColumn("kind", F.lit(k)) for k in kinds}
    products = reduce(DataFrame.unionByName, [df.select("code", "kind", (F.col("removed").isNull() if k == "article" else F.lit(True)).alias("active")) for k, df in every.items()])

    use = lambda c, *before: F.struct(F.lit(c).alias("use_code"), F.when(reduce(lambda a, b: a & b, [~F.col(c).eqNullSafe(F.col(b)) for b in before], F.lit(True)), F.col(c)).alias("term"))
    by_number = reduce(DataFrame.unionByName, [df.select("code", "kind", "name") for df in every.values()]).join(names, "name")
    named = by_number.select("code", "kind", F.inline(F.array(use("preferred"), use("short", "preferred"), use("label", "preferred", "short")))).filter("term IS NOT NULL")

    up = lambda k, column: held[k].select(F.col("code").alias(column), F.col("parent").alias("gpk" if k == "prk" else "prk"))
    none = F.lit(None).cast("string")
    hpk = every["hpk"].select("code", "kind", none.alias("hpk"), F.col("parent").alias("prk")).join(up("prk", "prk"), "prk", "left")
    article = every["article"].select("code", "kind", F.col("parent").alias("hpk")).join(up("hpk", "hpk"), "hpk", "left").join(up("prk", "prk"), "prk", "left")
    prk = every["prk"].select("code", "kind", none.alias("hpk"), none.alias("prk"), F.col("parent").alias("gpk"))
    rungs = prk.unionByName(hpk).unionByName(article)

    def listed(kind: str, column: str) -> DataFrame:
        found = every[kind].filter(F.col(column).isNotNull() & F.col(f"{column}_list").isNotNull())
        found = found.join(items, (F.col(f"{column}_list") == F.col("_list")) & (F.col(column) == F.col("_item")), "left")
        return found.select("code", "kind", F.lit(column).alias("property"), F.coalesce("_text", column).alias("value_text"))

    own = lambda kind, column: every[kind].select("code", "kind", F.lit(column).alias("property"), F.col(column).alias("value_text")).filter("value_text IS NOT NULL")
    substance = every["gpk"].join(names.select(F.col("name").alias("substance"), "preferred"), "substance").select("code", "kind", F.lit("substance").alias("property"), F.col("preferred").alias("value_text")).filter("value_text IS NOT NULL")
    properties = reduce(DataFrame.unionByName, [substance, own("gpk", "strength"), own("gpk", "atc"), listed("gpk", "form"), listed("gpk", "route"), listed("prk", "unit"), own("hpk", "brand"), own("hpk", "firm"), own("article", "removed")])
    return {"products": products, "names": named, "properties": properties, "rungs": rungs}


# classifications


def read_atc(spark: SparkSession, path: str, delimiter: str = ",") -> tuple[DataFrame, DataFrame]:
    """Classes (code, title) and dose rubrics (code, ddd, unit, route, note), which repeat a code."""
    df = _csv(spark, path, sep=delimiter).toDF("code", "title", "ddd", "unit", "route", "note")
    classes = df.groupBy("code").agg(F.min("title").alias("title"))
    return classes, df.filter("ddd IS NOT NULL").select("code", "ddd", "unit", "route", "note")


_CLAML = """_code string, _kind string, SuperClass array<struct<_code:string>>, ModifiedBy array<struct<_code:string>>, ExcludeModifier array<struct<_code:string>>,
Rubric array<struct<_kind:string,Label:array<struct<_VALUE:string,`_xml:lang`:string>>>>"""


def read_claml(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """classes (code, kind, parent), rubrics (code, kind, language, text), modified_by, exclusions of a classification file."""
    df = spark.read.format("xml").option("rowTag", "Class").schema(_CLAML).load(path)
    some = lambda c: F.explode_outer(F.col(c)).alias("_x")
    rubrics = df.select(F.col("_code").alias("code"), F.explode("Rubric").alias("r")).select("code", F.col("r._kind").alias("kind"), F.explode("r.Label").alias("l"))
    return {
        "classes": df.select(F.col("_code").alias("code"), F.col("_kind").alias("kind"), some("SuperClass")).select("code", "kind", F.col("_x._code").alias("parent")),
        "rubrics": rubrics.select("code", "kind", F.col("l.`_xml:lang`").alias("language"), F.trim("l._VALUE").alias("text")),
        "modified_by": df.select(F.col("_code").alias("code"), F.explode("ModifiedBy").alias("_x")).select("code", F.col("_x._code").alias("modifier")),
        "exclusions": df.select(F.col("_code").alias("code"), F.explode("ExcludeModifier").alias("_x")).select("code", F.col("_x._code").alias("suffix")),
    }


# thesaurus deliveries


# Kinds of terms, flag columns of concepts, and kinds of relations.
TERM_KINDS = {"voorkeursterm": "preferred", "synoniem": "synonym", "pvo": "pvo", "pvt": "pvt", "fsn": "fsn", "zoekterm": "search"}
FLAGS = {"Complicatie": "complication", "GebruiktImplantaat": "implant", "Gradatie": "grading", "Lateraliteit": "laterality", "LOINCCode": "loinc"}
RELATIONS = {"vervanging": "replaced-by", "splitsing": "split-into"}
#: Tables of a delivery besides concepts and terms.
LINK_TABLES = ("ThesaurusConceptRelaties", "Parapluterm", "ThesaurusConceptRol", "AfleidingICD10", "AfleidingDBC", "AfleidingZA", "CodeMapping")


def read_thesaurus(spark: SparkSession, folder: str, delivery: int, tables: tuple[str, ...] = LINK_TABLES) -> dict[str, DataFrame]:
    """concepts (code, kind, active), terms (code, use_code, language, term), rubrics (code, kind, text), links (code, kind, place, target) of a delivery of quoted tables.

    A row is current where it has no end, one in 2099, or one not before the delivery. Concepts that are
    not are inactive; other rows that are not are left out, but for relations. Rubrics are the flags
    of concepts. Links are replacements, splits, umbrella terms, roles, derivations and code
    mappings of known concepts; a term's own foreign id is a link too (snomed).
    """

    def read(name: str, *wanted: str) -> DataFrame:
        df = _csv(spark, f"{folder}/{name}.csv")
        return df.select("*", *[F.lit(None).cast("string").alias(c) for c in wanted if c not in df.columns])

    def current(df: DataFrame) -> Column:
        end = F.col("Einddatum") if "Einddatum" in df.columns else F.lit(None).cast("string")
        return end.isNull() | F.startswith(end, F.lit("2099")) | (end.cast("int") >= delivery)

    def mapped(c: str, names: dict[str, str]) -> Column:
        return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.lower(c)]

    concepts = read("ThesaurusConcept")
    flags = [c for c in FLAGS if c in concepts.columns]
    rubrics = concepts.select(F.col("ConceptID").alias("code"), F.inline(F.array(*[F.struct(F.lit(FLAGS[c]).alias("kind"), F.col(c).alias("text")) for c in flags]))).filter("text IS NOT NULL") if flags else spark.createDataFrame([], "code string, kind string, text string")
    codes = concepts.select(F.col("ConceptID").alias("code"), F.col("TypeConcept").alias("kind"), current(concepts).alias("active"))
    terms = read("ThesaurusTerm", "TaalCode", "SnomedID")
    terms = terms.filter(current(terms)).withColumn("use_code", mapped("TypeTerm", TERM_KINDS)).filter("use_code IS NOT NULL").join(codes.select(F.col("code").alias("ConceptID")), "ConceptID", "left_semi")
    link = lambda df, code, kind, target, place=F.lit(None): df.select(F.col(code).alias("code"), kind.alias("kind"), place.cast("int").alias("place"), target.alias("target"))
    links = [link(terms.filter("use_code = 'fsn' AND SnomedID IS NOT NULL"), "ConceptID", F.lit("snomed"), F.col("SnomedID"))]
    note = lambda c, form: F.when(F.col(c).isNull(), "").otherwise(F.format_string(form, c))
    if "ThesaurusConceptRelaties" in tables:
        links.append(link(read("ThesaurusConceptRelaties"), "ConceptID1", mapped("TypeRelatie", RELATIONS), F.col("ConceptID2")))
    if "Parapluterm" in tables:
        df = read("Parapluterm")
        links.append(link(df.filter(current(df)), "ConceptID2", F.lit("umbrella"), F.col("ConceptID1")))
    if "ThesaurusConceptRol" in tables:
        df = read("ThesaurusConceptRol", "SpecialismeGroepCode")
        named = df.filter(current(df) & F.col("Rolnaam").isNotNull() & F.col("Rolwaarde").isNotNull())
        links.append(link(named, "ConceptID", F.lit("role"), F.concat("Rolnaam", F.lit("="), "Rolwaarde", note("SpecialismeGroepCode", " [%s]"))))
    if "AfleidingICD10" in tables:
        df = read("AfleidingICD10", "Volgnummer")
        links.append(link(df.filter(current(df)), "ConceptID", F.lit("icd10"), F.col("ICD10"), F.col("Volgnummer")))
    for table, kind, column in (("AfleidingDBC", "dbc", "DBC_ID"), ("AfleidingZA", "za", "ZA_Code")):
        if table in tables:
            df = read(table, "SpecialismeCode")
            links.append(link(df.filter(current(df)), "ConceptID", F.lit(kind), F.concat(column, note("SpecialismeCode", " (%s)"))))
    if "CodeMapping" in tables:
        df = read("CodeMapping")
        links.append(link(df.filter(current(df)), "ConceptID", F.lit("mapping"), F.concat("Codestelsel", F.lit(": "), "Code")))
    joined = reduce(DataFrame.unionByName, links).filter("code IS NOT NULL AND kind IS NOT NULL AND target IS NOT NULL").join(codes.select("code"), "code", "left_semi").distinct()
    shown = terms.select(F.col("ConceptID").alias("code"), "use_code", F.coalesce("TaalCode", F.lit("nl-NL")).alias("language"), F.trim(F.regexp_replace("Omschrijving", r"\s+", " ")).alias("term")).filter("term IS NOT NULL")
    return {"concepts": codes, "rubrics": rubrics, "terms": shown, "links": joined}


def thesaurus_maps(links: DataFrame, equivalent: str, wider: str) -> DataFrame:
    """Links (code, target_code, target, kind) as elements of two maps, `equivalent` and `wider`."""
    name = F.when(F.col("kind") == equivalent, "equivalent").when(F.col("kind") == wider, "wider")
    return links.withColumn("map", name).filter("map IS NOT NULL").select("map", F.lit(0).alias("group_no"), "code", "target", "target_code", F.when(F.col("map") == "equivalent", "equivalent").otherwise("source-is-narrower-than-target").alias("relationship"), F.lit(False).alias("no_map"))


# laboratory publications


_LAB = "_status string, loincConcept struct<_loinc_num:string,_status:string,component:string,property:string,timing:string,system:string,scale:string>, ordinals array<struct<_code:string,_value:string>>"


def read_labcodeset(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The active value set, properties (as a supplement) and one value set per ordinal list."""
    df = spark.read.format("xml").option("rowTag", "lab_concept").schema(_LAB).load(path)
    code = F.col("loincConcept._loinc_num").alias("code")
    props = df.select(code, F.lit(None).cast("string").alias("_none"), *[F.col(f"loincConcept.{p}").alias(p) for p in ("component", "property", "timing", "system", "scale")])
    long = props.drop("_none").withColumnRenamed("property", "kind_of_property").unpivot(["code"], ["component", "kind_of_property", "timing", "system", "scale"], "property", "value_text").filter("value_text IS NOT NULL")
    return {
        "value_set": df.filter((F.col("_status") == "active") & (F.col("loincConcept._status") != "DEPRECATED")).select(code).distinct(), "properties": long,
        "ordinals": df.select(F.concat(F.lit("ordinal/"), F.col("loincConcept._loinc_num")).alias("url"), F.posexplode("ordinals").alias("place", "o")).select("url", "place", F.col("o._code").alias("code"), F.col("o._value").alias("value")),
    }


# entity caches and resources in JSON


_ENTITY = """`@id` string, code string, classKind string, parent array<string>, child array<string>, title struct<`@value`:string,`@language`:string>, indexTerm array<struct<label:struct<`@value`:string,`@language`:string>>>,
postcoordinationScale array<struct<axisName:string,requiredPostcoordination:boolean,scaleEntity:array<string>>>"""


def read_icd11_cache(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """concepts, edges (several parents; those outside the cache dropped), designations and axis scales of cached entities, one JSON object a line."""
    df = spark.read.schema(_ENTITY).json(path).withColumn("id", F.col("`@id`"))
    key = F.coalesce("code", "id")
    names = df.select("id", key.alias("key"))
    edges = df.select(key.alias("child"), F.explode("parent").alias("id")).join(names, "id").select("child", F.col("key").alias("parent"))
    scales = df.select(key.alias("stem"), F.posexplode("postcoordinationScale").alias("declared", "s")).select("stem", "declared", F.col("s.axisName").alias("axis"), F.coalesce("s.requiredPostcoordination", F.lit(False)).alias("required"), F.explode("s.scaleEntity").alias("id"))
    return {
        "concepts": df.select(key.alias("code"), F.col("classKind").alias("kind"), F.col("title.`@value`").alias("display")), "edges": edges,
        "designations": df.select(key.alias("code"), F.explode("indexTerm").alias("t")).select("code", F.col("t.label.`@value`").alias("term"), F.col("t.label.`@language`").alias("language")),
        "scales": scales.join(names, "id").select("stem", "axis", "required", "declared", F.col("key").alias("entity")),
    }


def _concept_type(depth: int) -> str:
    """A concept with depth levels below it as structs, and what is nested in the last of them as JSON text."""
    inner = f"array<{_concept_type(depth - 1)}>" if depth else "string"
    return f"struct<code:string,display:string,definition:string,designation:array<struct<language:string,value:string>>,property:array<struct<code:string,valueCode:string,valueString:string,valueBoolean:boolean,valueInteger:bigint>>,concept:{inner}>"


def read_fhir_code_system(spark: SparkSession, path: str, depth: int = 6) -> dict[str, DataFrame]:
    """concepts (url, version, code, display, definition, parent), edges, properties, designations, systems, problems of CodeSystem resources, one a line.

    Nesting is unrolled by plan to a depth, and below it level by level until no concept has children.
    Parents are the enclosing concept and the codes of parent and subsumedBy properties. Supplements
    (content supplement) are marked. problems (url, version, code, parent, reason) has codes that a
    system defines twice (duplicate-code) and parents that a system, no supplement, does not define (unknown-parent).
    """
    schema = f"url string, version string, name string, content string, caseSensitive boolean, supplements string, concept array<{_concept_type(depth)}>"
    df = spark.read.schema(schema).json(path)
    level = df.select("url", "version", "content", F.lit(None).cast("string").alias("parent"), F.explode("concept").alias("c"))
    levels = []

    def take(level: DataFrame) -> None:
        levels.append(level.select("url", "version", "content", "parent", *[F.col(f"c.{n}").alias(n) for n in ("code", "display", "definition", "designation", "property")]))

    for _ in range(depth):
        take(level)
        level = level.select("url", "version", "content", F.col("c.code").alias("parent"), F.explode("c.concept").alias("c"))
    take(level)
    while True:
        below = level.filter("c.concept IS NOT NULL").select("url", "version", "content", F.col("c.code").alias("parent"), F.explode(F.from_json("c.concept", f"array<{_concept_type(0)}>")).alias("c"))
        level = cut(below, "concepts")
        if level.isEmpty():
            break
        take(level)
    all_rows = reduce(DataFrame.unionByName, levels)
    rows = all_rows.drop("content")
    value = F.coalesce("p.valueCode", "p.valueString", F.col("p.valueBoolean").cast("string"), F.col("p.valueInteger").cast("string"))
    properties = rows.select("url", "version", "code", F.explode("property").alias("p")).select("url", "version", "code", F.col("p.code").alias("property"), value.alias("value_text"))
    nested = rows.filter("parent IS NOT NULL").select("url", "version", F.col("code").alias("child"), "parent")
    stated = properties.filter("property IN ('parent', 'subsumedBy')").select("url", "version", F.col("code").alias("child"), F.col("value_text").alias("parent"))
    twice = rows.groupBy("url", "version", "code").count().filter("count > 1").select("url", "version", "code", F.lit(None).cast("string").alias("parent"), F.lit("duplicate-code").alias("reason"))
    named = all_rows.filter("content IS NULL OR content != 'supplement'").select("url", "version", "code", F.explode("property").alias("p")).filter("p.code IN ('parent', 'subsumedBy')").select("url", "version", "code", value.alias("parent"))
    have = rows.select(F.col("url").alias("_url"), F.col("version").alias("_version"), F.col("code").alias("_code")).distinct()
    unknown = named.join(have, F.col("url").eqNullSafe(F.col("_url")) & F.col("version").eqNullSafe(F.col("_version")) & (F.col("parent") == F.col("_code")), "left_anti")
    return {
        "systems": df.select(F.col("url").alias("system"), "version", "name", F.coalesce("content", F.lit("complete")).alias("content"), F.coalesce("caseSensitive", F.lit(True)).alias("case_sensitive"), "supplements"),
        "concepts": rows.drop("designation", "property"), "edges": nested.unionByName(stated).distinct(), "properties": properties,
        "designations": rows.select("url", "version", "code", F.explode("designation").alias("d")).select("url", "version", "code", F.col("d.language").alias("language"), F.col("d.value").alias("term")),
        "problems": twice.unionByName(unknown.distinct().withColumn("reason", F.lit("unknown-parent"))),
    }


_SET = "array<struct<system:string,version:string,concept:array<struct<code:string,display:string>>,filter:array<struct<property:string,op:string,value:string>>,valueSet:array<string>>>"


def read_fhir_value_set(spark: SparkSession, path: str) -> DataFrame:
    """Compose rules, one row a listed concept, filter or reference, of ValueSet resources, one a line."""
    df = spark.read.schema(f"url string, version string, compose struct<include:{_SET},exclude:{_SET}>").json(path)
    sides = [df.select("url", F.lit(s).alias("side"), F.posexplode(f"compose.{s}").alias("rule_no", "r")) for s in ("include", "exclude")]
    rules = reduce(DataFrame.unionByName, sides).select("url", "side", "rule_no", F.col("r.system").alias("system"), F.col("r.version").alias("system_version"), "r")
    head, null = ["url", "side", "rule_no", "system", "system_version"], lambda k="string": F.lit(None).cast(k)

    def rows(df: DataFrame, concept_no: Column, code: Column, display: Column, filter_no: Column, prop: Column, op: Column, value: Column, ref: Column) -> DataFrame:
        return df.select(*head, concept_no.alias("concept_no"), code.alias("code"), display.alias("display"), filter_no.alias("filter_no"), prop.alias("property"), op.alias("op"), value.alias("value"), ref.alias("ref_url"))

    n, i = null(), null("int")
    listed = rows(rules.select(*head, F.posexplode("r.concept").alias("i", "x")), F.col("i"), F.col("x.code"), F.col("x.display"), i, n, n, n, n)
    filters = rows(rules.select(*head, F.posexplode("r.filter").alias("i", "x")), i, n, n, F.col("i"), F.col("x.property"), F.col("x.op"), F.col("x.value"), n)
    refs = rows(rules.select(*head, F.explode("r.valueSet").alias("x")), i, n, n, i, n, n, n, F.col("x"))
    empty = (F.coalesce(F.size("r.concept"), F.lit(0)) <= 0) & (F.coalesce(F.size("r.filter"), F.lit(0)) <= 0) & (F.coalesce(F.size("r.valueSet"), F.lit(0)) <= 0)
    return reduce(DataFrame.unionByName, [listed, filters, refs, rows(rules.filter(empty), i, n, n, i, n, n, n, n)])


def read_fhir_concept_map(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Flat map elements, one row a target (or a stated no-map), and unmapped rules, of ConceptMap resources, one a line."""
    from termloom.operators.codes import relationship

    target = "array<struct<code:string,display:string,relationship:string,equivalence:string>>"
    df = spark.read.schema(f"url string, version string, `group` array<struct<source:string,target:string,element:array<struct<code:string,noMap:boolean,target:{target}>>,unmapped:struct<mode:string,code:string,relationship:string,otherMap:string>>>").json(path)
    groups = df.select(F.col("url").alias("map"), F.posexplode("group").alias("group_no", "g"))
    elements = groups.select("map", "group_no", F.col("g.source").alias("source"), F.col("g.target").alias("target"), F.posexplode("g.element").alias("element_no", "e"))
    flat = elements.select("map", "group_no", "source", "target", "element_no", F.col("e.code").alias("code"), F.coalesce("e.noMap", F.lit(False)).alias("no_map"), F.posexplode_outer("e.target").alias("target_no", "t"))
    flat = flat.select("map", "group_no", "source", "target", "element_no", "code", "no_map", "target_no", F.col("t.code").alias("target_code"), F.col("t.display").alias("target_display"), relationship(F.coalesce("t.relationship", "t.equivalence")).alias("relationship"))
    rules = groups.filter("g.unmapped IS NOT NULL").select("map", "group_no", F.col("g.source").alias("source"), F.col("g.target").alias("target"), F.col("g.unmapped.mode").alias("mode"), F.col("g.unmapped.code").alias("fixed_code"), F.col("g.unmapped.relationship").alias("relationship"), F.col("g.unmapped.otherMap").alias("other_map"))
    return flat, rules
