"""Release format 2 files: components, reference sets, manifest, and the tables built from them.

Paths may name files or folders; a folder written by Spark under a release file's name counts as
that file.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of the component files, in order.
COMPONENTS = {
    "Concept": "id string, effectiveTime int, active int, moduleId string, definitionStatusId string",
    "Description": "id string, effectiveTime int, active int, moduleId string, conceptId string, languageCode string, typeId string, term string, caseSignificanceId string",
    "TextDefinition": "id string, effectiveTime int, active int, moduleId string, conceptId string, languageCode string, typeId string, term string, caseSignificanceId string",
    "Relationship": "id string, effectiveTime int, active int, moduleId string, sourceId string, destinationId string, relationshipGroup int, typeId string, characteristicTypeId string, modifierId string",
    "RelationshipConcreteValues": "id string, effectiveTime int, active int, moduleId string, sourceId string, value string, relationshipGroup int, typeId string, characteristicTypeId string, modifierId string",
    "Identifier": "alternateIdentifier string, effectiveTime int, active int, moduleId string, identifierSchemeId string, referencedComponentId string",
}
MEMBER = ["id", "effectiveTime", "active", "moduleId", "refsetId", "referencedComponentId"]
# Identifiers that the format itself uses.
IS_A = "116680003"
INFERRED = "900000000000011006"
PREFERRED = "900000000000548007"
ACCEPTABLE = "900000000000549004"
#: A set's kind by the names of its further columns.
KINDS = {
    ("acceptabilityId",): "language", ("targetComponentId",): "association", ("valueId",): "attribute-value", ("mapTarget",): "simple-map", ("owlExpression",): "owl",
    ("sourceEffectiveTime", "targetEffectiveTime"): "module-dependency", ("mapGroup", "mapPriority", "mapRule", "mapAdvice", "mapTarget", "correlationId", "mapCategoryId"): "extended-map",
    ("attributeDescription", "attributeType", "attributeOrder"): "descriptor", ("descriptionFormat", "descriptionLength"): "description-type", (): "simple",
}


class ReleaseError(ValueError):
    pass


def _tsv(spark: SparkSession):  # noqa: ANN202
    return spark.read.option("sep", "\t").option("quote", "").option("header", True).option("encoding", "UTF-8")


def read_component(spark: SparkSession, folder: str, kind: str, release_type: str = "Snapshot") -> DataFrame:
    """One component table; a header that is not the fixed one is an error when the rows are read. active is a boolean."""
    df = _tsv(spark).schema(COMPONENTS[kind]).option("enforceSchema", False).option("mode", "FAILFAST").csv(f"{folder}/sct2_{kind}_*{release_type}*")
    return df.withColumn("active", F.col("active") == 1).withColumn("file", F.col("_metadata.file_path"))


def read_components(spark: SparkSession, folder: str, release_type: str = "Snapshot", kinds: list[str] | None = None) -> dict[str, DataFrame]:
    return {k: read_component(spark, folder, k, release_type) for k in kinds or COMPONENTS}


def release_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(path, prefix, content, summary, release_type, namespace, date) of the release files below a folder."""
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    name = r"(sct2|der2)_([A-Za-z]+)_([A-Za-z-]*?)(Snapshot|Full|Delta)[A-Za-z_-]*_([A-Z0-9]+)_(\d{8})\.txt"
    part = lambda i: F.regexp_extract("path", name, i)
    return paths.filter(F.col("path").rlike(name)).select("path", part(1).alias("prefix"), part(2).alias("content"), part(3).alias("summary"), part(4).alias("release_type"), part(5).alias("namespace"), part(6).cast("int").alias("date"))


def check_manifest(manifest: DataFrame, release_type: str = "Snapshot") -> int:
    """The release date; files of no such type, or of several dates, are refused."""
    dates = [r[0] for r in manifest.filter(F.col("release_type") == release_type).select("date").distinct().limit(3).collect()]
    if not dates:
        raise ReleaseError(f"no {release_type} files")
    if len(dates) > 1:
        raise ReleaseError(f"files of several dates: {sorted(dates)}")
    return dates[0]


def read_refsets(spark: SparkSession, folder: str, release_type: str = "Snapshot") -> DataFrame:
    """refset_id, member_id, code, active, effective_time, module, kind, fields (map of the further columns) of all member files.

    Column names come from headers and their kinds (c, i, s) from file names; a file whose header
    has fewer or other fixed columns, or another number of further ones than its name says, is refused.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    paths = [r[0] for r in files.filter(F.col("path").rlike(rf"der2_[cis]*Refset_.*{release_type}")).collect()]  # one row a file
    groups: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        names = _tsv(spark).csv(path).columns
        kinds = re.search(r"der2_([cis]*)Refset_", path)[1]
        if names[:6] != MEMBER or len(names) - 6 != len(kinds):
            raise ReleaseError(f"{path} does not have the columns its name says")
        groups.setdefault(tuple(names), []).append(path)
    parts = []
    for names, own in groups.items():
        extra = names[6:]
        df = _tsv(spark).schema(", ".join(f"`{n}` string" for n in names)).option("enforceSchema", False).csv(own)
        fields = F.map_from_arrays(F.array(*[F.lit(n) for n in extra]), F.array(*[F.col(n) for n in extra])) if extra else F.create_map().cast("map<string,string>")
        parts.append(df.select(F.col("refsetId").alias("refset_id"), F.col("id").alias("member_id"), F.col("referencedComponentId").alias("code"), (F.col("active") == "1").alias("active"),
                               F.col("effectiveTime").cast("int").alias("effective_time"), F.col("moduleId").alias("module"), F.lit(KINDS.get(extra, "other")).alias("kind"), fields.alias("fields")))
    if not parts:
        raise ReleaseError("no reference set files")
    return reduce(DataFrame.unionByName, parts)


def refset_view(members: DataFrame, kind: str) -> DataFrame:
    """Typed view of the members of one kind of set: its fields as columns, numbers and dates as integers."""
    names = next(n for n, k in KINDS.items() if k == kind)
    whole = {"mapGroup", "mapPriority", "attributeOrder", "sourceEffectiveTime", "targetEffectiveTime", "descriptionLength"}
    cast = lambda n: F.col("fields")[n].cast("int") if n in whole else F.col("fields")[n]
    return members.filter(F.col("kind") == kind).select("refset_id", "member_id", "code", "active", "effective_time", "module", *[cast(n).alias(n) for n in names])


# table builds


def inferred_only(relationships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Inferred rows, and the number of the others by their characteristic type."""
    return relationships.filter(F.col("characteristicTypeId") == INFERRED), relationships.filter(F.col("characteristicTypeId") != INFERRED).groupBy("characteristicTypeId").count()


def build_concepts(layers: list[DataFrame]) -> DataFrame:
    """One row a concept; the first layer (the edition) wins over packages on top of it."""
    ranked = reduce(DataFrame.unionByName, [df.withColumn("_rank", F.lit(i)) for i, df in enumerate(layers)])
    rest = F.struct("active", F.col("effectiveTime").alias("effective_time"), F.col("moduleId").alias("module"), F.col("definitionStatusId").alias("definition_status"))
    return ranked.groupBy(F.col("id").alias("code")).agg(F.min_by(rest, "_rank").alias("_row")).select("code", "_row.*")


def build_edges_attributes(relationships: DataFrame, concrete: DataFrame, concepts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, attributes, dangling ids) of active inferred rows; #numbers and "text" of concrete rows are parsed."""
    inferred = inferred_only(relationships)[0].filter("active")
    edges = inferred.filter(F.col("typeId") == IS_A).select(F.col("sourceId").alias("child"), F.col("destinationId").alias("parent"))
    null = F.lit(None).cast("string")
    typed = inferred.filter(F.col("typeId") != IS_A).select(F.col("sourceId").alias("source"), F.col("relationshipGroup").alias("role_group"), F.col("id").alias("row_id"), F.col("typeId").alias("kind"), F.col("destinationId").alias("target"), F.lit(None).cast("double").alias("number"), null.alias("text"))
    value = F.col("value")
    plain = inferred_only(concrete)[0].filter("active").select(
        F.col("sourceId").alias("source"), F.col("relationshipGroup").alias("role_group"), F.col("id").alias("row_id"), F.col("typeId").alias("kind"), null.alias("target"),
        F.when(F.startswith(value, F.lit("#")), F.substring(value, 2, 100).try_cast("double")).alias("number"), F.when(F.startswith(value, F.lit('"')), F.regexp_replace(value, '^"|"$', "")).alias("text"),
    )
    attributes = typed.unionByName(plain)
    used = edges.select("child").union(edges.select("parent")).union(attributes.select("source")).union(attributes.filter("target IS NOT NULL").select("target")).toDF("code").distinct()
    return edges, attributes, used.join(concepts.select("code"), "code", "left_anti")


def build_designations(descriptions: DataFrame, concepts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Descriptions under their concepts, and those of absent concepts."""
    rows = descriptions.select(F.col("id").alias("designation_id"), F.col("conceptId").alias("code"), "term", F.col("languageCode").alias("language"), F.col("typeId").alias("use_code"), "active", F.col("effectiveTime").alias("effective_time"), F.col("moduleId").alias("module"))
    return rows.join(concepts.select("code"), "code", "left_semi"), rows.join(concepts.select("code"), "code", "left_anti")


def build_acceptability(members: DataFrame, designations: DataFrame) -> DataFrame:
    rows = refset_view(members, "language").filter("active").withColumnRenamed("code", "designation_id")
    name = F.when(F.col("acceptabilityId") == PREFERRED, "preferred").when(F.col("acceptabilityId") == ACCEPTABLE, "acceptable")
    return rows.join(designations.select("designation_id"), "designation_id", "left_semi").select("designation_id", "refset_id", name.alias("acceptability")).filter("acceptability IS NOT NULL")


def build_members(members: DataFrame, concepts: DataFrame) -> DataFrame:
    """Active members of content sets; concept_fields names the fields whose value is a known concept."""
    rows = members.filter("active AND kind NOT IN ('language', 'module-dependency', 'descriptor', 'description-type', 'owl')")
    spread = rows.select("member_id", F.explode("fields").alias("name", "value")).join(concepts.select(F.col("code").alias("value")), "value", "left_semi")
    tagged = spread.groupBy("member_id").agg(F.sort_array(F.collect_set("name")).alias("concept_fields"))
    return rows.join(tagged, "member_id", "left").withColumn("concept_fields", F.coalesce("concept_fields", F.array().cast("array<string>")))


def build_identifiers(identifiers: DataFrame, concepts: DataFrame) -> DataFrame:
    rows = identifiers.filter("active").select(F.col("identifierSchemeId").alias("scheme"), F.col("alternateIdentifier").alias("alt_code"), F.col("referencedComponentId").alias("code"))
    return rows.join(concepts.select("code"), "code", "left_semi")


