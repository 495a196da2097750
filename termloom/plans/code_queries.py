"""Registered queries for search and bulk code operations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions.text import same_language, tokens
from termloom.operators import codes as K
from termloom.operators import search as S
from termloom.operators import valuesets as VS
from termloom.plans.driver_views import Views, sql
from termloom.plans.registry import query
from termloom.plans.valueset_queries import Sets

_WORDS = r"list_filter(string_split_regex(strip_accents(lower({0})), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


@query("tokenize", f"SELECT doc_id, list_sort(list_distinct({_WORDS.format('text')})) AS words FROM documents")
def tokenize(v: Views) -> DataFrame:
    return v.raw("documents").select("doc_id", tokens(F.col("text")).alias("words"))


@query("inverted_index", f"SELECT word, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT doc_id, unnest(list_distinct({_WORDS.format('text')})) AS word FROM documents) GROUP BY word")
def inverted_index(v: Views) -> DataFrame:
    docs = v.raw("documents").select("doc_id", F.col("text").alias("term"))
    return S.inverted_index(docs, "doc_id").groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


def _asked(v: Views) -> DataFrame:
    """A query for every part whose key is divisible by 100: the first three letters of its name's two words, the second first."""
    w = F.split("p_name", " ")
    text = F.concat_ws(" ", F.substring(F.get(w, F.lit(1)), 1, 3), F.upper(F.substring(F.get(w, F.lit(0)), 1, 3)))
    return v.raw("part").filter("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), text.alias("text"))


def _asked_sql(text: str) -> str:
    """The words of what is asked (text of a row of part), the words of terms, and the hits."""
    return f"""
asked AS (SELECT query_id, unnest(list_distinct({_WORDS.format('text')})) AS start FROM (SELECT p_partkey AS query_id, {text} AS text FROM part WHERE p_partkey % 100 = 0)),
words AS (SELECT designation_id, code, term, unnest(list_distinct({_WORDS.format('term')})) AS word FROM designations WHERE active),
hits AS (SELECT query_id, designation_id, any_value(code) AS code, any_value(term) AS term FROM asked JOIN words ON starts_with(word, start)
  GROUP BY query_id, designation_id HAVING count(DISTINCT start) = (SELECT count(*) FROM asked a WHERE a.query_id = asked.query_id))"""


_ASKED = _asked_sql("substr(string_split(p_name, ' ')[2], 1, 3) || ' ' || upper(substr(string_split(p_name, ' ')[1], 1, 3))")


@query("prefix_search", sql(f"{_ASKED} SELECT query_id, designation_id FROM hits", "designations"))
def prefix_search(v: Views) -> DataFrame:
    return S.prefix_search(_asked(v), v.word_index)


@query("search_filters", sql("SELECT designation_id FROM designations WHERE active AND language = 'en' AND use_code = 'synonym'", "designations"))
def search_filters(v: Views) -> DataFrame:
    return S.search_filters(v.designations, "EN-us", v.acceptability.filter("acceptability = 'preferred'"), ["synonym"]).select("designation_id")


def _page_sql(asked: str) -> str:
    return sql(f"""{asked}
SELECT * FROM (SELECT query_id, code, term, row_number() OVER (PARTITION BY query_id ORDER BY length(term), code, designation_id) - 1 AS place, count(*) OVER (PARTITION BY query_id) AS total FROM hits) WHERE place BETWEEN 2 AND 6""", "designations")


_PAGE = _page_sql(_ASKED)


@query("search_rank_page", _PAGE)
def search_rank_page(v: Views) -> DataFrame:
    chosen = v.designations.filter("active")
    return S.search_page(_asked(v), v.word_index, chosen, 2, 5)


@query("search_first_page", _PAGE)
def search_first_page(v: Views) -> DataFrame:
    """The same pages from an index in the order of ranks."""
    chosen = v.designations.filter("active")
    return S.first_page(_asked(v), S.ranked_index(chosen), chosen, 2, 5)


_SHORT = """CASE p_partkey // 100 % 3 WHEN 0 THEN upper(substr(p_name, 1, 1)) WHEN 1 THEN substr(p_name, 1, 2) || ' ' || substr(string_split(p_name, ' ')[2], 1, 2)
  ELSE string_split(p_name, ' ')[2] || ' ' || substr(p_name, 1, 1) END"""


@query("search_short_page", _page_sql(_asked_sql(_SHORT)))
def search_short_page(v: Views) -> DataFrame:
    """Pages of one letter, of two starts of two letters, and of a whole word beside one letter."""
    w, kind = F.split("p_name", " "), F.floor(F.col("p_partkey") / 100) % 3
    start = lambda c, n: F.substring(c, 1, n)
    other = F.get(w, F.lit(1))
    text = (
        F.when(kind == 0, F.upper(start("p_name", 1))).when(kind == 1, F.concat_ws(" ", start("p_name", 2), start(other, 2)))
        .otherwise(F.concat_ws(" ", other, start("p_name", 1)))
    )
    asked = v.raw("part").filter("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), text.alias("text"))
    chosen = v.designations.filter("active")
    index = S.ranked_index(chosen)
    return S.first_page(asked, index, chosen, 2, 5, S.short_pages(index))


@query("match_all_terms", sql(f"""{_ASKED}
SELECT query_id, code FROM asked JOIN words ON starts_with(word, start) GROUP BY query_id, code
HAVING count(DISTINCT start) = (SELECT count(*) FROM asked a WHERE a.query_id = asked.query_id)""", "designations"))
def match_all_terms(v: Views) -> DataFrame:
    return S.match_all_terms(_asked(v), v.designations)


@query("same_language", "SELECT doc_id, lang = 'en' AS same FROM documents")
def same_language_query(v: Views) -> DataFrame:
    return v.raw("documents").select("doc_id", same_language(F.concat("lang", F.lit("-XX")), F.lit("EN_gb")).alias("same"))


def _facts(v: Views) -> DataFrame:
    """Events as coded facts: event_id mod 2000 as a customer (some unknown), a display for some."""
    e = v.raw("events")
    code = F.concat(F.lit("C:"), (F.col("event_id") % 2000).cast("string"))
    system = F.when(F.col("event_id") % 97 == 0, "elsewhere").otherwise("world")
    return e.select("event_id", system.alias("system"), code.alias("code"))


_FACTS = """facts AS (SELECT event_id, CASE WHEN event_id % 97 = 0 THEN 'elsewhere' ELSE 'world' END AS system, 'C:' || (event_id % 2000) AS code FROM events)"""


def _systems(s: Sets, content: str = "complete") -> DataFrame:
    return s.tables.systems.withColumn("content", F.lit(content))


@query("lookup", sql(f"""{_FACTS}
SELECT event_id, f.code, CASE WHEN f.system = 'world' THEN display END AS name, CASE WHEN f.system = 'world' THEN '1.10' END AS version,
  CASE WHEN active AND f.system = 'world' THEN 1 END AS terms FROM facts f LEFT JOIN concepts c ON c.code = f.code""", "concepts"))
def lookup(v: Views) -> DataFrame:
    s = Sets(v)
    out = K.lookup(_facts(v), s.tables.concepts, _systems(s), s.designations, s.tables.properties)
    return out.select("event_id", "code", "name", "version", F.nullif(F.size("designations"), F.lit(-1)).alias("terms"))


@query("lookup_properties", "SELECT l_orderkey, l_linenumber, l_partkey, p_name AS name, p_brand AS brand, p_type AS type, CASE WHEN p_size <= 25 THEN 3 ELSE 2 END AS terms FROM lineitem JOIN part ON l_partkey = p_partkey")
def lookup_properties(v: Views) -> DataFrame:
    s = Sets(v)
    facts = v.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.lit("parts").alias("system"), F.concat(F.lit("P:"), F.col("l_partkey").cast("string")).alias("code"))
    out = K.lookup(facts, s.tables.concepts, _systems(s), s.designations, s.tables.properties, ["brand", "type"]).withColumn("p", F.map_from_entries("properties"))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "name", F.col("p")["brand"].alias("brand"), F.col("p")["type"].alias("type"), F.size("designations").alias("terms"))


_SHARED = """shared AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'colours' ELSE 'shapes' END AS system, CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE 'X' END || (o_custkey) AS code, o_custkey AS k FROM orders)"""


def _shared(v: Views) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Facts, concepts, systems and designations of two systems that use the same codes; the second does not mind the case."""
    k, customers = F.col("c_custkey").cast("string"), v.raw("customer")
    o = v.raw("orders")
    facts = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "colours").otherwise("shapes").alias("system"), F.concat(F.when(F.col("o_orderkey") % 3 == 0, "x").otherwise("X"), F.col("o_custkey").cast("string")).alias("code"), F.concat(F.lit("SHAPES "), F.col("o_custkey").cast("string")).alias("display"))
    both = F.explode(F.array(F.lit("colours"), F.lit("shapes"))).alias("system")
    concepts = customers.select(both, F.concat(F.lit("X"), k).alias("code"), F.concat(F.lit("C"), k).alias("display"), (F.col("c_acctbal") >= 0).alias("active"))
    designations = customers.select(both, F.concat(F.lit("X"), k).alias("code"), F.col("c_custkey").alias("k")).select("system", "code", F.concat_ws(" ", "system", F.col("k").cast("string")).alias("term"), F.lit("en").alias("language"), F.lit("full").alias("use_code"), F.lit(True).alias("active"), F.concat_ws("/", "system", "code").alias("designation_id"))
    systems = v.spark.createDataFrame([("colours", "1", True, "complete"), ("shapes", "2", False, "complete")], "system string, version string, case_sensitive boolean, content string")
    return facts, concepts, systems, designations


@query("lookup_definition", """
SELECT l_orderkey, l_linenumber, p_name AS name, CASE WHEN p_size % 2 = 0 THEN 'A ' || lower(p_type) || ' part of ' || p_brand END AS definition FROM lineitem JOIN part ON l_partkey = p_partkey""")
def lookup_definition(v: Views) -> DataFrame:
    s, part = Sets(v), v.raw("part")
    text = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("A "), F.lower("p_type"), F.lit(" part of "), F.col("p_brand")))
    defined = part.select(F.concat(F.lit("P:"), F.col("p_partkey").cast("string")).alias("code"), text.alias("definition"))
    facts = v.raw("lineitem").select("l_orderkey", "l_linenumber", F.lit("parts").alias("system"), F.concat(F.lit("P:"), F.col("l_partkey").cast("string")).alias("code"))
    out = K.lookup(facts, s.tables.concepts.join(defined, "code", "left"), _systems(s), s.designations, s.tables.properties, [])
    return out.select("l_orderkey", "l_linenumber", "name", "definition")


@query("lookup_shared_codes", f"""WITH {_SHARED}
SELECT id, CASE WHEN system = 'shapes' OR code = 'X' || k THEN system || ' ' || k END AS term, CASE WHEN system = 'colours' THEN '1' ELSE '2' END AS version FROM shared""")
def lookup_shared_codes(v: Views) -> DataFrame:
    """Each system's own term for a code that both have; in any case where the system does not mind it."""
    facts, concepts, systems, designations = _shared(v)
    none = v.spark.createDataFrame([], "system string, code string, property string, value_text string")
    return K.lookup(facts.drop("display"), concepts, systems, designations, none).select("id", F.get("designations.term", F.lit(0)).alias("term"), "version")


@query("validate_codes_case_blind", f"""WITH {_SHARED}
SELECT id, (system = 'shapes' OR code = 'X' || k) AND system = 'shapes' AS result,
  CASE WHEN system = 'colours' THEN CASE WHEN code <> 'X' || k THEN 'unknown-code' WHEN c_acctbal < 0 THEN 'inactive,wrong-display' ELSE 'wrong-display' END
    ELSE concat_ws(',', CASE WHEN c_acctbal < 0 THEN 'inactive' END, CASE WHEN code <> 'X' || k THEN 'case-differs' END) END AS reasons
FROM shared JOIN customer ON c_custkey = k""")
def validate_codes_case_blind(v: Views) -> DataFrame:
    """Codes in another case, and the other system's display: right only where the system says so."""
    facts, concepts, systems, designations = _shared(v)
    return K.validate_codes(facts, concepts, systems, designations).select("id", "result", F.array_join("issues.reason", ",").alias("reasons"))


@query("choose_display", sql("""
SELECT code, CASE WHEN code LIKE 'P:%' THEN coalesce((SELECT term FROM designations d WHERE d.code = c.code AND language = 'es' AND active), display) ELSE display END AS display FROM concepts c""", "concepts", "designations"))
def choose_display(v: Views) -> DataFrame:
    return K.choose_display(v.designations, v.acceptability, K.language_ranks("de, es;q=0.9, en;q=0.5", ["en", "es"]), v.concepts)


@query("choose_language", "SELECT doc_id, CASE lang WHEN 'fr' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 END AS rank FROM documents")
def choose_language(v: Views) -> DataFrame:
    """`de;q=0` is refused, `*` takes what is left."""
    ranks = K.language_ranks("*;q=0.1, fr-CA, en;q=0.8, de;q=0", ["de", "en", "es", "fr"])
    table = v.spark.createDataFrame(ranks, "lang string, rank int")
    return v.raw("documents").select("doc_id", "lang").join(F.broadcast(table), "lang", "left").select("doc_id", "rank")


@query("validate_codes", sql("""
facts AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 50 = 0 THEN 'elsewhere' ELSE 'world' END AS system, 'O:' || (o_orderkey * 2) AS code FROM orders)
SELECT id, f.code, f.system = 'world' AND active IS NOT NULL AS result, CASE WHEN f.system <> 'world' THEN 'unknown-system' WHEN active IS NULL THEN 'unknown-code' WHEN NOT active THEN 'inactive' END AS reason
FROM facts f LEFT JOIN concepts c ON c.code = f.code""", "concepts"))
def validate_codes(v: Views) -> DataFrame:
    s = Sets(v)
    system = F.when(F.col("o_orderkey") % 50 == 0, "elsewhere").otherwise("world")
    facts = v.raw("orders").select(F.col("o_orderkey").alias("id"), system.alias("system"), F.concat(F.lit("O:"), (F.col("o_orderkey") * 2).cast("string")).alias("code"))
    return K.validate_codes(facts, s.tables.concepts, _systems(s)).select("id", "code", "result", F.get("issues", F.lit(0))["reason"].alias("reason"))


@query("batch_validate", sql(f"{_FACTS} SELECT event_id, system = 'world' AND code IN (SELECT code FROM concepts) AS result FROM facts", "concepts"))
def batch_validate(v: Views) -> DataFrame:
    s = Sets(v)
    return K.validate_codes(_facts(v), s.tables.concepts, _systems(s)).select("event_id", "result")


@query("validate_display", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'white-space' WHEN 2 THEN CASE WHEN p_size <= 25 THEN 'exact' ELSE 'withdrawn-display' END ELSE 'wrong-display' END AS display_outcome
FROM lineitem JOIN part ON l_partkey = p_partkey""")
def validate_display(v: Views) -> DataFrame:
    part = v.raw("part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    kind = F.col("l_linenumber") % 4
    display = F.when(kind == 0, F.upper("p_name")).when(kind == 1, F.concat(F.lit(" "), F.regexp_replace("p_name", " ", "  "))).when(kind == 2, F.concat(F.lit("artículo "), F.col("p_name"))).otherwise("nothing")
    facts = v.raw("lineitem").join(part, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", F.concat(F.lit("P:"), F.col("l_partkey").cast("string")).alias("code"), display.alias("display"))
    return K.validate_display(facts.withColumn("system", F.lit("parts")), Sets(v).designations).select("l_orderkey", "l_linenumber", "l_partkey", "display_outcome")


@query("validate_display_language", """
SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN CASE WHEN p_size <= 25 THEN 'exact' ELSE 'withdrawn-display' END WHEN 1 THEN CASE WHEN p_size <= 25 THEN 'wrong-display' ELSE 'other-language' END ELSE 'wrong-display' END AS display_outcome
FROM lineitem JOIN part ON l_partkey = p_partkey""")
def validate_display_language(v: Views) -> DataFrame:
    """Spanish is asked for: an English term is wrong where a Spanish one holds, and else another language's."""
    part = v.raw("part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    kind = F.col("l_linenumber") % 3
    display = F.when(kind == 0, F.concat(F.lit("Artículo "), F.col("p_name"))).when(kind == 1, F.upper("p_name")).otherwise("nothing")
    facts = v.raw("lineitem").join(part, "l_partkey").select("l_orderkey", "l_linenumber", F.lit("parts").alias("system"), F.concat(F.lit("P:"), F.col("l_partkey").cast("string")).alias("code"), display.alias("display"))
    return K.validate_display(facts, Sets(v).designations, ["es-MX"]).select("l_orderkey", "l_linenumber", "display_outcome")


@query("validate_membership", sql("""
facts AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'nation/none' ELSE 'nation/' || (event_id % 25) END AS url, CASE WHEN event_id % 2 = 0 THEN 'C:' ELSE 'O:' END || (event_id % 2000) AS code FROM events),
inside AS (SELECT 'nation/' || substr(ancestor, 3) AS url, descendant AS code FROM closure WHERE ancestor LIKE 'N:%')
SELECT event_id, CASE WHEN f.url = 'nation/none' THEN 'unknown-value-set' WHEN c.code IS NULL THEN 'unknown-code' WHEN i.code IS NULL THEN 'not-in-value-set' WHEN NOT c.active THEN 'inactive' END AS reason
FROM facts f LEFT JOIN concepts c ON c.code = f.code LEFT JOIN inside i ON i.url = f.url AND i.code = f.code""", "concepts", "closure"))
def validate_membership(v: Views) -> DataFrame:
    s = Sets(v)
    url = F.when(F.col("event_id") % 11 == 0, "nation/none").otherwise(F.concat(F.lit("nation/"), (F.col("event_id") % 25).cast("string")))
    code = F.concat(F.when(F.col("event_id") % 2 == 0, "C:").otherwise("O:"), (F.col("event_id") % 2000).cast("string"))
    facts = v.raw("events").select("event_id", url.alias("url"), F.lit("world").alias("system"), code.alias("code"))
    rules = s.rules.filter("url LIKE 'nation%'")
    inside = VS.contains(facts.select("url", "system", "code").distinct(), rules, s.tables).filter("inside")
    return K.validate_membership(facts, inside, s.tables.concepts, rules.select("url"), active_only=True, systems=s.tables.systems).select("event_id", "reason")


_CODEABLE = """SELECT event_id, user_id < 75 OR event_type IN ('view', 'click', 'purchase') AS result,
  CASE WHEN user_id < 75 THEN 'C:' || user_id WHEN event_type IN ('view', 'click', 'purchase') THEN event_type END AS code,
  CASE WHEN user_id < 75 THEN 0 ELSE 1 END + CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 0 ELSE 1 END AS notes FROM events"""


@query("validate_codeable", _CODEABLE)
def validate_codeable(v: Views) -> DataFrame:
    """The first coding counts where the user id is below 75, the second where the type is on a list with one absent code."""
    coding = lambda system, code: F.struct(F.lit(system).alias("system"), code.alias("code"))
    rows = v.raw("events").select("event_id", F.array(coding("world", F.concat(F.lit("C:"), F.col("user_id").cast("string"))), coding("types", F.col("event_type"))).alias("codings"))
    users = v.raw("events").select("user_id").distinct().filter("user_id < 75").select(F.lit("world").alias("system"), F.concat(F.lit("C:"), F.col("user_id").cast("string")).alias("code"))
    listed = users.unionByName(v.spark.createDataFrame([("types", x) for x in ("view", "click", "purchase", "absent")], "system string, code string")).withColumn("_in", F.lit(True))

    def judge(codings: DataFrame) -> DataFrame:
        out = codings.join(listed, ["system", "code"], "left")
        return out.withColumn("result", F.coalesce("_in", F.lit(False))).withColumn("reason", F.when(F.col("_in").isNull(), "not-in-value-set")).drop("_in")

    return K.validate_codeable(rows, "event_id", judge).select("event_id", "result", "code", F.size("notes").alias("notes"))


@query("infer_system", """
SELECT event_id, CASE WHEN event_id % 3000 < 2000 AND event_id % 3000 >= 1000 THEN 'several' WHEN event_id % 3000 < 1000 THEN 'known' ELSE 'none' END AS inferred, CASE WHEN event_id % 3000 < 1000 THEN 'a' END AS system FROM events""")
def infer_system(v: Views) -> DataFrame:
    """Codes below 1000 are in one system of the set, those below 2000 in two, the rest in none."""
    facts = v.raw("events").select("event_id", F.lit("u").alias("url"), (F.col("event_id") % 3000).cast("string").alias("code"))
    code = F.col("code").cast("int")
    base = facts.select("url", "code").distinct()
    expansion = base.filter(code < 2000).withColumn("system", F.lit("a")).unionByName(base.filter(code.between(1000, 1999)).withColumn("system", F.lit("b")))
    return K.infer_system(facts, expansion).select("event_id", "inferred", "system")


@query("validate_version", "SELECT event_id, event_id % 4 <> 2 AS ok FROM events")
def validate_version(v: Views) -> DataFrame:
    version = F.get(F.array(F.lit("1.2.7"), F.lit("1.02"), F.lit("1.3.1"), F.lit(None).cast("string")), (F.col("event_id") % 4).cast("int"))
    used = v.spark.createDataFrame([("s", "1.2.x")], "system string, pattern string")
    return K.validate_version(v.raw("events").select("event_id", F.lit("s").alias("system"), version.alias("version")), used).select("event_id", F.col("version_ok").alias("ok"))


def _part_facts(v: Views) -> DataFrame:
    return v.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.lit("parts").alias("system"), F.concat(F.lit("P:"), F.col("l_partkey").cast("string")).alias("code"))


_PARTS = "facts AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'P:' || l_partkey AS code FROM lineitem)"


@query("translate", sql(f"{_PARTS} SELECT l_orderkey, l_linenumber, code, target_code, relationship, no_map FROM facts JOIN map_elements USING (code) WHERE map = 'part-brand'", "map_elements"))
def translate(v: Views) -> DataFrame:
    return K.translate(_part_facts(v), v.map_elements, "part-brand").select("l_orderkey", "l_linenumber", "code", "target_code", "relationship", "no_map")


@query("translate_by_group", """
WITH facts AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'colours' ELSE 'shapes' END AS system, 'X' || o_custkey AS code, o_custkey AS k FROM orders)
SELECT id, 'hues' AS target, CASE WHEN c_acctbal >= 0 THEN 'H' || c_nationkey ELSE 'H?' END AS target_code, '5' AS target_version FROM facts JOIN customer ON c_custkey = k WHERE system = 'colours'
UNION ALL SELECT id, 'forms', code, '7' FROM facts WHERE system = 'shapes'""")
def translate_by_group(v: Views) -> DataFrame:
    """A map of two groups, of two systems that share their codes; each group's own rule answers for what it does not map."""
    facts = v.raw("orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "colours").otherwise("shapes").alias("system"), F.concat(F.lit("X"), F.col("o_custkey").cast("string")).alias("code"))
    c = v.raw("customer").filter("c_acctbal >= 0").select(F.lit("m").alias("map"), F.lit(0).alias("group_no"), F.lit("colours").alias("source"), F.lit("hues").alias("target"), F.concat(F.lit("X"), F.col("c_custkey").cast("string")).alias("code"), F.concat(F.lit("H"), F.col("c_nationkey").cast("string")).alias("target_code"), F.lit("wider").alias("relationship"), F.lit(False).alias("no_map"), F.lit("5").alias("target_version"))
    rules = v.spark.createDataFrame([("m", 0, "colours", "hues", "fixed", "H?", None, None, "5"), ("m", 1, "shapes", "forms", "use-source-code", None, None, None, "7")], "map string, group_no int, source string, target string, mode string, fixed_code string, relationship string, other_map string, target_version string")
    return K.translate_unmapped(facts, c, rules, "m").select("id", "target", "target_code", "target_version")


@query("translate_reverse", sql("""
SELECT DISTINCT 'B:' || p_brand AS code, m.code AS target_code, 'source-is-broader-than-target' AS relationship FROM part JOIN map_elements m ON m.target_code = 'B:' || p_brand WHERE map = 'part-brand'""", "map_elements"))
def translate_reverse(v: Views) -> DataFrame:
    facts = v.concepts.filter("module = 'brand'").select("code", F.lit("brands").alias("system"))
    return K.translate_reverse(facts, v.map_elements, "part-brand").select("code", "target_code", "relationship")


@query("translate_unmapped", sql(f"""{_PARTS}
SELECT l_orderkey, l_linenumber, f.code, CASE WHEN m.code IS NULL THEN 'B:OTHER' ELSE target_code END AS target_code FROM facts f LEFT JOIN map_elements m ON m.code = f.code AND map = 'part-brand'""", "map_elements"))
def translate_unmapped(v: Views) -> DataFrame:
    return K.translate_unmapped(_part_facts(v), v.map_elements, v.map_unmapped, "part-brand").select("l_orderkey", "l_linenumber", "code", "target_code")


@query("translate_chain", sql(f"""{_PARTS}
SELECT l_orderkey, l_linenumber, f.code, coalesce(m.target_code, CASE WHEN m.code IS NULL THEN f.code END) AS target_code, CASE WHEN m.code IS NULL THEN 2 ELSE 1 END AS maps
FROM facts f LEFT JOIN map_elements m ON m.code = f.code AND map = 'part-brand'""", "map_elements"))
def translate_chain(v: Views) -> DataFrame:
    """Parts without an element go on to the second map, whose rule keeps their own code."""
    rules = v.spark.createDataFrame([("part-brand", "other-map", None, None, "brand-type"), ("brand-type", "use-source-code", None, None, None)], "map string, mode string, fixed_code string, relationship string, other_map string")
    return K.translate_chain(_part_facts(v).drop("system"), v.map_elements, rules, "part-brand").select("l_orderkey", "l_linenumber", "code", "target_code", F.size("applied").alias("maps"))


@query("follow_maps", sql("SELECT 'P:' || p_partkey AS start_code, m.target_code AS code FROM part JOIN map_elements m ON m.code = 'B:' || p_brand WHERE p_size > 3 AND p_size <= 40", "map_elements"))
def follow_maps(v: Views) -> DataFrame:
    return K.follow_maps(v.concepts.filter("module = 'part'").select("code"), v.map_elements, ["part-brand", "brand-type"])


@query("translate_scope", sql(f"{_PARTS} SELECT l_orderkey, l_linenumber, code, target_code FROM facts JOIN map_elements USING (code) WHERE map = 'part-brand' AND code IN (SELECT code FROM properties WHERE property = 'type' AND value_text = 'STANDARD')", "map_elements", "properties"))
def translate_scope(v: Views) -> DataFrame:
    s = Sets(v)
    scope = s.expand(VS.rule("standard", "include", 0, "parts", filters=[("type", "=", "STANDARD")]))
    facts = K.in_scope(_part_facts(v).withColumn("system", F.lit("parts")), scope)
    return K.translate(facts, v.map_elements, "part-brand").select("l_orderkey", "l_linenumber", "code", "target_code")


@query("translate_maps_by_scope", sql(f"""{_PARTS},
large AS (SELECT code FROM properties WHERE property = 'size' AND TRY_CAST(value_text AS INTEGER) > 20),
standard AS (SELECT code FROM properties WHERE property = 'type' AND value_text = 'STANDARD')
SELECT l_orderkey, l_linenumber, f.code, 'sized' AS map, target_code FROM facts f JOIN map_elements m USING (code) WHERE map = 'part-brand' AND f.code IN (SELECT code FROM large)
UNION ALL SELECT l_orderkey, l_linenumber, f.code, 'plain', target_code FROM facts f JOIN map_elements m USING (code) WHERE map = 'part-brand' AND (target_code IS NULL OR target_code LIKE 'B:%1')
UNION ALL SELECT l_orderkey, l_linenumber, f.code, 'typed', 'T:STANDARD' FROM facts f WHERE f.code IN (SELECT code FROM standard)""", "map_elements", "properties"))
def translate_maps_by_scope(v: Views) -> DataFrame:
    """Three maps: of large parts, of all parts to brands that end with 1, and of parts of a type; each fact takes those whose scopes hold it."""
    s, e = Sets(v), v.map_elements
    brands = e.filter("map = 'part-brand'").withColumns({"source": F.lit("parts"), "target": F.lit("parts")})
    typed = v.properties.filter("property = 'type'").select(F.lit("typed").alias("map"), F.lit(None).cast("string").alias("source"), F.lit("parts").alias("target"), "code", F.lit("T:STANDARD").alias("target_code"), F.lit("broader").alias("relationship"), F.lit(False).alias("no_map"), F.lit(0).alias("group_no"))
    elements = brands.withColumn("map", F.lit("sized")).unionByName(brands.withColumn("map", F.lit("plain"))).unionByName(typed)
    sizes = v.properties.filter("property = 'size' AND try_cast(value_text AS INT) > 20").agg(F.array_join(F.sort_array(F.collect_set("value_text")), ",")).first()[0] or "none"
    rules = s.literal([*VS.rule("large", "include", 0, "parts", filters=[("size", "in", sizes)]), *VS.rule("ones", "include", 0, "parts", filters=[("code", "regex", "B:.*1")]), *VS.rule("standard", "include", 0, "parts", filters=[("type", "=", "STANDARD")])])
    scopes = v.spark.createDataFrame([("sized", "large", None), ("plain", None, "ones"), ("typed", "standard", None)], "map string, source_scope string, target_scope string")
    facts = _part_facts(v)
    codes = facts.select("system", "code").unionByName(elements.filter("target_code IS NOT NULL").select(F.col("target").alias("system"), F.col("target_code").alias("code"))).distinct()
    held = VS.holding(codes, scopes.select(F.explode(F.array("source_scope", "target_scope")).alias("url")).filter("url IS NOT NULL"), rules, s.tables)
    return K.translate_by_scope(facts, elements, scopes, held).select("l_orderkey", "l_linenumber", "code", "map", "target_code")


@query("translate_result", "SELECT 'P:' || p_partkey AS code, p_size > 3 AND p_size <= 40 AS result, CASE WHEN p_size > 40 THEN 'no-element' WHEN p_size > 3 THEN 'matched' ELSE 'explicit-no-map' END AS reason FROM part")
def translate_result(v: Views) -> DataFrame:
    facts = v.concepts.filter("module = 'part'").select("code")
    return K.translate_result(facts, "code", K.translate(facts, v.map_elements, "part-brand"))


@query("successors", "SELECT 'C:' || c_custkey AS code, 'N:' || c_nationkey AS successor FROM customer WHERE c_acctbal < 0")
def successors(v: Views) -> DataFrame:
    """Customers in debt as inactive concepts that their nation replaces."""
    gone = v.raw("customer").select(F.concat(F.lit("C:"), F.col("c_custkey").cast("string")).alias("code"), (F.col("c_acctbal") >= 0).alias("active"), F.concat(F.lit("N:"), F.col("c_nationkey").cast("string")).alias("to"))
    members = gone.select(F.lit("replaced-by").alias("refset_id"), "code", F.lit(True).alias("active"), F.create_map(F.lit("targetComponentId"), F.col("to")).alias("fields"))
    return K.successors(gone, members, ["same-as", "replaced-by"]).select("code", "successor")


@query("refset_as_map", sql("SELECT refset_id AS map, code, CASE refset_id WHEN 'PRI:5-LOW' THEN 'low' ELSE 'urgent' END AS target, targetComponentId AS target_code, 'equivalent' AS relationship FROM members WHERE active AND refset_id IN ('PRI:1-URGENT', 'PRI:5-LOW')", "members"))
def refset_as_map(v: Views) -> DataFrame:
    """Two sets with a target system each."""
    sets = {"PRI:1-URGENT": "equivalent", "PRI:5-LOW": "equivalent"}
    return K.refset_as_map(v.members, sets, target={"PRI:1-URGENT": "urgent", "PRI:5-LOW": "low"}).select("map", "code", "target", "target_code", "relationship")


@query("map_rule_rows", "SELECT 'O:' || l_orderkey AS code, l_linenumber AS map_group, 'P:' || l_partkey AS map_target, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_suppkey, 'P:' || l_partkey) AS place FROM lineitem")
def map_rule_rows(v: Views) -> DataFrame:
    fields = F.create_map(F.lit("mapGroup"), F.col("l_linenumber").cast("string"), F.lit("mapPriority"), F.col("l_suppkey").cast("string"), F.lit("mapTarget"), F.concat(F.lit("P:"), F.col("l_partkey").cast("string")))
    members = v.raw("lineitem").select(F.lit("map").alias("refset_id"), F.concat(F.lit("O:"), F.col("l_orderkey").cast("string")).alias("code"), F.lit(True).alias("active"), fields.alias("fields"))
    return K.map_rule_rows(members).select("code", "map_group", "map_target", "place")


@query("relationship_codes", "SELECT event_id, CASE event_type WHEN 'view' THEN 'source-is-narrower-than-target' WHEN 'click' THEN 'no-map' WHEN 'error' THEN 'equivalent' ELSE event_type END AS relationship FROM events")
def relationship_codes(v: Views) -> DataFrame:
    word = F.when(F.col("event_type") == "view", "WIDER").when(F.col("event_type") == "click", "unmatched").when(F.col("event_type") == "error", "equal").otherwise(F.col("event_type"))
    return v.raw("events").select("event_id", K.relationship(word).alias("relationship"))
