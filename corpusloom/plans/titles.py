"""Claims, titles and versions: parts stand for versions, their types for works, suppliers for sources and franchises."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import fields, graph, routing, versions
from corpusloom.plans.registry import query
from corpusloom.session import table

_VERSIONS = """
    v AS (SELECT p_partkey AS version_id, p_partkey % 97 AS work_id, CASE WHEN p_partkey % 3 > 0 THEN 'tt' || p_partkey::VARCHAR END AS external_id, CASE p_size % 4 WHEN 0 THEN 'ml' WHEN 1 THEN 'ta' WHEN 2 THEN 'hi' END AS language, p_size % 7 = 0 AS is_original FROM part)"""


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    language = F.when(F.col("p_size") % 4 == 0, "ml").when(F.col("p_size") % 4 == 1, "ta").when(F.col("p_size") % 4 == 2, "hi")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("version_id"), (F.col("p_partkey") % 97).alias("work_id"), F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit("tt"), "p_partkey")).alias("external_id"), language.alias("language"), (F.col("p_size") % 7 == 0).alias("is_original"))


@query("""
    WITH o AS (SELECT l_orderkey AS entity, ['external_id', 'canonical_title', 'release_year', 'lead_cast', 'other'][l_linenumber % 5 + 1] AS field, (l_partkey % 3)::VARCHAR AS value, ['wikidata', 'tmdb', 'imdb', 'wikipedia', 'human'][l_suppkey % 5 + 1] AS source, l_suppkey * 10000000 + l_partkey AS pos FROM lineitem),
    p AS (SELECT *, coalesce(list_position(CASE field WHEN 'external_id' THEN ['wikidata'] WHEN 'canonical_title' THEN ['tmdb', 'wikidata', 'wikipedia'] WHEN 'release_year' THEN ['tmdb', 'wikidata', 'imdb', 'human'] ELSE ['tmdb', 'wikipedia', 'imdb'] END, source), 0) AS place FROM o WHERE field <> 'other'),
    r AS (SELECT *, count(*) OVER (PARTITION BY entity, field) AS n, count(*) OVER (PARTITION BY entity, field, value) AS same, min(pos) OVER (PARTITION BY entity, field, value) AS met, CASE place WHEN 0 THEN 99 ELSE place END AS pl FROM p),
    a AS (SELECT entity, field, any_value(n) AS n, count(DISTINCT value) AS nd FROM r GROUP BY ALL),
    pr AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY entity, field ORDER BY pl, pos) = 1),
    m AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY entity, field ORDER BY same DESC, met, pos) = 1)
    SELECT a.entity, a.field, CASE a.field WHEN 'release_year' THEN m.value ELSE pr.value END AS value,
           CASE WHEN CASE a.field WHEN 'external_id' THEN pr.pl < 99 WHEN 'release_year' THEN nd = 1 AND a.n >= 2 ELSE CASE WHEN nd = 1 THEN a.n >= 2 ELSE pr.same >= 2 END END THEN 'HIGH' ELSE 'MEDIUM' END AS confidence,
           CASE WHEN nd = 1 THEN 'none' WHEN a.field = 'release_year' AND 2 * m.same <= a.n THEN 'open' ELSE 'resolved' END AS conflict,
           CASE WHEN nd > 1 THEN CASE a.field WHEN 'external_id' THEN 'hub:wikidata' WHEN 'release_year' THEN CASE WHEN 2 * m.same > a.n THEN 'majority' END ELSE 'primary:' || pr.source END END AS rule
    FROM a JOIN pr USING (entity, field) JOIN m USING (entity, field)""")
def field_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of suppliers about orders, each field by its own rule."""
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    claims = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("entity"), pick(["external_id", "canonical_title", "release_year", "lead_cast", "other"], F.col("l_linenumber") % 5).alias("field"), (F.col("l_partkey") % 3).cast("string").alias("value"),
        pick(["wikidata", "tmdb", "imdb", "wikipedia", "human"], F.col("l_suppkey") % 5).alias("source"), (F.col("l_suppkey") * 10000000 + F.col("l_partkey")).alias("pos"),
    )
    return fields.resolve_fields(claims)


@query(f"""
    WITH {_VERSIONS}, a AS (SELECT 'tt' || l_partkey::VARCHAR AS external_id, l_orderkey::VARCHAR || '/' || l_linenumber::VARCHAR AS title, CASE l_returnflag WHEN 'A' THEN 'ta' WHEN 'R' THEN 'hi' END AS language, l_linestatus = 'O' AND l_linenumber = 1 AS is_original FROM lineitem),
    s AS (SELECT * FROM v WHERE external_id IS NULL AND language IS NOT NULL QUALIFY row_number() OVER (PARTITION BY work_id, language ORDER BY version_id) = 1)
    SELECT a.external_id, title, a.language, CASE WHEN NOT a.is_original AND s.version_id IS NOT NULL THEN s.version_id ELSE v.version_id END AS version_id,
           CASE WHEN v.version_id IS NULL THEN NULL WHEN a.is_original THEN 'canonical' WHEN s.version_id IS NULL THEN 'aka' WHEN s.is_original THEN 'canonical' ELSE 'dub' END AS kind
    FROM a LEFT JOIN v ON v.external_id = a.external_id LEFT JOIN s ON s.work_id = v.work_id AND s.language = a.language""")
def aka_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other titles of parts, routed to their versions or to siblings without an external id."""
    akas = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("tt"), "l_partkey").alias("external_id"), F.concat_ws("/", "l_orderkey", "l_linenumber").alias("title"), F.when(F.col("l_returnflag") == "A", "ta").when(F.col("l_returnflag") == "R", "hi").alias("language"), ((F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 1)).alias("is_original"))
    return routing.route_akas(akas, _versions(spark, sf_dir))


@query(f"""
    WITH {_VERSIONS}, t AS (SELECT 'tt' || l_partkey::VARCHAR AS external_id, l_orderkey::VARCHAR || '/' || l_linenumber::VARCHAR AS title, ['canonical', 'aka', 'translation'][l_linenumber % 3 + 1] AS kind, CASE l_returnflag WHEN 'A' THEN 'ta' WHEN 'R' THEN 'hi' END AS language FROM lineitem),
    s AS (SELECT * FROM v WHERE external_id IS NULL AND language IS NOT NULL QUALIFY row_number() OVER (PARTITION BY work_id, language ORDER BY version_id) = 1),
    r AS (SELECT t.*, v.version_id, v.language AS own_language, s.version_id AS sibling, s.is_original AS sib, t.kind = 'canonical' OR t.kind = 'translation' AND t.language IS NOT DISTINCT FROM v.language AS own FROM t JOIN v ON v.external_id = t.external_id LEFT JOIN s ON s.work_id = v.work_id AND s.language = t.language)
    SELECT CASE WHEN NOT own AND kind = 'translation' THEN sibling ELSE version_id END AS version_id, title, CASE WHEN own THEN 'canonical' WHEN kind = 'aka' THEN 'aka' WHEN sib THEN 'canonical' ELSE 'dub' END AS kind, CASE WHEN own THEN coalesce(language, own_language) ELSE language END AS language
    FROM r WHERE own OR kind = 'aka' OR sibling IS NOT NULL""")
def title_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and translations from another source, routed likewise; translations for which there is no version are dropped."""
    kind = F.element_at(F.array(*map(F.lit, ("canonical", "aka", "translation"))), F.col("l_linenumber") % 3 + 1)
    titles = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("tt"), "l_partkey").alias("external_id"), F.concat_ws("/", "l_orderkey", "l_linenumber").alias("title"), kind.alias("kind"), F.when(F.col("l_returnflag") == "A", "ta").when(F.col("l_returnflag") == "R", "hi").alias("language"))
    return routing.route_titles(titles, _versions(spark, sf_dir))


_FRANCHISES = """
    e AS (SELECT s_suppkey AS src, s_suppkey // 3 AS dst FROM supplier WHERE s_acctbal > 3000), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
    n AS (SELECT src AS node FROM b UNION SELECT dst FROM b), r AS (SELECT node, node AS seen FROM n UNION SELECT r.node, b.dst FROM r JOIN b ON b.src = r.seen)"""


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("version_id"), (F.col("p_partkey") % 61).alias("work_id"), F.when(F.col("p_size") % 3 == 0, "other").otherwise("indian").alias("country"), F.when(F.col("p_size") > 5, 1970 + F.col("p_size")).alias("year"), (F.col("p_size") % 5 == 0).alias("is_original"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey")).alias("hub_id")
    )
    edges = table(spark, sf_dir, "supplier").where("s_acctbal > 3000").select(F.col("s_suppkey").alias("src"), F.expr("s_suppkey DIV 3").alias("dst"))
    asked = rows.select("work_id").where("work_id % 10 = 0")
    return versions.version_sets(asked, rows, graph.undirected_closure(edges), scope="indian")


_SETS = """
    v AS (SELECT p_partkey AS version_id, p_partkey % 61 AS work_id, CASE WHEN p_size % 3 = 0 THEN 'other' ELSE 'indian' END AS country, CASE WHEN p_size > 5 THEN 1970 + p_size END AS year, p_size % 5 = 0 AS is_original, CASE WHEN p_partkey % 2 = 0 THEN p_partkey END AS hub_id FROM part),
    p AS (SELECT work_id AS asked, work_id FROM v WHERE work_id % 10 = 0 UNION SELECT node, seen FROM r WHERE node IN (SELECT work_id FROM v WHERE work_id % 10 = 0)),
    j AS (SELECT p.asked, v.* FROM p JOIN v ON v.work_id = p.work_id WHERE country = 'indian')"""


@query(f"""
    WITH RECURSIVE {_FRANCHISES}, {_SETS}
    SELECT asked, version_id, work_id, year, is_original AND work_id = asked AND row_number() OVER (PARTITION BY asked ORDER BY (is_original AND work_id = asked) DESC, hub_id IS NULL, year NULLS LAST, version_id) = 1 AS is_the_original FROM j""")
def version_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versions of every tenth work and its franchise, of one country, with the original marked."""
    return _sets(spark, sf_dir).select("asked", "version_id", "work_id", "year", "is_the_original")


@query(f"""
    WITH RECURSIVE {_FRANCHISES}, {_SETS},
    c AS (SELECT l_partkey AS version_id, 's' || l_suppkey AS name, min(l_linenumber) AS b FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL),
    l AS (SELECT version_id, string_agg(name, ',' ORDER BY b, name) AS leads FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY version_id ORDER BY b, name) <= 5) GROUP BY version_id),
    x AS (SELECT l_partkey AS version_id, min(CASE l_returnflag WHEN 'A' THEN 'official_dub' WHEN 'R' THEN 'remake' END) AS label FROM lineitem WHERE l_returnflag <> 'N' AND l_quantity > 48 GROUP BY l_partkey)
    SELECT asked, j.version_id, coalesce(leads, '') AS leads, CASE WHEN label IS NOT NULL THEN label WHEN is_original THEN 'original' WHEN work_id <> asked THEN 'sequel' END AS relationship FROM j LEFT JOIN l USING (version_id) LEFT JOIN x USING (version_id)""")
def version_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same versions with their first leads and how each is related to the rest."""
    lines = table(spark, sf_dir, "lineitem")
    cast = lines.groupBy(F.col("l_partkey").alias("version_id"), F.concat(F.lit("s"), "l_suppkey").alias("name"), F.when(F.col("l_returnflag") == "N", "support").otherwise("lead").alias("role_kind")).agg(F.min("l_linenumber").alias("billing_order"))
    edges = lines.where("l_quantity > 48").select(F.when(F.col("l_returnflag") == "A", "is_official_dub_of").when(F.col("l_returnflag") == "R", "is_remake_of").otherwise("based_on").alias("edge_type"), F.col("l_partkey").alias("src"), F.col("l_orderkey").alias("dst"))
    return versions.version_entries(_sets(spark, sf_dir), cast, edges).select("asked", "version_id", F.array_join("leads", ",").alias("leads"), "relationship")


@query("""
    WITH w AS (SELECT s_suppkey AS work_id, s_name AS title, CASE WHEN s_acctbal > 0 THEN 'film' ELSE 'novel' END AS work_type FROM supplier), e AS (SELECT l_suppkey AS src, l_partkey % 150 AS dst FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45),
    b AS (SELECT src, count(DISTINCT dst) AS n_based_on, min(dst) AS source_id FROM e GROUP BY src)
    SELECT w.work_id, w.title, w.work_type, coalesce(n_based_on, 0) AS n_based_on, source_id, s.title AS source_title, s.work_type AS source_type FROM w LEFT JOIN b ON b.src = w.work_id LEFT JOIN w s ON s.work_id = b.source_id""")
def work_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works with the work that they are based on."""
    works = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("work_id"), F.col("s_name").alias("title"), F.when(F.col("s_acctbal") > 0, "film").otherwise("novel").alias("work_type"))
    edges = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45").select(F.lit("based_on").alias("edge_type"), F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 150).alias("dst"))
    return versions.with_source(works, edges)


def _resolved(spark: SparkSession, sf_dir: str, language: str | None = None) -> DataFrame:
    rows = _versions(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("version_id"), F.col("p_name").alias("title")), "version_id")
    asked = table(spark, sf_dir, "part").where("p_partkey % 50 = 0").select(F.explode(text.title_perturbations(F.col("p_name"))).alias("query"))
    return versions.resolve_titles(asked, rows, language)


@query()
def title_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions in one language for misspelt titles; a test compares with brute force."""
    return _resolved(spark, sf_dir, "ta")


@query()
def title_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title channel: cards of the versions that a title resolves to. Every third version has none."""
    chunks = table(spark, sf_dir, "part").select((F.col("p_partkey") * 2).alias("chunk_id"), F.col("p_partkey").alias("version_id"), F.when(F.col("p_partkey") % 3 > 0, "metadata_card").otherwise("plot").alias("kind"))
    return versions.card_hits(_resolved(spark, sf_dir), chunks)


@query("""
    WITH v AS (SELECT DISTINCT l_orderkey AS set_id, l_partkey AS version_id, l_returnflag AS language, CASE WHEN l_linenumber < 5 THEN 2000 + l_linenumber END AS year, CASE WHEN l_suppkey % 4 > 0 THEN 's' || l_suppkey::VARCHAR END AS lead, l_quantity > 45 AS is_original FROM lineitem),
    n AS (SELECT set_id, count(*) AS n, bool_or(is_original) AS o FROM v GROUP BY set_id)
    SELECT set_id, 'language' AS dimension, language AS value FROM v JOIN n USING (set_id) GROUP BY set_id, language HAVING count(*) < any_value(n)
    UNION ALL SELECT set_id, 'year', year::VARCHAR FROM v JOIN n USING (set_id) WHERE year IS NOT NULL GROUP BY set_id, year HAVING count(*) < any_value(n)
    UNION ALL SELECT set_id, 'actor', lead FROM (SELECT DISTINCT set_id, lead FROM v WHERE lead IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY set_id ORDER BY lead) <= 3
    UNION ALL SELECT set_id, 'era', 'newer' FROM n WHERE o AND n > 1""")
def refine_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By what the lines of each order can be narrowed."""
    entries = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("set_id"), F.col("l_partkey").alias("version_id"), F.col("l_returnflag").alias("language"), F.when(F.col("l_linenumber") < 5, 2000 + F.col("l_linenumber")).alias("year"), F.when(F.col("l_suppkey") % 4 > 0, F.concat(F.lit("s"), "l_suppkey")).alias("lead"), (F.col("l_quantity") > 45).alias("is_original"))
    return versions.refinements(entries.distinct())
