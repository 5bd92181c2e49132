"""The catalogue's queries on the driver's tables, with DuckDB equivalents written independently of the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.bindings import BOUND, PARTS, catalog, ctes
from catalith.functions.rtf.columns import placeholders, render_html, token_rows
from catalith.catalog import family_suffix
from catalith.functions.scalars import code_search_input, date_text, id_of, ids_of, image_path, label_map, mime_type, node_key, node_label, parse_node_key
from catalith.operators import crossref, documents, favourites, legacy, navigation, search, trees, vehicle
from catalith.plans.applicability import Vehicle

Query = Callable[[SparkSession, str], DataFrame]
CAR = Vehicle(7, bodies=(14001, 14002, 14003), gearboxes=(22001, 22002))
VARIANT = Vehicle(7, engine=7, bodies=(3, 8, 11), gearboxes=(1, 22))
SERIES = Vehicle(7)

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as the query of its name."""

    def keep(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return keep


_FITS_CAR = "(a.series_id = 0 OR (a.series_id = 7 AND a.body_id IN (14001, 14002, 14003) AND a.gearbox_id IN (22001, 22002, 0)))"
_FITS_SERIES = "a.series_id IN (0, 7)"
_LIST = "o.id, o.code, o.doc_type_id, o.title, o.published, o.sort"


def _listed(where: str, fits: str | None, bridge: str = "") -> str:
    joined = f"JOIN b_applicability a ON a.doc_id = o.id AND {fits}" if fits else ""
    return f"SELECT DISTINCT {_LIST} FROM b_document o {bridge} {joined} WHERE o.enabled = 1 AND {where}"


_BY_NODE = "JOIN b_node_document g ON g.doc_id = o.id AND g.security = 0"
_DOCS = ctes("document", "applicability", "node_document")


@query(f"{_DOCS} {_listed('g.node_id = 3', _FITS_CAR, _BY_NODE)}")
def documents_by_node(spark, d):
    return documents.documents_by_node(catalog(spark, d), 200, 3, CAR)


@query(f"{_DOCS} {_listed('g.node_id = 3', None, _BY_NODE)}")
def documents_by_node_novehicle(spark, d):
    return documents.documents_by_node(catalog(spark, d), 200, 3, Vehicle(model=5))


@query(f"{_DOCS} {_listed('o.doc_type_id = 2', _FITS_CAR)}")
def documents_by_type(spark, d):
    return documents.documents_by_type(catalog(spark, d), 2, CAR)


@query(f"""{_DOCS} {_listed("o.code = 'D123'", _FITS_SERIES)}""")
def documents_by_code(spark, d):
    return documents.document_by_code(catalog(spark, d), " D123 ", CAR)


@query(f"""{_DOCS} {_listed("o.code = 'D123' AND o.doc_type_id = 1", None)}""")
def documents_by_code_and_type(spark, d):
    return documents.document_by_code(catalog(spark, d), "D123", doc_type_id=1)


@query(f"{ctes('document', 'applicability', 'symptom_document')} {_listed('g.node_id = 4', _FITS_SERIES, 'JOIN b_symptom_document g ON g.doc_id = o.id AND g.security = 0')}")
def symptom_documents(spark, d):
    return documents.symptom_documents(catalog(spark, d), 4, CAR)


@query(f"""{ctes('document', 'document_file')} SELECT o.id, o.code, o.doc_type_id, o.title, o.published, o.security,
  (SELECT string_agg(file_name || ' ' || device_type || ' ' || device_code || ' /api/docs/' || file_name || '.rtf', ',' ORDER BY file_name, device_type, device_code) FROM b_document_file f WHERE f.doc_id = o.id) AS files
FROM b_document o WHERE o.id = 7""")
def document_detail(spark, d):
    shown = F.transform("files", lambda f: F.concat_ws(" ", f["file_name"], f["device_type"], f["device_code"], f["text_url"]))
    return documents.document(catalog(spark, d), 7).withColumn("files", F.array_join(shown, ","))


@query(f"{ctes('doc_type')} SELECT id, code, name FROM b_doc_type WHERE id = 1600")
def doc_type_by_id(spark, d):
    return documents.doc_types(catalog(spark, d), 1600).select("id", "code", "name")


@query("SELECT concat('PAGE/', CAST(page_id AS VARCHAR), '.PNG') AS id, 'image/png' AS content_type, CAST(strlen(html) AS BIGINT) AS bytes FROM pages WHERE page_id = 16")
def image_lookup(spark, d):
    return documents.image(catalog(spark, d), "page/16.png").select("id", "content_type", F.octet_length("data").cast("long").alias("bytes"))


@query(f"{ctes('doc_type')} SELECT id, code, name, sort, CASE WHEN id = 1600 THEN 'IB' ELSE '' END AS code_prefix FROM b_doc_type")
def doc_types(spark, d):
    return documents.doc_types(catalog(spark, d)).select("id", "code", "name", "sort", "code_prefix")


@query(f"""{ctes('document', 'applicability', 'doc_type', 'document_ref', bound=PARTS)}
SELECT DISTINCT o.id, o.code, o.doc_type_id, o.title, o.published, t.code AS type_code, t.name AS type_name FROM b_document_ref r JOIN b_document o ON o.id = r.target_id
JOIN b_doc_type t ON t.id = o.doc_type_id JOIN b_applicability a ON a.doc_id = o.id WHERE r.source_id = 5 AND r.enabled = 1 AND o.enabled = 1 AND {_FITS_SERIES}""")
def related_documents(spark, d):
    return documents.related_documents(catalog(spark, d, PARTS), 5, SERIES)


_SPOTS = f"""{ctes('document', 'applicability', 'hotspot', bound=PARTS)}, spots AS (SELECT DISTINCT h.number, o.id, o.code, o.doc_type_id, o.title FROM b_hotspot h JOIN b_document o ON o.id = h.target_id
JOIN b_applicability a ON a.doc_id = o.id WHERE h.source_id = 1 AND h.enabled = 1 AND {_FITS_SERIES})"""


@query(f"{_SPOTS} SELECT * FROM spots")
def hotspots(spark, d):
    return crossref.hotspots(catalog(spark, d, PARTS), 1, SERIES)


@query(f"{_SPOTS} SELECT number, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM spots GROUP BY number")
def hotspots_grouped(spark, d):
    as_map = crossref.hotspot_map(crossref.hotspots(catalog(spark, d, PARTS), 1, SERIES))
    return as_map.select(F.explode("hotspots").alias("number", "t")).select("number", F.array_join(F.col("t")["id"].cast("array<string>"), ",").alias("ids"))


@query("""WITH x AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages)
SELECT page_id, CAST(i AS INT) AS number, l[i] AS link FROM x, unnest(range(1, len(l) + 1)) u(i)""")
def link_ordinals(spark, d):
    return crossref.links(spark.read.parquet(f"{d}/pages.parquet"), "html", "page_id")


@query(f"""{ctes('vehicle_model', 'label')} SELECT DISTINCT m.series_id AS id, l.name AS code, m.series_name AS name FROM b_vehicle_model m LEFT JOIN b_label l ON m.series_id = l.key""")
def series_list(spark, d):
    return vehicle.series(catalog(spark, d))


@query(f"""{ctes('vehicle_model', 'label')} SELECT m.model_id AS id, l.name AS code, m.model_name AS name, min(m.produced_from) AS produced_from, max(m.produced_to) AS produced_to
FROM b_vehicle_model m LEFT JOIN b_label l ON m.model_id = l.key WHERE m.series_id = 7 GROUP BY m.model_id, l.name, m.model_name""")
def models(spark, d):
    return vehicle.models(catalog(spark, d), 7)


@query(f"{ctes('vehicle_type', 'label')} SELECT DISTINCT t.engine_id AS id, l.name FROM b_vehicle_type t LEFT JOIN b_label l ON t.engine_id = l.key WHERE t.model_id = 7")
def engines(spark, d):
    return vehicle.engines(catalog(spark, d), 7)


@query(f"""{ctes('vehicle_type', 'vehicle_model', 'label')}, t AS (SELECT * FROM b_vehicle_type WHERE series_id = 7 AND model_id = 7),
n AS (SELECT min(produced_from) AS a, max(produced_to) AS b FROM b_vehicle_model WHERE series_id = 7 AND model_id = 7)
SELECT {', '.join(f"(SELECT string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) FROM (SELECT DISTINCT {k}_id AS i FROM t)) AS {k}_ids, (SELECT string_agg(name, ',' ORDER BY i) FROM (SELECT DISTINCT {k}_id AS i FROM t) JOIN b_label ON key = i) AS {k}_names" for k in ('body', 'gearbox', 'drive'))},
(SELECT CASE WHEN substr(CAST(a AS VARCHAR), 1, 4) = substr(CAST(b AS VARCHAR), 1, 4) THEN substr(CAST(a AS VARCHAR), 1, 4) ELSE substr(CAST(a AS VARCHAR), 1, 4) || '-' || substr(CAST(b AS VARCHAR), 1, 4) END FROM n) AS model_year""")
def vehicle_variants(spark, d):
    found = vehicle.variants(catalog(spark, d), Vehicle(7, 7))
    lists = [F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in found.columns if c != "model_year"]
    return found.select(*lists, "model_year")


_VIN = "concat('WBAPH71000', lpad(CAST(c_custkey % 10 AS STRING), 2, '0'), lpad(CAST(c_custkey AS STRING), 5, '0'))"
_BASE36 = " + ".join(f"(strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr(vin, {13 + k}, 1)) - 1) * {36 ** (4 - k)}" for k in range(5))


@query(f"""{ctes('chassis_range', 'vehicle_type')}, v AS (SELECT {_VIN} AS vin FROM customer),
p AS (SELECT vin, (strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr(vin, 11, 1)) - 1) * 36 + strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr(vin, 12, 1)) - 1 AS area, {_BASE36} AS serial FROM v),
h AS (SELECT vin, min(type_id) AS type_id FROM p JOIN b_chassis_range r ON r.area = p.area AND p.serial BETWEEN serial_from AND serial_to GROUP BY vin)
SELECT h.vin, t.series_id, t.model_id, t.engine_id, t.body_id, t.gearbox_id, t.drive_id, r.produced AS production_date FROM h JOIN b_vehicle_type t USING (type_id) JOIN b_chassis_range r USING (type_id)""")
def vin_lookup(spark, d):
    vins = spark.sql(f"SELECT {_VIN} AS vin FROM {{customer}}", customer=spark.read.parquet(f"{d}/customer.parquet"))
    found = vehicle.decode_vins(catalog(spark, d), vins)
    return found.select("vin", "series_id", "model_id", "engine_id", "body_id", "gearbox_id", "drive_id", "production_date")


_LEVEL = "SELECT DISTINCT t.node_id AS id, t.code, t.name, t.parent_id, t.variant_kind, t.variant_value, l.name AS variant_name FROM b_nav_node t"
_NAMES = "LEFT JOIN b_label l ON t.variant_value = l.key AND t.variant_value > 0"
_NAV = ctes("nav_node", "nav_applicability", "label")


@query(f"{_NAV} {_LEVEL} JOIN b_nav_applicability k ON k.node_id = t.node_id {_NAMES} WHERE t.parent_id = -1 AND t.enabled = 1 AND k.series_id = 7 AND k.model_id = 7")
def groups_root(spark, d):
    return navigation.groups(catalog(spark, d), 200, Vehicle(7, 7))


@query(f"{_NAV} {_LEVEL} {_NAMES} WHERE t.parent_id = 1 AND t.enabled = 1")
def groups_children(spark, d):
    return navigation.group_children(catalog(spark, d), 200, 1)


@query(f"""{ctes('path_node', 'label')} SELECT DISTINCT node_id AS id, code, t.name, parent_id, variant_kind, variant_value, CAST(NULL AS VARCHAR) AS variant_name FROM b_path_node t WHERE path_id = 1 AND parent_id = -1 AND enabled = 1""")
def groups_shared_path(spark, d):
    return navigation.groups(catalog(spark, d), 300, SERIES)


@query(f"""{ctes('nav_node')}, h AS (SELECT *, variant_value > 0 AND ((variant_kind = 3000 AND variant_value = 7) OR (variant_kind = 4000 AND variant_value IN (3, 8, 11)) OR (variant_kind = 5000 AND variant_value IN (1, 22))) AS hit FROM b_nav_node),
w AS (SELECT *, max(CAST(hit AS INT)) OVER (PARTITION BY code, variant_kind) AS any_hit FROM h)
SELECT node_id AS id, code, variant_kind, variant_value FROM w WHERE variant_kind = 0 OR hit OR (any_hit = 0 AND variant_value = 0)""")
def variant_filter(spark, d):
    nodes = catalog(spark, d).table("nav_node").select(F.col("node_id").alias("id"), "code", "variant_kind", "variant_value")
    return navigation.filter_variants(nodes, VARIANT)


_SY = ctes("path_node", "symptom_applicability")
_HAS = "EXISTS (SELECT 1 FROM b_path_node c WHERE c.parent_id = t.node_id AND c.enabled = 1)"
_TREE = "SELECT DISTINCT t.node_id AS id, t.code, t.name, t.parent_id, CASE WHEN {has} THEN 1 ELSE 0 END AS has_children{sort} FROM {source} t"


def _flag(rows: DataFrame) -> DataFrame:
    return rows.withColumn("has_children", F.col("has_children").cast("int"))


@query(f"{ctes('path_node')} SELECT node_id AS id, code, name, parent_id FROM b_path_node WHERE parent_id = 0")
def symptom_roots(spark, d):
    return trees.symptom_roots(catalog(spark, d))


@query(f"{_SY} {_TREE.format(has=_HAS, sort='', source='b_path_node')} JOIN b_symptom_applicability k ON k.node_id = t.node_id AND k.series_id = 7 WHERE t.parent_id = 1")
def symptom_nodes(spark, d):
    return _flag(trees.symptom_nodes(catalog(spark, d), 1, SERIES))


@query(f"""{_SY}, below AS (SELECT * FROM b_path_node WHERE parent_id = -1 UNION SELECT n.* FROM b_path_node n JOIN below b ON n.parent_id = b.node_id)
{_TREE.format(has=_HAS, sort=', t.sort', source='below')}""")
def symptom_tree(spark, d):
    return _flag(trees.symptom_tree(catalog(spark, d), -1))


@query(f"""{_SY}, fit AS (SELECT * FROM b_path_node WHERE node_id IN (SELECT node_id FROM b_symptom_applicability WHERE series_id = 7)),
below AS (SELECT * FROM fit WHERE parent_id = -1 UNION SELECT n.* FROM fit n JOIN below b ON n.parent_id = b.node_id)
{_TREE.format(has=_HAS, sort=', t.sort', source='below')}""")
def symptom_tree_vehicle(spark, d):
    return _flag(trees.symptom_tree(catalog(spark, d), -1, SERIES))


@query(f"""{ctes('path_node')}, below AS (SELECT * FROM b_path_node WHERE parent_id = -1 UNION SELECT n.* FROM b_path_node n JOIN below b ON n.parent_id = b.node_id),
up AS (SELECT node_id, parent_id FROM below WHERE lower(name) LIKE '%012%' UNION SELECT t.node_id, t.parent_id FROM below t JOIN up u ON t.node_id = u.parent_id)
SELECT DISTINCT t.node_id AS id, t.name, t.parent_id, CASE WHEN t.node_id IN (SELECT parent_id FROM up) THEN 1 ELSE 0 END AS expanded FROM below t WHERE t.node_id IN (SELECT node_id FROM up)""")
def tree_search(spark, d):
    found = trees.search_tree(trees.symptom_tree(catalog(spark, d), -1), " 012 ")
    return found.select("id", "name", "parent_id", F.col("expanded").cast("int").alias("expanded"))


@query(f"""{ctes('path_node')} SELECT parent_id, string_agg(CAST(node_id AS VARCHAR), ',' ORDER BY sort, node_id) AS children FROM b_path_node WHERE parent_id <> 0 GROUP BY parent_id""")
def tree_children(spark, d):
    by_parent = trees.assemble(trees.symptom_tree(catalog(spark, d), -1))
    return by_parent.select("parent_id", F.array_join(F.col("children")["id"].cast("array<string>"), ",").alias("children"))


@query("SELECT doc_id, lang, source FROM documents WHERE contains(lower(text), 'attion')")
def text_search(spark, d):
    rows = spark.read.parquet(f"{d}/documents.parquet")
    return search.search_documents(rows, "  ATTION ", ("text",)).select("doc_id", "lang", "source")


@query(f"""{ctes('nav_node')} SELECT node_id AS id, code, name FROM b_nav_node WHERE contains(lower(code || ' ' || name), 'brand#1 red')""")
def group_search(spark, d):
    rows = catalog(spark, d).table("nav_node").select(F.col("node_id").alias("id"), "code", "name", F.lit(None).cast("string").alias("variant_name"))
    return search.search_groups(rows, "Brand#1 red").select("id", "code", "name")


# texts as rich text: styles, a mark, a table row, a link with a blank inside, indented paragraphs; and the HTML that must come of them
_PLAIN = r"replace(replace(replace(replace(replace(text, '\\', ' '), '{', ' '), '}', ' '), chr(13), ''), chr(10), '{break}')"
_RTF = rf"""concat('{{\\rtf1 \\b ', lang, '\\b0  ', source, ' --TYP--\\par \\trowd\\trleft100\\cellx1100\\cellx3100\\intbl ', lang, '\\cell \\i ', source, '\\i0\\cell\\row ',
  '\\pard\\li200 \\strike 00\\~', CAST(doc_id AS STRING), '\\strike0  ', {_PLAIN.replace('{break}', chr(92) * 2 + 'par ')}, '}}')"""
_LINES = r"string_split(replace(replace(replace(replace(replace(replace(replace(replace(text, '\', ' '), '{', ' '), '}', ' '), chr(13), ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(10))".replace('\\"', '"')
_CELL = '<td class="tis-text-cell" style="width:'
_LINKED = '<a class="tis-cross-ref" data-hotspot="1" href="#">00'
_HTML = f"""SELECT doc_id, '<p><strong>' || lang || '</strong> ' || source || ' E46</p>' || chr(10) || '<table class="tis-layout-table" style="margin-left:5pt;width:150pt">' || chr(10) || '<tbody>' || chr(10)
  || '<tr>{_CELL}33.3%"><p>' || lang || '</p>' || chr(10) || '</td>{_CELL}66.7%"><p><em>' || source || '</em></p>' || chr(10) || '</td></tr>' || chr(10) || '</tbody>' || chr(10) || '</table>' || chr(10)
  || '<p style="margin-left:10pt">{_LINKED}' || chr(160) || doc_id || '</a> ' || l[1] || '</p>' || chr(10)
  || coalesce(list_aggregate(list_transform(list_filter(l[2:], lambda x: x <> ''), lambda x: '<p style="margin-left:10pt">' || x || '</p>' || chr(10)), 'string_agg', ''), '') AS html
FROM (SELECT *, {_LINES} AS l FROM documents)"""


def _rtf(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", F.expr(_RTF).alias("rtf"))


@query(_HTML)
def rtf_render(spark, d):
    return _rtf(spark, d).select("doc_id", render_html(F.col("rtf"), placeholders(typ="E46")).alias("html"))


_WORDS = [("rtf", 1), ("b", None), ("b", 0), ("par", None), ("trowd", None), ("trleft", 100), ("cellx", 1100), ("cellx", 3100), ("intbl", None), ("cell", None), ("i", None), ("i", 0), ("cell", None), ("row", None), ("pard", None), ("li", 200), ("strike", None), ("strike", 0)]
_FIXED = ", ".join(["{'kind': 'open', 'word': ''}", "{'kind': 'close', 'word': ''}", "{'kind': 'symbol', 'word': '~'}", *(f"{{'kind': 'word', 'word': '{w}{'' if n is None else n}'}}" for w, n in _WORDS)])


@query(rf"""WITH x AS (SELECT doc_id, lang, source, replace(replace(replace(replace(text, '\', ' '), '{{', ' '), '}}', ' '), chr(13), '') AS t FROM documents),
y AS (SELECT *, string_split(t, chr(10)) AS l FROM x)
SELECT doc_id, kind, word, count(*) AS n FROM (
SELECT doc_id, unnest([{_FIXED}], recursive := true) FROM y
UNION ALL SELECT doc_id, 'word', 'par' FROM y, unnest(range(len(l) - 1)) u(i)
UNION ALL SELECT doc_id, 'text', unnest([lang, ' ' || source || ' --TYP--', lang, source, '00', CAST(doc_id AS VARCHAR), ' ' || l[1]]) FROM y
UNION ALL SELECT doc_id, 'text', unnest(list_filter(l[2:], lambda x: x <> '')) FROM y) GROUP BY ALL""")
def rtf_tokens(spark, d):
    found = token_rows(_rtf(spark, d), "doc_id", "rtf").withColumn("word", F.concat("word", F.coalesce(F.col("param").cast("string"), F.lit(""))))
    return found.groupBy("doc_id", "kind", "word").agg(F.count("*").alias("n"))


_NOTICE = {"doc_blob": r"SELECT concat('NOTE/', CAST(r_regionkey AS STRING), '.RTF') AS id, '' AS path, 'application/rtf' AS content_type, CAST(concat('{{\\rtf1 see \\strike part ', r_name, '\\strike0 , --MOTOR-- or \\strike the\\~other\\line\\strike third\\strike0 .}}') AS BINARY) AS data FROM {region}"}


@query(f"""SELECT 'NOTE/' || r_regionkey || '.RTF' AS id, '<p>see <a class="tis-cross-ref" data-hotspot="1" href="#">part ' || r_name || '</a>, M50 or <a class="tis-cross-ref" data-hotspot="2" href="#">the' || chr(160) || 'other</a><br><a class="tis-cross-ref" data-hotspot="3" href="#">third</a>.</p>' || chr(10) AS html FROM region WHERE r_regionkey = 2""")
def document_html(spark, d):
    return documents.document_html(catalog(spark, d, _NOTICE), "note/2.rtf", placeholders(motor="M50"))


@query(f"""{_SPOTS} SELECT l.number, l.link, s.id, s.code, s.doc_type_id, s.title FROM (SELECT unnest([1, 2, 3]) AS number, unnest(['part ASIA', 'the' || chr(160) || 'other', 'third']) AS link) l LEFT JOIN spots s USING (number)""")
def resolved_links(spark, d):
    return crossref.resolved_links(catalog(spark, d, {**PARTS, **_NOTICE}), 1, "note/2.rtf", SERIES)


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def date_format(spark, d):
    day = F.date_format("o_orderdate", "yyyyMMdd").cast("int")
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), date_text(day).alias("day"), date_text((day / 100).cast("int"), months=True).alias("month"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/webp' ELSE 'application/octet-stream' END AS mime FROM pages""")
def mime_case(spark, d):
    name = F.concat(F.lit("a/b."), F.element_at(F.array(*map(F.lit, ("PNG", "jpg", "WebP", "txt"))), (F.col("page_id") % 4 + 1).cast("int")))
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", mime_type(name).alias("mime"))


@query("SELECT concat('PAGE/', CAST(page_id AS VARCHAR), '.RTF') AS id, CAST(strlen(html) AS BIGINT) AS chars FROM pages WHERE page_id = 17")
def blob_lookup(spark, d):
    return documents.document_text(catalog(spark, d), "page/17.rtf").select("id", F.length("text").cast("long").alias("chars"))


@query("""SELECT c_custkey AS id, c_custkey AS parsed, concat(CAST(c_custkey AS VARCHAR), '|', CAST(c_nationkey AS VARCHAR)) AS ids FROM customer""")
def parse_ids(spark, d):
    rows = spark.read.parquet(f"{d}/customer.parquet")
    text = F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit("x"))
    several = F.concat_ws(",", F.col("c_custkey").cast("string"), F.lit(""), F.lit("a"), F.col("c_nationkey").cast("string"))
    return rows.select(F.col("c_custkey").alias("id"), id_of(text).alias("parsed"), F.array_join(ids_of(several).cast("array<string>"), "|").alias("ids"))


@query(f"""{ctes('nav_node')} SELECT node_id AS id, concat(node_id, '.', variant_kind, '.', variant_value) AS key, variant_value AS value, CASE WHEN variant_value > 0 THEN concat(code, ' ', name, ' (', variant_value, ')') ELSE concat(code, ' ', name) END AS label FROM b_nav_node""")
def node_keys(spark, d):
    key = node_key(F.col("node_id"), F.col("variant_kind"), F.col("variant_value"))
    shown = F.when(F.col("variant_value") > 0, F.col("variant_value").cast("string"))
    return catalog(spark, d).table("nav_node").select(F.col("node_id").alias("id"), key.alias("key"), parse_node_key(key)["variant_value"].alias("value"), node_label(F.col("code"), F.col("name"), shown).alias("label"))


@query(r"""SELECT p_partkey AS id, concat(CAST(p_partkey % 10 AS VARCHAR), '/', CAST(p_partkey AS VARCHAR), '.png') AS image FROM part""")
def image_paths(spark, d):
    ref = F.concat(F.lit("N:GRAFIK\\"), (F.col("p_partkey") % 10).cast("string"), F.lit("\\"), F.col("p_partkey").cast("string"), F.lit(".itw;11cm;8cm;"))
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), image_path(ref).alias("image"))


# --- documented-only


@query(f"{ctes('news', 'applicability')} SELECT DISTINCT n.* FROM b_news n JOIN b_applicability a ON a.doc_id = n.doc_id AND {_FITS_SERIES}".replace("n.*", "n.id, n.doc_id, n.doc_type_id, n.published, n.title, n.sort"))
def legacy_news(spark, d):
    return legacy.news(catalog(spark, d), SERIES)


@query(f"{ctes('vehicle_action', 'chassis_document')} SELECT DISTINCT v.doc_id, v.sort, v.title FROM b_vehicle_action v JOIN b_chassis_document c USING (doc_id) WHERE c.area = 3 AND 55555 BETWEEN c.serial_from AND c.serial_to")
def legacy_vehicle_actions(spark, d):
    return legacy.vehicle_actions(catalog(spark, d), 3, 55555).select("doc_id", "sort", "title")


@query(f"{ctes('doc_type')} SELECT id, code FROM b_doc_type WHERE sort = (SELECT min(sort) FROM b_doc_type)")
def legacy_default_type(spark, d):
    return legacy.default_type(catalog(spark, d)).select("id", "code")


@query(f"{ctes('applicability')} SELECT count(*) AS rows FROM b_applicability WHERE doc_id = 100 AND 199906 BETWEEN produced_from AND produced_to")
def legacy_applicability_check(spark, d):
    return legacy.applicability_check(catalog(spark, d), 100, Vehicle(), 199906)


@query(f"{ctes('document', 'document_ref', bound=PARTS)} SELECT count(*) AS links FROM b_document_ref r WHERE source_id = 5 AND target_id IN (SELECT id FROM b_document)")
def legacy_reference_count(spark, d):
    return legacy.reference_count(catalog(spark, d, PARTS), 5)


@query(f"{ctes('vehicle_model')} SELECT min(produced_from) AS first, max(produced_to) AS last, count(*) AS models FROM b_vehicle_model WHERE series_id = 7")
def legacy_production_span(spark, d):
    return legacy.production_span(catalog(spark, d), SERIES)


@query(f"{ctes('hotspot', 'document', bound=PARTS)} SELECT o.id, o.code, o.title FROM b_hotspot h JOIN b_document o ON o.id = h.target_id WHERE h.source_id = 1 AND h.number = 2 AND o.security <= 0")
def legacy_hotspot_targets(spark, d):
    return legacy.hotspot_targets(catalog(spark, d, PARTS), 1, 2, 0)


@query(f"{ctes('vehicle_model')} SELECT DISTINCT series_id, series_name FROM b_vehicle_model")
def legacy_series(spark, d):
    return legacy.selectable_series(catalog(spark, d))


@query(f"""{ctes('chassis_range', 'vehicle_type', 'lead_type')} SELECT r.type_id, t.series_id, t.model_id, l.lead_type FROM (SELECT min(type_id) AS type_id FROM b_chassis_range WHERE area = 3 AND 20350 BETWEEN serial_from AND serial_to) r
JOIN b_vehicle_type t USING (type_id) LEFT JOIN b_lead_type l USING (type_id)""")
def legacy_chassis_lookup(spark, d):
    return legacy.chassis_lookup(catalog(spark, d), 3, 20350).select("type_id", "series_id", "model_id", "lead_type")


_ON_OFFER = """{ctes} SELECT DISTINCT series_id, series_name FROM b_vehicle_model m WHERE EXISTS (SELECT 1 FROM b_doc_type_applicability a WHERE a.doc_type_id = {t} AND a.series_id IN (0, m.series_id))"""


@query(_ON_OFFER.format(ctes=ctes("vehicle_model", "doc_type_applicability"), t=200))
def legacy_series_of_type(spark, d):
    return legacy.selectable_series(catalog(spark, d), 200)


@query(_ON_OFFER.format(ctes=ctes("vehicle_model", "doc_type_applicability"), t=100))
def legacy_series_of_generic_type(spark, d):
    return legacy.selectable_series(catalog(spark, d), 100)


@query(f"{ctes('doc_type', 'doc_type_applicability')} SELECT t.id, t.code FROM b_doc_type t WHERE t.enabled = 1 AND EXISTS (SELECT 1 FROM b_doc_type_applicability a WHERE a.doc_type_id = t.id AND a.series_id IN (0, 7))")
def legacy_type_details(spark, d):
    return legacy.type_details(catalog(spark, d), SERIES).select("id", "code")


@query(f"{ctes('path')} SELECT id, name, sort FROM b_path WHERE enabled = 1")
def legacy_paths(spark, d):
    return legacy.paths(catalog(spark, d)).select("id", "name", "sort")


@query(f"{ctes('path_node', 'group_applicability')} SELECT DISTINCT n.node_id, n.name FROM b_path_node n JOIN b_group_applicability a ON a.node_id = n.node_id AND a.path_id = 1 AND a.series_id IN (0, 7) WHERE n.path_id = 1 AND n.parent_id = 2 AND n.enabled = 1 AND n.variant_value = 0")
def legacy_path_children(spark, d):
    return legacy.path_children(catalog(spark, d), 1, 2, SERIES).select("node_id", "name")


@query(f"{ctes('document', 'applicability')} SELECT id, code, title FROM b_document WHERE doc_type_id = 3 AND enabled = 1 AND security <= 0 AND id IN (SELECT doc_id FROM b_applicability WHERE lead_type = 1)")
def legacy_document_list(spark, d):
    return legacy.document_list(catalog(spark, d), 3, lead_type=1, max_security=0).select("id", "code", "title")


@query(f"{ctes('node_document', 'document_file', 'applicability')} SELECT count(DISTINCT g.doc_id) AS documents FROM b_node_document g JOIN b_document_file f ON f.doc_id = g.doc_id JOIN b_applicability a ON a.doc_id = g.doc_id AND {_FITS_SERIES} WHERE g.node_id = 3")
def legacy_graphics_count(spark, d):
    return legacy.graphics_count(catalog(spark, d), 3, SERIES)


@query(f"{ctes('document', 'applicability')} SELECT id, title FROM b_document WHERE doc_type_id = 2 AND enabled = 1 AND id IN (SELECT doc_id FROM b_applicability a WHERE {_FITS_SERIES})")
def legacy_browse_collected(spark, d):
    c = catalog(spark, d)
    legacy.collect_applicable(c, SERIES, "collected_documents")
    return legacy.browse_collected(c, 2, "collected_documents").select("id", "title")


# --- favourites, labels and inputs


def _favourites(spark, d):
    """Every tenth part as a document, with one more, renamed, and one removed."""
    rows = spark.read.parquet(f"{d}/part.parquet").where("p_partkey % 10 = 0")
    none = [F.lit(None).cast("long").alias(c) for c in ("series_id", "model_id", "engine_id")]
    rows = rows.select(F.lit("document").alias("kind"), *none, F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("name"))
    car = {"kind": "vehicle", "series_id": 7, "model_id": 70, "engine_id": 1, "name": "car"}
    rows = favourites.add(favourites.add(rows, car), {**car, "name": "again"})
    rows = favourites.add(rows, {"kind": "document", "doc_id": 20, "name": "is there"})
    return favourites.remove(favourites.rename(rows, {"kind": "document", "doc_id": 10}, "renamed"), {"kind": "document", "doc_id": 30})


@query("""SELECT 'document' AS kind, CAST(NULL AS BIGINT) AS series_id, p_partkey AS doc_id, CASE WHEN p_partkey = 10 THEN 'renamed' ELSE p_name END AS name FROM part WHERE p_partkey % 10 = 0 AND p_partkey <> 30
UNION ALL SELECT 'vehicle', 7, NULL, 'car'""")
def favourite_list(spark, d):
    return _favourites(spark, d).select("kind", "series_id", "doc_id", "name")


@query("SELECT 'document' AS kind, count(*) - 1 AS entries FROM part WHERE p_partkey % 10 = 0 UNION ALL SELECT 'vehicle', 1")
def favourite_count(spark, d):
    return favourites.count(_favourites(spark, d))


@query("SELECT p_partkey AS id, CASE p_size WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE CAST(p_size AS VARCHAR) END AS label FROM part")
def label_maps(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), label_map(F.col("p_size"), {1: "one", 2: "two"}).alias("label"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey > 0 THEN left(CAST(c_custkey * 7919 AS VARCHAR), 4) END AS digits FROM customer WHERE c_custkey <= 150")
def code_inputs(spark, d):
    keys = [r["c_custkey"] for r in spark.read.parquet(f"{d}/customer.parquet").where("c_custkey <= 150").select("c_custkey").collect()]
    typed = [(k, f"{k * 7919:,}".replace(",", "-")) for k in keys]
    return spark.createDataFrame([(k, code_search_input(text, "IB", 6, 4)) for k, text in typed], "id long, digits string")


@query("SELECT r_regionkey AS id, lpad(CAST(r_regionkey * 400000 AS VARCHAR), CAST(greatest(6, length(CAST(r_regionkey * 400000 AS VARCHAR))) AS INT), '0') AS suffix FROM region")
def family_suffixes(spark, d):
    ids = [r["r_regionkey"] for r in spark.read.parquet(f"{d}/region.parquet").collect()]
    return spark.createDataFrame([(k, family_suffix(k * 400000)) for k in ids], "id long, suffix string")


__all__ = ["BOUND", "QUERIES", "SQL"]
