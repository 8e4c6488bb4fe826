"""Queries of the general data-preparation problems, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumidex.common import own_dir, persisted, table
from lumidex.operators import instants, nested, positions
from lumidex.plans import catalog

JSON_COLUMNS = ["info", "exif"]
#: Lists of objects that some records spell as one bare object, or may.
LISTS = frozenset(["info.subjects", "info.subjects[].parts", "info.subjects[].parts[].marks", "info.text", "info.text[].words", "info._attempts", "info.model.endpoint.limits"])
SUBJECT_COLUMNS = ["value", "name", "count", "box.x", "box.y", "box.w", "box.h"]


def p1_found(spark, d):
    return nested.nodes(table(spark, d, "images"), JSON_COLUMNS)


def p1_catalog(spark, d):
    return nested.catalog(nested.rows(table(spark, d, "images"), JSON_COLUMNS))


def p1_rows(spark, d):
    """All tables and columns in long form, whichever way a list of one is spelled."""
    return nested.flat(nested.rows(table(spark, d, "images"), JSON_COLUMNS, lists=LISTS))


def p1_subjects(spark, d):
    """Only subjects in lists, as its SQL says; p1_all_subjects has all."""
    rows = nested.rows(table(spark, d, "images"), ["info"])
    return nested.pivot(rows, "info.subjects[]", SUBJECT_COLUMNS)


def p1_all_subjects(spark, d):
    rows = nested.rows(table(spark, d, "images"), ["info"], lists=LISTS)
    return nested.pivot(rows, "info.subjects[]", SUBJECT_COLUMNS)


def p1_marks(spark, d):
    """Only marks in lists of parts in lists, as its SQL says; p1_all_marks has all."""
    rows = nested.rows(table(spark, d, "images"), ["info"])
    return nested.pivot(rows, "info.subjects[].parts[].marks[]", ["kind", "reading"])


def p1_all_marks(spark, d):
    """Parent keys are row keys of info.subjects[].parts[] in p1_rows."""
    rows = nested.rows(table(spark, d, "images"), ["info"], lists=LISTS)
    return nested.pivot(rows, "info.subjects[].parts[].marks[]", ["kind", "reading"])


def p2_found(spark, d):
    return positions.containing(positions.positions(table(spark, d, "images")), table(spark, d, "places"))


def p2_near(spark, d):
    located = persisted(positions.positions(table(spark, d, "images")), "located")
    return positions.near(located, located.filter(F.col("id") % 100 == 0), 1000.0, written=True).withColumn("nearest_m", F.round("nearest_m", 3))


def p2_neighbours(spark, d):
    """The positions near those of every hundredth picture; p2_classes says which pictures share each."""
    located = persisted(positions.positions(table(spark, d, "images")), "located")
    return positions.neighbours(located, located.filter(F.col("id") % 100 == 0), 1000.0).withColumn("metres", F.round("metres", 3))


def p2_classes(spark, d):
    return positions.memberships(persisted(positions.positions(table(spark, d, "images")), "located"))


def p3_found(spark, d):
    """The dictionary is kept for the whole application: what an earlier run has parsed is not parsed again."""
    return instants.image_instants(table(spark, d, "images"), table(spark, d, "libraries"), f"{own_dir(spark)}/instants")


QUERIES = {f.__name__: f for f in (p1_found, p1_catalog, p1_rows, p1_subjects, p1_all_subjects, p1_marks, p1_all_marks, p2_found, p2_near, p2_neighbours, p2_classes, p3_found)}

def _tree(column: str) -> str:
    cell = f"CASE WHEN {column} <> '' AND json_valid({column}) THEN CASE WHEN json_type({column}) = 'VARCHAR' THEN json_extract_string({column}, '$') ELSE {column} END END"
    node = f"'{column}' || replace(substr(fullkey, 2), chr(34), '')"
    return f"""SELECT c.id, {node} AS node FROM (SELECT id, {cell} AS cell FROM images) c, json_tree(c.cell) WHERE cell IS NOT NULL AND type = 'OBJECT' AND fullkey <> '$'"""


# The nearest enclosing object: an element of a list of objects in an object has the list's owner, found by taking off the list's place, then its key.
_NODES = f"""WITH n AS ({_tree('info')} UNION ALL {_tree('exif')})
SELECT id, node, CASE WHEN ends_with(node, ']') THEN regexp_replace(regexp_replace(node, '(\\[\\d+\\])+$', ''), '\\.[^.\\[]+$', '') ELSE regexp_replace(node, '\\.[^.\\[]+$', '') END AS parent FROM n"""



def _values(column: str) -> str:
    cell = f"CASE WHEN {column} <> '' AND json_valid({column}) THEN CASE WHEN json_type({column}) = 'VARCHAR' THEN json_extract_string({column}, '$') ELSE {column} END END"
    return f"""SELECT c.id, '{column}' AS root, '{column}' || replace(substr(fullkey, 2), chr(34), '') AS node, type FROM (SELECT id, {cell} AS cell FROM images) c, json_tree(c.cell) WHERE json_type(cell) IN ('OBJECT', 'ARRAY')"""


_CATALOG = f"""WITH n AS ({_values('info')} UNION ALL {_values('exif')}),
r AS (SELECT id, type, node, CASE WHEN contains(node, ']') THEN regexp_extract(node, '^(.*\\])', 1) ELSE root END AS inst FROM n),
t AS (SELECT id, type, inst, regexp_replace(inst, '\\[\\d+\\]', '[]', 'g') AS rel, ltrim(substr(node, length(inst) + 1), '.') AS col FROM r)
SELECT rel, NULL AS col, count(DISTINCT (id, inst)) AS n_rows FROM t GROUP BY rel
UNION ALL SELECT rel, CASE WHEN col = '' THEN 'value' ELSE col END, count(DISTINCT (id, inst)) FROM t WHERE type NOT IN ('OBJECT', 'ARRAY', 'NULL') GROUP BY 1, 2"""

_POSITIONS = catalog._POINTS
_PLACED = f"""WITH {_POSITIONS},
circle AS (SELECT p.id, place_id FROM pts p JOIN places c ON c.kind = 'circle'
  AND 2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(c.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(c.lat)) * pow(sin(radians(c.lon - p.lon) / 2), 2)))) <= c.radius_m),
corner AS (SELECT place_id, generate_subscripts(outline, 1) AS k, unnest(outline) AS c, len(outline) AS m, outline FROM places WHERE kind = 'outline'),
side AS (SELECT place_id, c.lat AS y1, c.lon AS x1, outline[k % m + 1].lat AS y2, outline[k % m + 1].lon AS x2 FROM corner),
turned AS (SELECT id, lat, lon + t AS lon FROM pts, (VALUES (-360.0), (0.0), (360.0)) v(t)),
inside AS (SELECT id, place_id FROM turned p JOIN side s ON (s.x1 > p.lon) <> (s.x2 > p.lon) AND s.y1 + (p.lon - s.x1) * (s.y2 - s.y1) / (s.x2 - s.x1) > p.lat GROUP BY id, place_id, p.lon HAVING count(*) % 2 = 1)
SELECT id, place_id FROM circle UNION SELECT id, place_id FROM inside"""

_UNIT = lambda v: "CASE " + " ".join(f"WHEN {v} >= {978307200 * u}::DOUBLE AND {v} < {1767225600 * u}::DOUBLE THEN CAST(CAST(trunc({v}) AS HUGEINT) // {u} AS BIGINT)" for u in (1, 10**3, 10**6, 10**9)) + " END"
_FORMS = "['%Y:%m:%d %H:%M:%S', '%Y/%m/%d %H:%M', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%d %H:%M:%S', '%d.%m.%Y %H:%M:%S', '%Y%m%d_%H%M%S', '%Y%m%dT%H%M%S', '%b %d, %Y %I:%M:%S %p', '%a %b %d %H:%M:%S %Y', '%Y-%m-%dT%H:%M', '%a, %d %b %Y %H:%M:%S', '%d %B %Y, %I:%M %p']"
_ZONE = "^(.*?(?:\\d:\\d{1,2}|[T_]\\d{6}))(\\.\\d+)? ?(Z|UTC|GMT|[A-Z][A-Za-z]+/[A-Za-z_]+|[+-]\\d{2}:?(?:\\d{2})?)?(\\[.*\\])?$"
_INSTANTS = f"""WITH {catalog._EXIF}, zones AS (SELECT name, max(tz) AS tz FROM libraries GROUP BY name),
f AS (SELECT ex.id, field_name, tz, trim(regexp_replace(json_extract_string(e, '$.' || field_name), '\\s+', ' ', 'g')) AS t FROM ex JOIN images i ON i.id = ex.id LEFT JOIN zones ON zones.name = i.library, (VALUES ('DateTimeOriginal'), ('DateTime')) v(field_name)),
p AS (SELECT *, regexp_extract(t, '{_ZONE}', 1) AS clock, regexp_extract(t, '{_ZONE}', 3) AS z FROM f WHERE t IS NOT NULL),
l AS (SELECT *, try_strptime(CASE WHEN clock = '' OR regexp_matches(t, '[APap][Mm]$|:\\d\\d \\d{{4}}$') THEN t ELSE clock END, {_FORMS}) AS wall,
  CASE WHEN z IN ('Z', 'UTC', 'GMT') THEN 0 WHEN regexp_matches(z, '^[+-]') THEN CASE WHEN z[1] = '-' THEN -1 ELSE 1 END * (CAST(substr(z, 2, 2) AS INTEGER) * 3600 + coalesce(TRY_CAST(regexp_extract(z, '^[+-]\\d\\d:?(\\d\\d)$', 1) AS INTEGER), 0) * 60) END AS shift, CASE WHEN contains(z, '/') THEN z ELSE tz END AS place FROM p),
u AS (SELECT *, CASE WHEN shift IS NULL AND place IS NOT NULL THEN timezone(place, wall) END AS x FROM l),
r AS (SELECT id, field_name, CASE WHEN regexp_full_match(t, '\\d{{9,19}}') THEN {_UNIT("CAST(t AS DOUBLE)")} WHEN shift IS NOT NULL THEN CAST(epoch(wall) AS BIGINT) - shift
  WHEN timezone(place, x) = wall AND timezone(place, x - INTERVAL 1 HOUR) <> wall AND timezone(place, x + INTERVAL 1 HOUR) <> wall AND timezone(place, x - INTERVAL 30 MINUTE) <> wall AND timezone(place, x + INTERVAL 30 MINUTE) <> wall THEN CAST(epoch(x) AS BIGINT) END AS epoch_s FROM u
  UNION ALL SELECT id, 'mtime', {_UNIT("mtime")} FROM images)
SELECT id, field_name, epoch_s FROM r WHERE epoch_s >= 978307200 AND epoch_s < 1767225600"""

_NEAR = f"""WITH {_POSITIONS}, far AS (SELECT q.id, 2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(p.lat - q.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(q.lat)) * pow(sin(radians(p.lon - q.lon) / 2), 2)))) AS m FROM pts q JOIN pts p ON q.id % 100 = 0 AND p.id <> q.id),
n AS (SELECT id, count(*) AS n_near, min(m) AS m FROM far WHERE m <= 1000.0 GROUP BY id)
SELECT pts.id, coalesce(n_near, 0) AS n_near, round(m, 3) AS nearest_m FROM pts LEFT JOIN n USING (id) WHERE pts.id % 100 = 0"""

_CLASSES = f"""WITH {_POSITIONS}, c AS (SELECT lat, lon, min(id) AS class_id, count(*) AS n FROM pts GROUP BY lat, lon)"""
_NEIGHBOURS = f"""{_CLASSES}, q AS (SELECT DISTINCT class_id, c.lat, c.lon FROM c JOIN pts ON pts.lat = c.lat AND pts.lon = c.lon WHERE pts.id % 100 = 0),
far AS (SELECT q.class_id, c.class_id AS near_class, c.n, 2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(c.lat - q.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(q.lat)) * pow(sin(radians(c.lon - q.lon) / 2), 2)))) AS m FROM q JOIN c ON c.class_id <> q.class_id)
SELECT class_id, near_class, n, round(m, 3) AS metres FROM far WHERE m <= 1000.0"""

_INFO = """i AS (SELECT id, CASE WHEN info <> '' AND json_valid(info) THEN CASE WHEN json_type(info) = 'VARCHAR' THEN json_extract_string(info, '$') ELSE info END END AS j FROM images),
s AS (SELECT id, k, json_extract(j, '$.subjects[' || k || ']') AS x FROM (SELECT id, j, unnest(range(0, CAST(json_array_length(j, '$.subjects') AS BIGINT))) AS k FROM i WHERE json_type(j, '$.subjects') = 'ARRAY'))"""
_SUBJECTS = f"""WITH {_INFO} SELECT id, k::VARCHAR AS row_key, '' AS parent_key, CASE WHEN json_type(x) NOT IN ('OBJECT', 'NULL') THEN json_extract_string(x, '$') END AS value, json_extract_string(x, '$.name') AS name,
  json_extract_string(x, '$.count') AS count, json_extract_string(x, '$.box.x') AS box_x, json_extract_string(x, '$.box.y') AS box_y, json_extract_string(x, '$.box.w') AS box_w, json_extract_string(x, '$.box.h') AS box_h FROM s"""
_MARKS = f"""WITH {_INFO}, p AS (SELECT id, k, q, json_extract(x, '$.parts[' || q || ']') AS y FROM (SELECT id, k, x, unnest(range(0, CAST(json_array_length(x, '$.parts') AS BIGINT))) AS q FROM s WHERE json_type(x, '$.parts') = 'ARRAY')),
m AS (SELECT id, k, q, r, json_extract(y, '$.marks[' || r || ']') AS z FROM (SELECT id, k, q, y, unnest(range(0, CAST(json_array_length(y, '$.marks') AS BIGINT))) AS r FROM p WHERE json_type(y, '$.marks') = 'ARRAY'))
SELECT id, k || '.' || q || '.' || r AS row_key, k || '.' || q AS parent_key, json_extract_string(z, '$.kind') AS kind, json_extract_string(z, '$.reading') AS reading FROM m"""
# The same with one bare object as a list of one.
_ONE = lambda j, f: f"CASE json_type({j}, '$.{f}') WHEN 'ARRAY' THEN CAST(json_extract({j}, '$.{f}') AS JSON[]) WHEN 'OBJECT' THEN [json_extract({j}, '$.{f}')] END"
_ALL = f"""{_INFO.partition(',\ns AS')[0]},
sl AS (SELECT id, {_ONE('j', 'subjects')} AS l FROM i), s AS (SELECT id, unnest(range(len(l))) AS k, unnest(l) AS x FROM sl)"""
_ALL_SUBJECTS = f"WITH {_ALL}" + _SUBJECTS[len(f"WITH {_INFO}") :]
_ALL_MARKS = f"""WITH {_ALL}, pl AS (SELECT id, k, {_ONE('x', 'parts')} AS l FROM s), p AS (SELECT id, k, unnest(range(len(l))) AS q, unnest(l) AS y FROM pl),
ml AS (SELECT id, k, q, {_ONE('y', 'marks')} AS l FROM p), m AS (SELECT id, k, q, unnest(range(len(l))) AS r, unnest(l) AS z FROM ml)
SELECT id, k || '.' || q || '.' || r AS row_key, k || '.' || q AS parent_key, json_extract_string(z, '$.kind') AS kind, json_extract_string(z, '$.reading') AS reading FROM m"""

SQL = {"p1_found": _NODES, "p1_all_subjects": _ALL_SUBJECTS, "p1_all_marks": _ALL_MARKS, "p1_catalog": _CATALOG, "p1_subjects": _SUBJECTS, "p1_marks": _MARKS, "p2_found": _PLACED, "p2_near": _NEAR, "p2_neighbours": _NEIGHBOURS, "p2_classes": f"{_CLASSES} SELECT pts.id, class_id FROM pts JOIN c ON pts.lat = c.lat AND pts.lon = c.lon", "p3_found": _INSTANTS}
