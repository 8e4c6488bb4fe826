"""Queries of the catalog's own operators, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumidex.common import json_variant, persisted, table
from lumidex.functions import scalars
from lumidex.operators import describe, diff, export, mapview, positions, progress, search, stacks

SCAN = 3
VIEW, ZOOM, SCREEN = (20.0, -60.0), 1, (900.0, 500.0)

QUERIES, SQL = {}, {}

# Pieces of SQL used by several queries.
_EXIF = """ex AS (SELECT id, mtime, CASE WHEN exif <> '' AND json_valid(exif) THEN CASE WHEN json_type(exif) = 'VARCHAR' THEN json_extract_string(exif, '$') ELSE exif END END AS e FROM images)"""


def _degrees(field: str) -> str:
    c, ref = f"json_extract(e, '$.GPS.{field}')", f"json_extract_string(e, '$.GPS.{field}Ref')"
    parts = f"""CASE json_type({c}) WHEN 'ARRAY' THEN list_transform(json_extract({c}, '$[*]'), lambda v: TRY_CAST(json_extract_string(v, '$') AS DOUBLE))
        WHEN 'VARCHAR' THEN list_transform(string_split(json_extract_string({c}, '$'), ''), lambda v: TRY_CAST(v AS DOUBLE)) END"""
    return f"""CASE WHEN coalesce({ref}, '') = '' THEN NULL ELSE CASE WHEN {ref} IN ('S', 'W') THEN -1.0 ELSE 1.0 END *
      CASE WHEN json_type({c}) IN ('DOUBLE', 'BIGINT', 'UBIGINT', 'INTEGER') THEN CAST({c} AS DOUBLE)
           WHEN len({parts}) > 0 AND NOT list_contains(list_transform({parts}, lambda v: v IS NULL), true)
           THEN ({parts})[1] + coalesce(({parts})[2], 0.0) / 60.0 + coalesce(({parts})[3], 0.0) / 3600.0 END END"""


_POINTS = f"""{_EXIF}, deg AS (SELECT id, {_degrees("GPSLatitude")} AS lat, {_degrees("GPSLongitude")} AS lon FROM ex WHERE e IS NOT NULL AND json_type(e, '$.GPS') = 'OBJECT'),
pts AS (SELECT * FROM deg WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0))"""

_HALF = lambda c, at: f"coalesce(TRY_CAST('0x' || regexp_extract(lower(substr({c}, {at}, 8)), '^[0-9a-f]+') AS BIGINT), 0)"
_HAM = lambda a, b: f"CASE WHEN length({a}) = 16 AND length({b}) = 16 THEN bit_count(xor({_HALF(a, 1)}, {_HALF(b, 1)})) + bit_count(xor({_HALF(a, 9)}, {_HALF(b, 9)})) ELSE 64 END"

_STACKS = f"""h AS (SELECT id, name, dhash, lag(dhash) OVER (ORDER BY dhash, name, id) AS b FROM images WHERE coalesce(dhash, '') <> ''),
g AS (SELECT *, sum(CASE WHEN b IS NULL OR {_HAM('dhash', 'b')} > 8 THEN 1 ELSE 0 END) OVER (ORDER BY dhash, name, id ROWS UNBOUNDED PRECEDING) AS no FROM h),
s AS (SELECT id, name, dhash, 0 AS section, CASE WHEN length(dhash) = 16 THEN min(dhash) OVER (PARTITION BY no) ELSE dhash || '#' || id END AS stack FROM g
      UNION ALL SELECT id, name, dhash, 1, coalesce(dhash, '') || '#' || id FROM images WHERE coalesce(dhash, '') = '')"""

_DROPS = lambda t: f"(list_contains(list_transform(pats, lambda g: {t} GLOB g), true))"
_LISTING = f"""newest AS (SELECT library, path, unnest(max(struct_pack(seen_at := seen_at, name := name, size := size, mtime := mtime, ctime := ctime))) FROM file_listing WHERE scan_no = {SCAN} GROUP BY library, path),
globs AS (SELECT name AS lib, list_transform(list_filter(ignore_globs, lambda g: trim(g) <> ''), lambda g: replace(trim(g), '\\', '/')) AS pats FROM libraries),
dirs AS (SELECT n.*, pats, string_split(path, '/') AS parts FROM newest n JOIN globs ON lib = library),
folders AS (SELECT *, list_transform(range(1, len(parts)), lambda i: array_to_string(parts[1:i], '/')) AS up FROM dirs),
flagged AS (SELECT *, {_DROPS('path')} OR list_contains(list_transform(up, lambda d: {_DROPS('d')} OR {_DROPS("(d || '/_')")}), true) AS dropped FROM folders),
want AS (SELECT * FROM flagged WHERE NOT dropped AND regexp_matches(lower(name), '\\.(jpg|jpeg|png|gif|heic)$'))"""


# The same over every path of all scans; libraries that are not configured have no answer.
_LISTING_ALL = """globs AS (SELECT name AS lib, list_transform(list_filter(ignore_globs, lambda g: trim(g) <> ''), lambda g: replace(trim(g), '\\', '/')) AS pats FROM libraries),
dirs AS (SELECT DISTINCT library, path, pats, string_split(path, '/') AS parts FROM file_listing LEFT JOIN globs ON lib = library),
folders AS (SELECT *, list_transform(range(1, len(parts)), lambda i: array_to_string(parts[1:i], '/')) AS up FROM dirs)"""
_FLAG = f"CASE WHEN pats IS NOT NULL THEN {_DROPS('path')} OR list_contains(list_transform(up, lambda d: {_DROPS('d')} OR {_DROPS("(d || '/_')")}), true) END"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def images(spark, d):
    return table(spark, d, "images")


def located(spark, d):
    return positions.positions(images(spark, d))


def config(spark, d) -> list[tuple[str, list[str]]]:
    """The configured libraries: a small list that the driver holds."""
    return [(r["name"], r["ignore_globs"] or []) for r in table(spark, d, "libraries").collect()]


@query("SELECT id, name, library, search_text AS text, dhash FROM images")
def search_index(spark, d):
    return search.index(images(spark, d))


@query("SELECT id, name, library FROM images WHERE contains(search_text, 'harbour') AND contains(search_text, 'red')")
def search_all_terms(spark, d):
    return search.search(images(spark, d), "  Red HARBOUR ").select("id", "name", "library")


@query("SELECT id, name, library FROM images WHERE contains(search_text, '2018') AND contains(search_text, 'img_') AND library = 'Phone backup'")
def search_in_library(spark, d):
    return search.search(images(spark, d), "img_ 2018", "Phone backup").select("id", "name", "library")


@query("SELECT id, name, library FROM images WHERE contains(search_text, 'the') ORDER BY name, id LIMIT 500")
def search_top500(spark, d):
    return search.top(search.search(images(spark, d), "the", search.ALL_LIBRARIES).select("id", "name", "library"))


@query("SELECT term_id AS query_id, count(*) AS n FROM canonical_terms JOIN images ON list_bool_and(list_transform(string_split(lower(term), ' '), lambda t: contains(search_text, t))) GROUP BY term_id")
def search_many_queries(spark, d):
    asked = {r["term_id"]: r["term"] for r in table(spark, d, "canonical_terms").collect()}
    return search.search_many(images(spark, d), asked).groupBy("query_id").agg(F.count("*").alias("n"))


@query("SELECT id, lower(name || ' ' || path) AS text FROM images")
def search_text_plain(spark, d):
    return images(spark, d).select("id", search.plain_text().alias("text"))


_ITEMS = lambda f: f"CASE WHEN json_type(j, '$.{f}') = 'ARRAY' THEN list_transform(CAST(json_extract(j, '$.{f}') AS JSON[]), lambda v: json_extract_string(v, '$')) ELSE [] END"
_PART = lambda f: f"coalesce(json_extract_string(j, '$.{f}'), '')"


@query(f"""WITH i AS (SELECT id, name, path, CASE WHEN json_valid(info) THEN info END AS j FROM images WHERE described = 1)
SELECT id, lower(array_to_string(list_concat([name, path, {_PART('description')}, {_PART('text')}], list_filter(list_concat({_ITEMS('subjects')}, {_ITEMS('tags')}, {_ITEMS('colors')}), lambda v: v IS NOT NULL)), ' ')) AS text FROM i""")
def search_text_described(spark, d):
    info = F.from_json("info", describe.INFO_DDL)
    return images(spark, d).filter("described = 1").select("id", search.described_text(info).alias("text"))


@query("SELECT id, library, path, name, size, mtime, width, height, described, nullif(info, '') AS info, coalesce(nullif(exif, ''), '{}') AS exif FROM images")
def detail_records(spark, d):
    return export.detail(images(spark, d))


@query("SELECT id, library, path, name, size, mtime, width, height, described, nullif(info, '') AS info, coalesce(nullif(exif, ''), '{}') AS exif FROM images WHERE id = 100")
def point_lookup(spark, d):
    return export.detail(images(spark, d).filter(F.col("id") == 100))


@query("SELECT id, thumb_shard, thumb_offset, thumb_length FROM images WHERE thumb_shard IS NOT NULL")
def thumb_locators(spark, d):
    return images(spark, d).filter(F.col("thumb_shard").isNotNull()).select("id", "thumb_shard", "thumb_offset", "thumb_length")


_COUNTS = """count(*) AS total, CAST(sum(described) AS BIGINT) AS described, CAST(sum(CASE WHEN described = 1 AND prompt_ver = 4 THEN 1 ELSE 0 END) AS BIGINT) AS "current" FROM images"""
_SHOWN = """described, "current", total - "current" AS "left", total, CASE WHEN "current" = 0 THEN '-' ELSE printf('%.2f%%', "current" / total * 100) END AS done"""


@query(f"SELECT library, {_SHOWN} FROM (SELECT library, {_COUNTS} GROUP BY library)")
def progress_counts(spark, d):
    return progress.counts(images(spark, d))


@query(f"SELECT library, {_SHOWN} FROM (SELECT CASE WHEN grouping(library) = 1 THEN '(all)' ELSE library END AS library, {_COUNTS} GROUP BY ROLLUP (library))")
def progress_rollup(spark, d):
    return progress.counts(images(spark, d), total=True)


_QUEUE = "SELECT CASE WHEN described = 0 THEN 0 ELSE 1 END AS bucket, id, library, path FROM images WHERE described = 0 OR (described = 1 AND prompt_ver < 4)"


@query(_QUEUE)
def pending_queue(spark, d):
    return progress.pending(images(spark, d))


@query(_QUEUE)
def pending_newest_first(spark, d):
    return progress.pending(images(spark, d), newest_first=True)


@query(f"WITH {_EXIF} SELECT id, coalesce(CASE WHEN regexp_full_match(json_extract_string(e, '$.DateTimeOriginal'), '\\S.*\\S') THEN epoch(try_strptime(json_extract_string(e, '$.DateTimeOriginal'), '%Y:%m:%d %H:%M:%S')) END, CASE WHEN regexp_full_match(json_extract_string(e, '$.DateTime'), '\\S.*\\S') THEN epoch(try_strptime(json_extract_string(e, '$.DateTime'), '%Y:%m:%d %H:%M:%S')) END, mtime) AS seconds FROM ex")
def capture_order(spark, d):
    rows = images(spark, d).select("id", "mtime", json_variant("exif").alias("v"))
    return rows.select("id", progress.capture_seconds(F.col("v")).alias("seconds"))


@query("SELECT vec_id, lower(lpad(printf('%x', list_sum(list_transform(range(0, 32), lambda i: CASE WHEN embedding[i + 1] > embedding[i + 2] THEN CAST(pow(2, 31 - i) AS BIGINT) ELSE 0 END))::BIGINT), 8, '0') || lpad(printf('%x', list_sum(list_transform(range(32, 64), lambda i: CASE WHEN embedding[i + 1] > embedding[(i + 1) % 64 + 1] THEN CAST(pow(2, 63 - i) AS BIGINT) ELSE 0 END))::BIGINT), 8, '0')) AS dhash FROM embeddings")
def dhash_pack(spark, d):
    e = F.col("embedding")
    flags = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.element_at(e, k + 1) > F.element_at(e, (k + 1) % 64 + 1))
    return table(spark, d, "embeddings").select("vec_id", scalars.pack_bits(flags).alias("dhash"))


@query(f"WITH p AS (SELECT i.id, i.dhash AS a, min(o.dhash) AS b FROM images i JOIN images o ON o.library = i.library GROUP BY i.id, i.dhash) SELECT id, CAST({_HAM('a', 'b')} AS INTEGER) AS bits FROM p")
def hamming_distance(spark, d):
    rows = images(spark, d).select("id", "library", "dhash")
    least = rows.groupBy("library").agg(F.min("dhash").alias("least"))
    return rows.join(least, "library").select("id", scalars.hamming(F.col("dhash"), F.col("least")).alias("bits"))


@query(f"WITH {_STACKS} SELECT id, section, stack FROM s")
def similar_stacks(spark, d):
    return stacks.stacks(images(spark, d)).select("id", "section", "stack")


@query(f"WITH {_STACKS} SELECT stack, count(*) AS n FROM s GROUP BY stack HAVING count(*) > 1")
def stack_sizes(spark, d):
    return stacks.sizes(stacks.stacks(images(spark, d))).filter("n > 1").select("stack", "n")


@query(f"WITH {_STACKS}, z AS (SELECT section, stack, count(*) AS n, min(CASE WHEN section = 0 THEN dhash END) AS h, min(struct_pack(d := dhash, n := name, i := id)) AS f FROM s GROUP BY section, stack), r AS (SELECT stack, n, sum(n) OVER (ORDER BY section, h, f.n, f.i ROWS UNBOUNDED PRECEDING) - n AS before FROM z) SELECT stack, n FROM r WHERE before < 500")
def stack_cap(spark, d):
    return stacks.capped(stacks.stacks(images(spark, d)))


@query("SELECT library, count(*) AS n FROM images WHERE dhash = '' GROUP BY library")
def missing_hashes(spark, d):
    return images(spark, d).filter(F.col("dhash") == "").groupBy("library").agg(F.count("*").alias("n"))


@query(f"WITH {_LISTING} SELECT library, path, dropped FROM flagged")
def ignore_globs(spark, d):
    rows = diff.latest(table(spark, d, "file_listing"), SCAN)
    dropped = diff.dropped(config(spark, d))
    return rows.select("library", "path", dropped.alias("dropped"))


@query(f"""WITH {_LISTING_ALL} SELECT DISTINCT library, path, {_FLAG} AS dropped FROM folders""")
def ignore_globs_all(spark, d):
    """Every listed path of all scans."""
    rows = table(spark, d, "file_listing").select("library", "path").distinct()
    return rows.select("library", "path", diff.dropped(config(spark, d)).alias("dropped"))


@query(f"WITH {_LISTING} SELECT coalesce(o.library, n.library) AS library, coalesce(o.path, n.path) AS path, o.id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN coalesce(o.size = n.size AND abs(o.mtime - n.mtime) < 1.0, false) THEN 'unchanged' ELSE 'updated' END AS action FROM images o FULL JOIN want n ON o.library = n.library AND o.path = n.path")
def snapshot_diff(spark, d):
    listing = diff.wanted(diff.latest(table(spark, d, "file_listing"), SCAN), config(spark, d))
    return diff.diff(images(spark, d), listing, [name for name, _ in config(spark, d)])


@query(f"""WITH {_LISTING}, seen AS (SELECT DISTINCT library FROM file_listing WHERE scan_no = {SCAN} AND received_at - seen_at < INTERVAL 1 DAY),
st AS (SELECT l.name AS library, CASE WHEN s.library IS NULL THEN 'missing' ELSE 'found' END AS state FROM (SELECT DISTINCT name FROM libraries WHERE tz IS NOT NULL) l LEFT JOIN seen s ON s.library = l.name)
SELECT st.library, state, count(i.id) FILTER (state = 'found' AND n.path IS NULL) AS removed, count(i.id) FILTER (state = 'missing' AND n.path IS NULL) AS retained FROM st LEFT JOIN images i ON i.library = st.library LEFT JOIN want n ON n.library = i.library AND n.path = i.path GROUP BY ALL""")
def library_states(spark, d):
    """What a scan does to each library in use: a library without a file in it is missing, and loses no row."""
    every = table(spark, d, "file_listing")
    known = table(spark, d, "libraries").filter(F.col("tz").isNotNull()).select(F.col("name").alias("library")).distinct()
    seen = every.filter((F.col("scan_no") == SCAN) & (F.col("received_at") - F.col("seen_at") < F.expr("INTERVAL 1 DAY"))).select("library").distinct()
    states = persisted(known.join(seen.withColumn("state", F.lit("found")), "library", "left").fillna("missing", "state"), "states")
    whole = [r["library"] for r in states.filter("state = 'found'").collect()]
    actions = diff.diff(images(spark, d), diff.wanted(diff.latest(every, SCAN), config(spark, d)), [r["library"] for r in states.collect()], whole)
    counts = actions.groupBy("library").agg(F.count_if(F.col("action") == "removed").alias("removed"), F.count_if(F.col("action") == "unseen").alias("retained"))
    return states.join(counts, "library", "left").select("library", "state", F.coalesce("removed", F.lit(0)).alias("removed"), F.coalesce("retained", F.lit(0)).alias("retained"))


@query("SELECT id, library, path FROM images WHERE library NOT IN (SELECT name FROM libraries WHERE tz IS NOT NULL)")
def unconfigured_rows(spark, d):
    known = table(spark, d, "libraries").filter(F.col("tz").isNotNull()).select(F.col("name").alias("library"))
    return images(spark, d).join(known, "library", "left_anti").select("id", "library", "path")


@query("SELECT thumb_shard AS shard, thumb_offset AS \"offset\", thumb_length AS length, CAST(coalesce(sum(thumb_length) OVER (PARTITION BY thumb_shard ORDER BY thumb_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS new_offset FROM images WHERE thumb_shard IS NOT NULL AND described = 1")
def compact_offsets(spark, d):
    kept = images(spark, d).filter(F.col("thumb_shard").isNotNull() & (F.col("described") == 1))
    return diff.compact(kept.select(F.col("thumb_shard").alias("shard"), F.col("thumb_offset").alias("offset"), F.col("thumb_length").alias("length")))


def _fold(items: str, limit: int, start: str) -> str:
    """Next-fit as a recursive walk over numbered items (rn, id, size)."""
    return f"""items AS ({items}), walk AS (SELECT 0::BIGINT AS rn, NULL::BIGINT AS id, 0::BIGINT AS size, s.shard, 0::BIGINT AS "offset", s.used, s.nothing FROM ({start}) s
      UNION ALL SELECT i.rn, i.id, i.size, CASE WHEN NOT w.nothing AND w.used + i.size > {limit} THEN w.shard + 1 ELSE w.shard END, CASE WHEN NOT w.nothing AND w.used + i.size > {limit} THEN 0 ELSE w.used END,
      CASE WHEN NOT w.nothing AND w.used + i.size > {limit} THEN i.size ELSE w.used + i.size END, false FROM walk w JOIN items i ON i.rn = w.rn + 1)"""


@query(f"WITH RECURSIVE {_fold('SELECT row_number() OVER (ORDER BY id) AS rn, id, coalesce(thumb_length, 0) AS size FROM images', 1_048_576, 'SELECT 0::BIGINT AS shard, 0::BIGINT AS used, true AS nothing')} SELECT id, size, shard, \"offset\" FROM walk WHERE rn > 0")
def next_fit_shards(spark, d):
    return export.next_fit(images(spark, d).select("id", F.col("thumb_length").alias("size")), limit=1_048_576)


_PLAN = f"""cur AS (SELECT id, sha1(coalesce(info, '') || '|' || coalesce(exif, '')) AS digest, length(search_text) + 2 AS size, described FROM images),
prev AS (SELECT shard::BIGINT AS shard, e.id, CASE WHEN coalesce(c.described, 0) = 1 THEN c.digest ELSE e.digest END AS old FROM export_state e LEFT JOIN cur c ON c.id = e.id),
b AS (SELECT shard, c.id, c.digest, c.size, c.id IS NULL OR c.digest <> old AS touched FROM prev LEFT JOIN cur c USING (id)),
sh AS (SELECT shard, bool_or(coalesce(touched, true)) AS touched, CAST(coalesce(sum(size), 0) AS BIGINT) AS used, count(id) AS n FROM b GROUP BY shard),
{_fold('SELECT row_number() OVER (ORDER BY id) AS rn, id, size FROM cur WHERE id NOT IN (SELECT id FROM prev)', 100_000, 'SELECT shard, used, n = 0 AS nothing FROM sh ORDER BY shard DESC LIMIT 1')},
added AS (SELECT w.shard, w.id, c.digest FROM walk w JOIN cur c ON c.id = w.id WHERE w.rn > 0),
allrows AS (SELECT shard, id, digest FROM b WHERE id IS NOT NULL UNION ALL SELECT * FROM added),
every AS (SELECT coalesce(sh.shard, a.shard) AS shard, coalesce(sh.touched, false) OR a.shard IS NOT NULL AS dirty FROM sh FULL JOIN (SELECT DISTINCT shard FROM added) a ON a.shard = sh.shard)"""


def _plan(spark, d):
    rows = images(spark, d).select("id", F.sha1(F.concat(F.coalesce("info", F.lit("")), F.lit("|"), F.coalesce("exif", F.lit("")))).alias("digest"), (F.length("search_text") + 2).cast("bigint").alias("size"), "described")
    state = table(spark, d, "export_state").alias("e")
    prev = state.join(rows.alias("c"), F.col("e.id") == F.col("c.id"), "left").select("e.shard", "e.pos", "e.id", F.when(F.coalesce("c.described", F.lit(0)) == 1, F.col("c.digest")).otherwise(F.col("e.digest")).alias("digest"))
    return export.plan(rows.select("id", "digest", "size"), prev, limit=100_000)


@query(f"WITH RECURSIVE {_PLAN} SELECT e.shard, r.id, r.digest, e.dirty FROM every e LEFT JOIN allrows r ON r.shard = e.shard")
def export_plan(spark, d):
    return _plan(spark, d)


@query(f"WITH RECURSIVE {_PLAN} SELECT (SELECT list_sort(list_distinct(list(library))) FROM images) AS libraries, (SELECT list_sort(list(DISTINCT printf('data-%04d.json', shard))) FROM every) AS shards, (SELECT count(*) FROM images) AS count, 0::BIGINT AS generated")
def export_manifest(spark, d):
    return export.manifest(images(spark, d), _plan(spark, d), 0)


@query("SELECT id, sha1(printf('{\"id\":%d,\"size\":%d,\"width\":%d,\"height\":%d}', id, size, width, height)) AS digest FROM images")
def record_digest(spark, d):
    return images(spark, d).select("id", export.digest(F.struct("id", "size", "width", "height")).alias("digest"))


@query()
def export_digests(spark, d):
    return export.digests(export.export_records(images(spark, d)))


@query("SELECT e.id || '.json' AS file FROM export_state e WHERE e.id NOT IN (SELECT id FROM images)")
def export_orphans(spark, d):
    name = F.concat(F.col("id").cast("string"), F.lit(".json")).alias("file")
    return export.orphans(table(spark, d, "export_state").select(name), images(spark, d).select(name))


@query("SELECT id, CASE WHEN ends_with(lower(name), '.heic') OR regexp_extract(lower(name), '[^./][^/]*\\.([^./]+)$', 1) = '' THEN 'jpg' ELSE regexp_extract(lower(name), '[^./][^/]*\\.([^./]+)$', 1) END AS ext, CASE WHEN ends_with(lower(name), '.png') THEN 'image/png' WHEN ends_with(lower(name), '.gif') THEN 'image/gif' ELSE 'image/jpeg' END AS mime FROM images")
def file_kinds(spark, d):
    return images(spark, d).select("id", scalars.export_extension(F.col("name")).alias("ext"), scalars.mime(F.col("name")).alias("mime"))


@query("SELECT scan_no, library, path, regexp_matches(lower(name), '\\.(jpg|jpeg|png|gif|heic)$') AS is_image, ends_with(lower(name), '.heic') AS is_heic FROM file_listing")
def image_files(spark, d):
    return table(spark, d, "file_listing").select("scan_no", "library", "path", scalars.is_image(F.col("name")).alias("is_image"), scalars.is_heic(F.col("name")).alias("is_heic"))


_TENTH = lambda unit: f"printf('%.1f', floor(size / {unit}.0 * 10 + 0.5) / 10)"


@query(f"SELECT id, CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN {_TENTH(1024)} || ' KB' WHEN size < 1073741824 THEN {_TENTH(1048576)} || ' MB' ELSE {_TENTH(1073741824)} || ' GB' END AS text FROM images")
def human_size(spark, d):
    return images(spark, d).select("id", scalars.human_size(F.col("size")).alias("text"))


@query("""SELECT id, CASE WHEN isfinite(ctime) AND ctime <> 0 AND ctime BETWEEN -62135596800 AND 253402300799 THEN strftime(make_timestamp(CAST(floor(ctime) AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') ELSE '' END AS text FROM images""")
def when_text_all(spark, d):
    """Every row; '' for times that are 0, null, no number or outside the years 1 to 9999."""
    known = F.when(F.col("ctime").between(-62_135_596_800, 253_402_300_799), scalars.when_text(F.col("ctime")))
    return images(spark, d).select("id", F.coalesce(known, F.lit("")).alias("text"))


@query("SELECT id, CASE WHEN ctime = 0 THEN '' ELSE strftime(make_timestamp(CAST(floor(ctime) AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') END AS text FROM images WHERE ctime BETWEEN 0 AND 4e9")
def when_text(spark, d):
    return images(spark, d).filter(F.col("ctime").between(0, 4e9)).select("id", scalars.when_text(F.col("ctime")).alias("text"))


@query("SELECT id, '/detail?id=' || id AS page, '/api/image/' || id AS data, '/thumb/' || id AS thumb, '/image/' || id AS image, 'images/' || id || '.' || CASE WHEN ends_with(lower(name), '.heic') OR regexp_extract(lower(name), '[^./][^/]*\\.([^./]+)$', 1) = '' THEN 'jpg' ELSE regexp_extract(lower(name), '[^./][^/]*\\.([^./]+)$', 1) END AS file FROM images")
def record_links(spark, d):
    return images(spark, d).select("id", scalars.links(F.col("id"), F.col("name")).alias("l")).select("id", "l.*")


@query("SELECT i.id, l.path || '/' || i.path AS disk_path FROM images i LEFT JOIN libraries l ON l.name = i.library")
def disk_paths(spark, d):
    roots = table(spark, d, "libraries").select(F.col("name").alias("library"), F.col("path").alias("root"))
    return images(spark, d).join(roots, "library", "left").select("id", F.concat("root", F.lit("/"), "path").alias("disk_path"))


@query("SELECT name, string_split(replace(path, '\\', '/'), '/')[-1] AS last FROM libraries")
def path_names(spark, d):
    return table(spark, d, "libraries").select("name", scalars.model_name(F.col("path")).alias("last"))


@query(f"WITH {_EXIF}, k AS (SELECT id, e, unnest(json_keys(e)) AS key FROM ex WHERE json_type(e) = 'OBJECT') SELECT id, key, CASE WHEN json_type(e, '$.' || key) = 'ARRAY' THEN array_to_string(list_transform(CAST(json_extract(e, '$.' || key) AS JSON[]), lambda v: json_extract_string(v, '$')), ', ') ELSE json_extract_string(e, '$.' || key) END AS value FROM k WHERE key <> 'GPS'")
def exif_fields(spark, d):
    rows = images(spark, d).select("id", json_variant("exif").alias("v")).filter(F.schema_of_variant("v").startswith("OBJECT"))
    rows.createOrReplaceTempView("lumidex_exif_fields")
    fields = spark.sql("SELECT id, x.key, x.value AS item FROM lumidex_exif_fields, LATERAL variant_explode(v) x WHERE x.key <> 'GPS'")
    many = F.array_join(F.transform(F.try_variant_get("item", "$", "array<variant>"), lambda x: F.try_variant_get(x, "$", "string")), ", ")
    return fields.select("id", "key", F.when(F.schema_of_variant("item").startswith("ARRAY"), many).otherwise(F.try_variant_get("item", "$", "string")).alias("value"))


# Whole doubles without the point, as browsers and VARIANT print them.
_SHOWN_ITEM = lambda v: f"CASE WHEN json_type({v}) = 'DOUBLE' THEN regexp_replace(json_extract_string({v}, '$'), '\\.0$', '') ELSE json_extract_string({v}, '$') END"
_GPS_ITEMS = f"CASE WHEN json_type(g, '$.' || key) = 'ARRAY' THEN array_to_string(list_transform(CAST(json_extract(g, '$.' || key) AS JSON[]), lambda v: {_SHOWN_ITEM('v')}), ', ') ELSE {_SHOWN_ITEM("json_extract(g, '$.' || key)")} END"


@query(f"WITH {_EXIF}, k AS (SELECT id, json_extract(e, '$.GPS') AS g, unnest(json_keys(e, '$.GPS')) AS key FROM ex WHERE json_type(e, '$.GPS') = 'OBJECT') SELECT id, key, {_GPS_ITEMS} AS value FROM k")
def gps_fields(spark, d):
    """The second list of exif_fields: the fields of the GPS object."""
    rows = images(spark, d).select("id", F.try_variant_get(json_variant("exif"), "$.GPS", "variant").alias("v"))
    rows.filter(F.schema_of_variant("v").startswith("OBJECT")).createOrReplaceTempView("lumidex_gps_fields")
    fields = spark.sql("SELECT id, x.key, x.value AS item FROM lumidex_gps_fields, LATERAL variant_explode(v) x")
    many = F.array_join(F.transform(F.try_variant_get("item", "$", "array<variant>"), lambda x: F.try_variant_get(x, "$", "string")), ", ")
    return fields.select("id", "key", F.when(F.schema_of_variant("item").startswith("ARRAY"), many).otherwise(F.try_variant_get("item", "$", "string")).alias("value"))


@query("SELECT id, label, text FROM (SELECT id, unnest(['library', 'pixels', 'hash', 'thumbnail']) AS label, unnest([library, CASE WHEN width > 0 AND height > 0 THEN width || ' x ' || height END, dhash, CAST(thumb_length AS VARCHAR)]) AS text FROM images) WHERE text <> ''")
def fact_lists(spark, d):
    pixels = F.when((F.col("width") > 0) & (F.col("height") > 0), F.concat(F.col("width").cast("string"), F.lit(" x "), F.col("height").cast("string")))
    pairs = {"library": F.col("library"), "pixels": pixels, "hash": F.col("dhash"), "thumbnail": F.col("thumb_length")}
    return images(spark, d).select("id", F.explode(scalars.facts(pairs)).alias("f")).select("id", "f.label", "f.text")


_FIXED = "CASE WHEN v * 8 = floor(v * 8) THEN printf('%.2f', floor(v * 100 + 0.5) / 100) ELSE printf('%.2f', v) END"
_SCORES = "(VALUES ('aesthetic_score'), ('sharpness'), ('exposure_score'), ('watermark_score')) s(label)"


@query(f"""WITH i AS (SELECT id, CASE WHEN info <> '' AND json_valid(info) THEN CASE WHEN json_type(info) = 'VARCHAR' THEN json_extract_string(info, '$') ELSE info END END AS j FROM images),
v AS (SELECT id, label, CASE WHEN json_type(j, '$.' || label) IN ('DOUBLE', 'BIGINT', 'UBIGINT', 'INTEGER') THEN CAST(json_extract(j, '$.' || label) AS DOUBLE) END AS v FROM i, {_SCORES}) SELECT id, label, {_FIXED} AS text FROM v WHERE v IS NOT NULL""")
def score_facts(spark, d):
    return images(spark, d).select("id", F.explode(describe.scores(json_variant("info"))).alias("s")).select("id", "s.label", "s.text")


@query(f"WITH {_POINTS} SELECT id, round(lat, 9) AS lat, round(lon, 9) AS lon FROM pts")
def locations(spark, d):
    return located(spark, d).select("id", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


_EDGE = lambda v, size: f"CASE WHEN {v} < 0 THEN 0.0 WHEN {v} >= {size} THEN {size - 1}.0 ELSE {v} END"
_PIXELS = f"""CAST(round_even({_EDGE(f'(lon + 180.0) * {1600 / 360.0!r}', 1600)}, 0) AS INTEGER) AS x, CAST(round_even({_EDGE(f'(90.0 - lat) * {800 / 180.0!r}', 800)}, 0) AS INTEGER) AS y"""


@query(f"WITH {_POINTS} SELECT id, {_PIXELS} FROM pts")
def project_pixels(spark, d):
    x, y = mapview.project(F.col("lat"), F.col("lon"))
    return located(spark, d).select("id", x.alias("x"), y.alias("y"))


_WORLD = mapview.world_size(ZOOM)
_LEFT, _TOP = (VIEW[1] + 180.0) / 360.0 * _WORLD - SCREEN[0] / 2, (90.0 - VIEW[0]) / 180.0 * (_WORLD / 2) - SCREEN[1] / 2
_MARKS = f"""{_POINTS}, raw AS (SELECT id, (lon + 180.0) / 360.0 * {_WORLD} - ({_LEFT!r}) AS sx, (90.0 - lat) / 180.0 * {_WORLD / 2} - ({_TOP!r}) AS sy FROM pts),
turned AS (SELECT id, sx + greatest(ceil(({-_WORLD / 2} - sx) / {_WORLD}), 0) * {_WORLD} - greatest(ceil((sx - {1.5 * _WORLD}) / {_WORLD}), 0) * {_WORLD} AS sx, sy FROM raw),
marks AS (SELECT * FROM turned WHERE sx BETWEEN -28 AND {SCREEN[0] + 28} AND sy BETWEEN -28 AND {SCREEN[1] + 28})"""


def _marks(spark, d):
    return mapview.markers(located(spark, d), VIEW, ZOOM, SCREEN)


@query(f"WITH {_MARKS} SELECT id, round(sx, 6) AS sx, round(sy, 6) AS sy FROM marks")
def screen_markers(spark, d):
    return _marks(spark, d).select("id", F.round("sx", 6).alias("sx"), F.round("sy", 6).alias("sy"))


_GRID = "SELECT CAST(floor(sx / 28) AS BIGINT) AS bx, CAST(floor(sy / 28) AS BIGINT) AS \"by\", avg(sx) AS sx, avg(sy) AS sy, count(*) AS n, min(id) AS first_id FROM marks GROUP BY 1, 2"


@query(f"WITH {_MARKS}, grid AS ({_GRID}) SELECT bx, \"by\", round(sx, 6) AS sx, round(sy, 6) AS sy, n, first_id FROM grid")
def grid_clusters(spark, d):
    return mapview.grid_clusters(_marks(spark, d)).withColumn("sx", F.round("sx", 6)).withColumn("sy", F.round("sy", 6))


@query(f"WITH {_MARKS} SELECT CAST(floor(sx / 28) AS BIGINT) AS bx, CAST(floor(sy / 28) AS BIGINT) AS \"by\", m.id, i.name, i.library FROM marks m JOIN images i ON i.id = m.id")
def map_panel(spark, d):
    index = images(spark, d).select("id", "name", "library")
    return mapview.members(_marks(spark, d)).join(index, "id").select("bx", "by", "id", "name", "library")


@query(f"WITH {_MARKS}, grid AS ({_GRID}), r AS (SELECT *, CASE WHEN n = 1 THEN 7.0 ELSE least(22.0, 9 + 4 * ln(n)) END + 4 AS reach FROM grid) SELECT bx, \"by\", n FROM r WHERE (sx - 240.0) * (sx - 240.0) + (sy - 205.0) * (sy - 205.0) <= reach * reach ORDER BY first_id DESC LIMIT 1")
def hit_test(spark, d):
    return mapview.hit(mapview.grid_clusters(_marks(spark, d)), 240.0, 205.0, order="first_id").select("bx", "by", "n")


_NEAREST = "list_position(list_transform(w.state, lambda c: pow(c.sx * 1.0 / c.n - p.x, 2) + pow(c.sy * 1.0 / c.n - p.y, 2) <= 324), true)"


@query(f"""WITH RECURSIVE {_POINTS}, px AS MATERIALIZED (SELECT row_number() OVER (ORDER BY id) AS rn, {_PIXELS} FROM pts),
walk AS (SELECT 0::BIGINT AS rn, CAST([] AS STRUCT(sx BIGINT, sy BIGINT, n BIGINT)[]) AS state
  UNION ALL SELECT rn, CASE WHEN coalesce(k, 0) = 0 THEN list_append(state, struct_pack(sx := x, sy := y, n := 1::BIGINT))
    ELSE list_concat(list_append(state[1:k - 1], struct_pack(sx := state[k].sx + x, sy := state[k].sy + y, n := state[k].n + 1)), state[k + 1:]) END
  FROM (SELECT p.rn, w.state, p.x::BIGINT AS x, p.y::BIGINT AS y, {_NEAREST} AS k FROM walk w JOIN px p ON p.rn = w.rn + 1)),
f AS (SELECT unnest(state) AS c, generate_subscripts(state, 1) - 1 AS pin FROM walk WHERE rn = (SELECT max(rn) FROM walk))
SELECT CAST(pin AS INTEGER) AS pin, CAST(c.sx // c.n AS INTEGER) AS x, CAST(c.sy // c.n AS INTEGER) AS y, c.n AS n, CAST(CASE WHEN c.n = 1 THEN 7 ELSE least(20, 7 + 3 * length(c.n::VARCHAR)) END AS INTEGER) AS radius FROM f""")
def greedy_pins(spark, d):
    pins = mapview.greedy_pins(located(spark, d))
    return pins.withColumn("radius", mapview.pin_radius(F.col("n")))


@query("SELECT place_id, round(x, 6) AS x, round(y, 6) AS y, round(90.0 - y * 180.0 / 1024.0, 9) AS lat, round(x * 360.0 / 2048.0 - 180.0, 9) AS lon FROM (SELECT place_id, (lon + 180.0) / 360.0 * 2048.0 AS x, (90.0 - lat) / 180.0 * 1024.0 AS y FROM places WHERE kind = 'circle')")
def world_coordinates(spark, d):
    x, y = mapview.to_world(F.col("lat"), F.col("lon"), 2)
    there = table(spark, d, "places").filter("kind = 'circle'").select("place_id", x.alias("x"), y.alias("y"))
    lat, lon = mapview.from_world(F.col("x"), F.col("y"), 2)
    return there.select("place_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round(lat, 9).alias("lat"), F.round(lon, 9).alias("lon"))


@query("SELECT place_id, round(90.0 - greatest(250.0, least(1024.0 - 250.0, (90.0 - lat) / 180.0 * 1024.0)) * 180.0 / 1024.0, 9) AS lat, round((lon + 540.0) % 360.0 - 180.0, 9) AS lon FROM places WHERE kind = 'circle'")
def view_centres(spark, d):
    lat, lon = mapview.clamp_centre(F.col("lat"), F.col("lon"), 2, 500.0)
    return table(spark, d, "places").filter("kind = 'circle'").select("place_id", F.round(lat, 9).alias("lat"), F.round(lon, 9).alias("lon"))


@query("WITH w AS (SELECT place_id, (lon + 180.0) / 360.0 * 2048.0 AS x, (90.0 - lat) / 180.0 * 1024.0 AS y FROM places WHERE kind = 'circle') SELECT place_id, round(90.0 - greatest(250.0, least(1024.0 - 250.0, y + 30.0)) * 180.0 / 1024.0, 9) AS pan_lat, round(((x - 120.0) * 360.0 / 2048.0 - 180.0 + 540.0) % 360.0 - 180.0, 9) AS pan_lon, round((x + 100.0) * 2.0 - 100.0, 6) AS zoom_x, round((y - 50.0) * 2.0 + 50.0, 6) AS zoom_y, round(90.0 - (y - 50.0) * 180.0 / 1024.0, 9) AS lat, round(((x + 100.0) * 360.0 / 2048.0 - 180.0 + 540.0) % 360.0 - 180.0, 9) AS lon FROM w")
def view_moves(spark, d):
    """Each place as a view's centre: dragged by (120, -30), zoomed in about the point (100, -50) off it, and the position under that point."""
    there = table(spark, d, "places").filter("kind = 'circle'")
    lat, lon = F.col("lat"), F.col("lon")
    pan = mapview.panned(lat, lon, F.lit(120.0), F.lit(-30.0), 2, 500.0)
    zoom = mapview.zoomed(F.lit(100.0), F.lit(-50.0), *mapview.to_world(lat, lon, 2), 2, 3)
    under = mapview.screen_to_position(F.lit(500.0), F.lit(200.0), lat, lon, 2, (800.0, 500.0))
    named = zip(("pan_lat", "pan_lon", "zoom_x", "zoom_y", "lat", "lon"), (*pan, *zoom, *under), (9, 9, 6, 6, 9, 9))
    return there.select("place_id", *[F.round(c, k).alias(n) for n, c, k in named])


@query("SELECT z, x, y, CAST(round_even(x * 21600.0 / c, 0) AS INTEGER) AS x0, CAST(round_even(y * 10800.0 / r, 0) AS INTEGER) AS y0, CAST(round_even((x + 1) * 21600.0 / c, 0) AS INTEGER) AS x1, CAST(round_even((y + 1) * 10800.0 / r, 0) AS INTEGER) AS y1 FROM (SELECT CAST(z AS INTEGER) AS z, CAST(pow(2, z + 1) AS INTEGER) AS c, CAST(pow(2, z) AS INTEGER) AS r, CAST(unnest(range(0, CAST(pow(2, z + 1) AS BIGINT))) AS INTEGER) AS x FROM range(0, 7) t(z)) s, LATERAL (SELECT CAST(unnest(range(0, r)) AS INTEGER) AS y)")
def tile_boxes(spark, d):
    return mapview.tile_boxes(spark, 6, 21_600, 10_800)


@query("WITH v AS (SELECT place_id AS view_id, 4096.0 * (lon + 180.0) / 360.0 - 400.0 AS l, 2048.0 * (90.0 - lat) / 180.0 - 300.0 AS t FROM places WHERE kind = 'circle'), c AS (SELECT view_id, unnest(range(CAST(floor(l / 256) AS BIGINT), CAST(floor((l + 800) / 256) AS BIGINT) + 1)) AS tx, t FROM v) SELECT view_id, tx, ((tx % 16) + 16) % 16 AS x, unnest(range(greatest(0, CAST(floor(t / 256) AS BIGINT)), least(7, CAST(floor((t + 600) / 256) AS BIGINT)) + 1)) AS y FROM c")
def visible_tiles(spark, d):
    views = table(spark, d, "places").filter("kind = 'circle'").select(F.col("place_id").alias("view_id"), "lat", "lon", F.lit(3).alias("z"), F.lit(800).alias("w"), F.lit(600).alias("h"))
    return mapview.visible_tiles(views)


@query("SELECT id, regexp_extract('Here it is: ' || info || ' } - done', '(\\{.*\\})', 1, 's') AS span FROM images")
def extract_json_span(spark, d):
    reply = F.concat(F.lit("Here it is: "), F.col("info"), F.lit(" } - done"))
    return images(spark, d).select("id", describe.json_span(reply).alias("span"))


@query()
def parse_reply(spark, d):
    return describe.parse_replies(images(spark, d).filter(F.col("info") != ""), text="info").select("id", F.to_json("info").alias("info"), "error")


_NUMBERS = "('DOUBLE', 'BIGINT', 'UBIGINT', 'INTEGER')"
_N = lambda f: f"CASE json_type(j, '$.{f}') WHEN 'ARRAY' THEN len(list_filter(CAST(json_extract(j, '$.{f}') AS JSON[]), lambda v: v IS NULL OR json_type(v) <> 'VARCHAR' OR trim(json_extract_string(v, '$')) <> '')) WHEN 'VARCHAR' THEN CASE WHEN trim(json_extract_string(j, '$.{f}')) <> '' THEN 1 ELSE 0 END ELSE 0 END AS n_{f}"


@query(f"""WITH s AS (SELECT id, regexp_extract(info, '(\\{{.*\\}})', 1, 's') AS span FROM images WHERE info <> ''), i AS (SELECT id, CASE WHEN json_valid(span) THEN span END AS j FROM s),
o AS (SELECT *, coalesce(json_type(j, '$.description') = 'VARCHAR' AND trim(json_extract_string(j, '$.description')) <> '' AND {' AND '.join(f"json_type(j, '$.{f}') IN {_NUMBERS}" for f in describe.SCORES)}, false) AS ok FROM i),
f AS (SELECT id, ok, trim(json_extract_string(j, '$.description')) AS description, CASE WHEN json_type(j, '$.text') = 'VARCHAR' THEN trim(json_extract_string(j, '$.text')) ELSE '' END AS text, {', '.join(map(_N, describe.LISTS))}, CASE WHEN ok THEN round(greatest(0.0, least(1.0, CAST(json_extract(j, '$.sharpness') AS DOUBLE))), 9) END AS sharpness FROM o)
SELECT id, ok, CASE WHEN ok THEN description END AS description, CASE WHEN ok THEN text END AS text, {', '.join(f"CASE WHEN ok THEN n_{f} END AS n_{f}" for f in describe.LISTS)}, sharpness FROM f""")
def parse_reply_fields(spark, d):
    """What parse_reply makes of each description taken as a reply, field by field."""
    parsed = describe.parse_replies(images(spark, d).filter(F.col("info") != ""), text="info")
    known = F.col("info").isNotNull()
    lists = [F.when(known, F.size(f"info.{f}").cast("bigint")).alias(f"n_{f}") for f in describe.LISTS]
    return parsed.select("id", F.col("error").isNull().alias("ok"), "info.description", "info.text", *lists, F.round("info.sharpness", 9).alias("sharpness"))


def _answer(end, prompt, i, library, path):
    """A stand-in for a model server: it describes a picture by its path."""
    import json

    return "Sure: " + json.dumps({"description": f"{library}: {path}", "subjects": [], "text": "", "tags": path.split("/"), "colors": [], **dict.fromkeys(describe.SCORES, 0.5)})


@query("SELECT id, library || ': ' || path AS description, lower(name || ' ' || path || ' ' || library || ': ' || path || '  ' || array_to_string(string_split(path, '/'), ' ')) AS search_text, 1 AS described, 4 AS prompt_ver FROM images WHERE described = 0 OR (described = 1 AND prompt_ver < 4)")
def describe_pending(spark, d):
    queue = progress.pending(images(spark, d))
    results = persisted(describe.describe(queue, _answer, [describe.Endpoint(model="stand-in")] * 4), "described")
    new = describe.store(images(spark, d), results).join(results.select("id"), "id", "left_semi")
    return new.select("id", F.get_json_object("info", "$.description").alias("description"), "search_text", "described", "prompt_ver")
