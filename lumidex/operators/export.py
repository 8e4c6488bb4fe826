"""Export: records, digests, next-fit packing and the incremental shard plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumidex.common import persisted
from lumidex.functions.scalars import export_extension
from lumidex.schema import SHARD_LIMIT
from lumidex.sources import files

#: The fields of a detail record; export adds the search text, hash, thumbnail and image path.
DETAIL = ["id", "library", "path", "name", "size", "mtime", "width", "height", "described"]


def detail(images: DataFrame) -> DataFrame:
    """Detail records: a blank info is null, a blank exif an empty object."""
    return images.select(*DETAIL, F.nullif("info", F.lit("")).alias("info"), F.coalesce(F.nullif("exif", F.lit("")), F.lit("{}")).alias("exif"))


def export_records(images: DataFrame, thumbs: DataFrame | None = None) -> DataFrame:
    """Detail records with text, dhash, image path and, where thumbs (id, jpeg) has one, the thumbnail as a data address."""
    rows = detail(images).join(images.select(F.col("id").alias("_id"), F.col("search_text").alias("text"), "dhash"), F.col("id") == F.col("_id")).drop("_id")
    rows = rows.withColumn("image", original_file())
    if thumbs is None:
        return rows.withColumn("thumb", F.lit("").cast("string"))
    encoded = F.concat(F.lit("data:image/jpeg;base64,"), F.regexp_replace(F.base64("jpeg"), r"[\r\n]", ""))
    return rows.join(thumbs.select(F.col("id").alias("_id"), encoded.alias("thumb")), F.col("id") == F.col("_id"), "left").drop("_id")


def digest(record: Column) -> Column:
    """SHA-1 of a record as JSON in the order of its fields."""
    return F.sha1(F.to_json(record))


def digests(records: DataFrame) -> DataFrame:
    """(id, digest, size): size is the length of the record's JSON plus two."""
    text = F.to_json(F.struct(*records.columns))
    return records.select("id", F.sha1(text).alias("digest"), (F.length(text) + 2).cast("bigint").alias("size"))


def _starts(totals: np.ndarray, first: int, limit: int) -> list[int]:
    """Places where shards open, from `first` on, by running totals (one more than items)."""
    out, n = [], len(totals) - 1
    while first < n:
        out.append(first)
        first = max(int(np.searchsorted(totals, totals[first] + limit, "right")) - 1, first + 1)
    return out


def _first(totals: np.ndarray, used: int, empty: bool, limit: int) -> int:
    """Where the first shard opens when the one before holds `used` bytes; the number of items if it takes them all."""
    return max(int(np.searchsorted(totals, limit - used, "right")) - 1, 1 if empty else 0)


def _outcomes(totals: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every place the first shard of these items may open at: the running total after its item, the shards opened, and the bytes in the last."""
    n = len(totals) - 1
    after = np.maximum(np.searchsorted(totals, totals[:-1] + limit, "right") - 1, np.arange(1, n + 1))
    opened, left = np.ones(n, np.int64), totals[n] - totals[:-1]
    for k in np.flatnonzero(after < n)[::-1]:
        opened[k], left[k] = opened[after[k]] + 1, left[after[k]]
    can = min(n, max(_first(totals, 0, False, limit), 1) + 1)
    return totals[1 : can + 1], opened[:can], left[:can]


def next_fit(items: DataFrame, limit: int = SHARD_LIMIT, shard: int = 0, used: int = 0, empty: bool = True) -> DataFrame:
    """(id, size, shard, offset): items in the order of id appended to the last shard; a new one opens when a shard that holds something would pass the limit.

    Exactly the limit fits; an item larger than it is alone. The first shard is `shard`
    with `used` bytes; empty says that it holds nothing. Null and negative sizes count as 0.

    Ranges of ids are packed in parallel: each range first tells, for every place its
    first shard may open at, how many shards it opens and how full the last is. The driver
    reads these range by range and keeps one state per range; then each range is packed
    from its state. With one range the first step falls away.
    """
    size = F.greatest(F.coalesce(F.col("size").cast("bigint"), F.lit(0)), F.lit(0))
    rows = items.select(F.col("id").cast("bigint").alias("id"), size.alias("size"))
    parts = persisted(rows.repartitionByRange("id").withColumn("part", F.spark_partition_id()), "ranges")
    numbers = sorted(r["part"] for r in parts.select("part").distinct().collect())
    states = {}
    if len(numbers) > 1:

        def tell(own: pa.Table) -> pa.Table:
            every = _totals(_sorted(own))
            totals, opened, left = _outcomes(every, limit)
            return pa.table({"part": own["part"][:1], "n": [own.num_rows], "whole": [int(every[-1])], "totals": [totals.tobytes()], "opened": [opened.tobytes()], "left": [left.tobytes()]})

        told = persisted(parts.groupBy("part").applyInArrow(tell, "part int, n bigint, whole bigint, totals binary, opened binary, left binary"), "outcomes")
        for r in told.orderBy("part").toLocalIterator():
            states[r["part"]] = (shard, used, empty)
            totals, opened, left = (np.frombuffer(r[c], np.int64) for c in ("totals", "opened", "left"))
            k = _first(np.r_[0, totals], used, empty, limit)
            if k >= r["n"]:
                used += r["whole"]
            elif k < len(opened):
                shard, used = shard + int(opened[k]), int(left[k])
            empty = False
    elif numbers:
        states[numbers[0]] = (shard, used, empty)
    shared = items.sparkSession.sparkContext.broadcast(states)

    def pack(own: pa.Table) -> pa.Table:
        own = _sorted(own)
        totals = _totals(own)
        number, before, nothing = shared.value[own["part"][0].as_py()]
        starts = np.array(_starts(totals, _first(totals, before, nothing, limit), limit), int)
        opens = np.zeros(own.num_rows, np.int64)
        opens[starts] = 1
        opened = np.cumsum(opens)
        base = np.r_[-before, totals[starts]][opened]
        return pa.table({"id": own["id"], "size": own["size"], "shard": number + opened, "offset": totals[:-1] - base})

    return parts.groupBy("part").applyInArrow(pack, "id bigint, size bigint, shard bigint, offset bigint")


def _sorted(own: pa.Table) -> pa.Table:
    return own.take(pc.sort_indices(own, sort_keys=[("id", "ascending"), ("size", "ascending")], null_placement="at_start"))


def _totals(own: pa.Table) -> np.ndarray:
    """Running totals of the sizes, from 0."""
    return np.r_[0, np.cumsum(own["size"].to_numpy(), dtype=np.int64)]


def plan(current: DataFrame, previous: DataFrame, limit: int = SHARD_LIMIT) -> DataFrame:
    """(shard, id, digest, dirty): where each current record (id, digest, size) goes, after a previous plan (shard, pos, id, digest).

    Records stay in their shard with their new digest; shards that lost or changed a
    record, or take new ones, are dirty. New records follow by next-fit after the last
    shard. Old shards are never split. A shard left empty has one row with a null id.
    """
    prev = previous.select(F.col("shard").cast("bigint").alias("shard"), "id", F.col("digest").alias("old")).alias("p")
    cur = current.select("id", "digest", "size").alias("c")
    both = prev.join(cur, F.col("p.id") == F.col("c.id"), "left").select("shard", F.col("c.id").alias("id"), F.col("c.digest").alias("digest"), "size", (F.col("c.id").isNull() | (F.col("digest") != F.col("old"))).alias("touched"))
    shards = both.groupBy("shard").agg(F.max(F.coalesce("touched", F.lit(True))).alias("touched"), F.coalesce(F.sum("size"), F.lit(0)).alias("used"), F.count("id").alias("n"))
    last = shards.orderBy(F.desc("shard")).limit(1).collect()
    state = (int(last[0]["shard"]), int(last[0]["used"]), last[0]["n"] == 0) if last else (0, 0, True)
    leftovers = cur.join(prev.select("id"), "id", "left_anti")
    added = next_fit(leftovers, limit, *state).select("shard", "id").join(current.select("id", "digest"), "id")
    rows = both.filter(F.col("id").isNotNull()).select("shard", "id", "digest").unionByName(added.select("shard", "id", "digest"))
    grown = added.select("shard").distinct().withColumn("grown", F.lit(True))
    every = shards.select("shard", "touched").join(grown, "shard", "full_outer").select("shard", (F.coalesce("touched", F.lit(False)) | F.coalesce("grown", F.lit(False))).alias("dirty"))
    return every.join(rows, "shard", "left").select("shard", "id", "digest", "dirty")


def orphans(existing: DataFrame, planned: DataFrame) -> DataFrame:
    """(file) of exported files that the plan no longer has."""
    return existing.join(planned, "file", "left_anti")


def shard_file(shard: Column) -> Column:
    return F.format_string("data-%04d.json", shard.cast("bigint"))


def original_file() -> Column:
    """Where the original of a row lies in a site."""
    return F.concat(F.lit("images/"), F.col("id").cast("string"), F.lit("."), export_extension(F.col("name")))


def manifest(images: DataFrame, planned: DataFrame, generated: int, libraries: list[str] | None = None) -> DataFrame:
    """One row (libraries, shards, count, generated): the configured libraries, or those of the rows by name, and shard files by number."""
    named = F.array_sort(F.collect_set("library")) if libraries is None else F.lit(libraries).cast("array<string>")
    rows = images.agg(named.alias("libraries"), F.count("*").alias("count"))
    files = planned.select("shard").distinct().agg(F.transform(F.array_sort(F.collect_set("shard")), shard_file).alias("shards"))
    return rows.join(files).select("libraries", "shards", "count", F.lit(generated).cast("bigint").alias("generated"))


def positions_in(planned: DataFrame) -> DataFrame:
    """(shard, pos, id, digest) of a plan, for the next one; shards left empty are not in it."""
    place = F.row_number().over(Window.partitionBy("shard").orderBy("id")) - 1
    return planned.filter(F.col("id").isNotNull()).select(F.col("shard").cast("bigint").alias("shard"), place.alias("pos"), "id", "digest")


def write_shards(records: DataFrame, planned: DataFrame, output: str) -> int:
    """Write the dirty shards, and those whose file is missing, as `output`/data/data-NNNN.json; returns how many.

    A file is a JSON array in one line, in the order of id. A shard's records, SHARD_LIMIT
    characters or one larger, are laid end to end by one task.
    """

    def absent(frames: Iterator[pd.DataFrame]):
        for f in frames:
            yield f[[not files.exists(f"{output}/data/{n}") for n in f["file"]]]

    rows = planned.select("id", "dirty", shard_file(F.col("shard")).alias("file"))
    missing = rows.filter(~F.col("dirty")).select("file").distinct().mapInPandas(absent, "file string")
    due = rows.filter("dirty").unionByName(rows.filter(~F.col("dirty")).join(missing, "file", "left_semi"))
    cells = due.join(records.select("id", F.to_json(F.struct(*records.columns)).alias("text")), "id", "left").select("file", "id", "text")

    def write(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        held = own[own["text"].notna()].sort_values("id")["text"]
        files.write(f"{output}/data/{key[0]}", ("[" + ",".join(held) + "]").encode())
        return pd.DataFrame({"file": [key[0]], "n": [len(held)]})

    return persisted(cells.groupBy("file").applyInPandas(write, "file string, n bigint"), "written").count()


def delete_files(names: DataFrame, output: str) -> int:
    """Delete the files (file) under `output`, on the executors; returns how many."""

    def kernel(frames: Iterator[pd.DataFrame]):
        for f in frames:
            for name in f["file"]:
                files.delete(f"{output}/{name}")
            yield f

    return names.select("file").mapInPandas(kernel, "file string").count()


def write_site(records: DataFrame, planned: DataFrame, output: str) -> None:
    """Write the shards that are due, and the state of the plan beside them."""
    write_shards(records, planned, output)
    positions_in(planned).write.mode("overwrite").parquet(f"{output}/state-next")


def copy_originals(images: DataFrame, roots: dict[str, str], output: str, convert: Callable[[bytes], bytes] | None = None, load: Callable[[str], bytes | None] | None = None) -> DataFrame:
    """(id, file, status) after copying each original into `output`/images, on the executors: copied, kept, missing or failed.

    A copy as new as its source is kept. load may give the bytes, as for pictures.contents.
    HEIC goes through convert (bytes to JPEG bytes); without one it fails. Folders may be of
    any file system that sources.files reaches; output is one all executors share.
    """

    def one(library: str, path: str, file: str) -> str:
        source, target = f"{roots.get(library, '').rstrip('/')}/{path}", f"{output}/{file}"
        try:
            content = load(source) if load and library in roots else None
            written = files.modified(source) if library in roots else None
            if content is None and written is None:
                return "missing"
            if content is None and (files.modified(target) or 0.0) >= written:
                return "kept"
            content = files.read(source) if content is None else content
            files.write(target, convert(content) if path.lower().endswith(".heic") else content)
        except Exception:  # noqa: BLE001 - one bad file must not end the export
            return "failed"
        return "copied"

    def kernel(frames: Iterator[pd.DataFrame]):
        for f in frames:
            yield f[["id", "file"]].assign(status=[one(*r) for r in f[["library", "path", "file"]].itertuples(index=False)])

    return images.select("id", "library", "path", original_file().alias("file")).mapInPandas(kernel, "id bigint, file string, status string")
