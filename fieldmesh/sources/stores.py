"""Stores of results: match blocks by owner, feature tables, cell rasters, result sets, project chunks, journals.

Every store is Parquet or text under a folder; a writer adds a generation or renames a finished file into place, so a
reader never meets half a result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHARDS = 64
PAIR = ["owner", "peer", "algorithm", "config"]


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path in its terms."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def newest(spark: SparkSession, path: str) -> int:
    """Number of the newest complete generation under path; -1 where there is none."""
    fs, p = _files(spark, path)
    found = [s.getPath() for s in fs.listStatus(p)] if fs.exists(p) else []
    done = [x for x in found if x.getName().startswith("generation-") and fs.exists(_files(spark, f"{x}/_SUCCESS")[1])]
    return max((int(x.getName().split("-")[1]) for x in done), default=-1)


# matches ----------------------------------------------------------------------------------------------------------


def shard_of(owner: Column) -> Column:
    return F.pmod(F.xxhash64(owner), F.lit(SHARDS)).cast("int")


def mirrored(pairs: DataFrame, sides: list[tuple[str, str]] = ()) -> DataFrame:
    """Pairs (a, b, ...) as blocks (owner, peer, ...) of either image; each two columns of sides change places."""
    other = dict(sides) | {y: x for x, y in sides}
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    there = pairs.select(F.col("a").alias("owner"), F.col("b").alias("peer"), *rest)
    back = pairs.select(F.col("b").alias("owner"), F.col("a").alias("peer"), *[F.col(other.get(c, c)).alias(c) for c in rest])
    return there.unionByName(back)


def write_pairs(pairs: DataFrame, path: str, sides: list[tuple[str, str]] = (), keep: bool = True) -> int:
    """Stores pairs (a, b, algorithm, config, ...; a key comes once) with both images; the number of the generation.

    A stored block of the same key is replaced. Other variants of an image are kept, or go with keep=False; images
    that are not named keep theirs.
    """
    spark = pairs.sparkSession
    new = mirrored(pairs, sides).withColumn("shard", shard_of(F.col("owner")))
    last = newest(spark, path)
    if last >= 0:
        gone = new.select(*(PAIR if keep else ["owner"])).distinct()
        new = new.unionByName(spark.read.parquet(f"{path}/generation-{last}").join(gone, gone.columns, "left_anti"))
    # one image may hold a third of all blocks: a rebalance splits its shard over several tasks
    new.hint("rebalance", "shard").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/generation-{last + 1}")
    return last + 1


def blocks(spark: SparkSession, path: str, owner: str | None = None) -> DataFrame:
    """Blocks of the store, or of one image (its shard alone is read)."""
    df = spark.read.parquet(f"{path}/generation-{newest(spark, path)}")
    return (df if owner is None else df.where((F.col("shard") == shard_of(F.lit(owner))) & (F.col("owner") == owner))).drop("shard")


# features ---------------------------------------------------------------------------------------------------------


def cached_features(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """wanted (image, signature) with the cached payload's columns, hit, and why not: absent, or signature of another producer."""
    have = cache.withColumnRenamed("signature", "cached")
    hit = F.col("cached") == F.col("signature")
    payload = [F.when(hit, F.col(c)).alias(c) for c in have.columns if c not in ("image", "cached")]
    reason = F.when(F.col("cached").isNull(), "absent").when(~hit, "signature")
    return wanted.join(have, "image", "left").select("image", *payload, F.coalesce(hit, F.lit(False)).alias("hit"), reason.alias("reason"))


def image_size(content: Column) -> Column:
    """struct of format, width, height read from the first bytes of a PNG, BMP or GIF file; null where it is none of them."""
    head = F.hex(F.substring(content, 1, 32))

    def number(first: int, n: int, little: bool) -> Column:
        """n bytes from the byte at first (from 0)."""
        at = [F.substring(head, 2 * (first + k) + 1, 2) for k in range(n)]
        return F.conv(F.concat(*(reversed(at) if little else at)), 16, 10).cast("long")

    png = F.startswith(head, F.lit("89504E470D0A1A0A")) & (F.substring(head, 25, 8) == "49484452") & (F.length(head) >= 48)
    bmp = F.startswith(head, F.lit("424D")) & (F.length(head) >= 52)
    gif = F.rlike(head, F.lit("^47494638(37|39)61")) & (F.length(head) >= 20)
    shape = lambda name, w, h: F.struct(F.lit(name).alias("format"), w.alias("width"), h.alias("height"))
    return F.when(png, shape("png", number(16, 4, False), number(20, 4, False))).when(bmp, shape("bmp", number(18, 4, True), number(22, 4, True))).when(gif, shape("gif", number(6, 2, True), number(8, 2, True)))


# rasters ----------------------------------------------------------------------------------------------------------


def write_cells(cells: DataFrame, path: str, bands: list[str], size: int = 512, nodata: float = -9999.0) -> None:
    """Cells (r, c, bands) as a raster of tiles, one column for each band; cells without a value hold nodata."""
    filled = [F.when(F.col(b).isNull() | F.isnan(b), nodata).otherwise(F.col(b)).cast("double").alias(b) for b in bands]
    tile = F.floor(F.col("r") / size).alias("tile_r"), F.floor(F.col("c") / size).alias("tile_c")
    cells.select("r", "c", *filled, *tile).repartition("tile_r", "tile_c").sortWithinPartitions("tile_r", "tile_c", "r", "c").write.mode("overwrite").parquet(path)


def read_cells(spark: SparkSession, path: str, bands: list[str], nodata: float = -9999.0) -> DataFrame:
    """r, c and the bands asked for (no other is read), null where there is no data, with valid for the first."""
    value = [F.when((F.col(b) != nodata) & ~F.isnan(b), F.col(b)).alias(b) for b in bands]
    return spark.read.parquet(path).select("r", "c", *value).withColumn("valid", F.col(bands[0]).isNotNull())


# result sets ------------------------------------------------------------------------------------------------------


def save_atomic(spark: SparkSession, path: str, text: str) -> None:
    """A small text written beside path and renamed into its place."""
    fs, target = _files(spark, path)
    _, part = _files(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(part, target):  # file systems that do not replace
        fs.delete(target, False)
        if not fs.rename(part, target):
            raise OSError(f"cannot replace {path}")


def content(df: DataFrame) -> DataFrame:
    """rows, hash of a table whatever its order."""
    row = F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(row), F.lit(0)).cast("string").alias("hash"))


def write_result(tables: dict[str, DataFrame], path: str) -> None:
    """Tables under path and, last, a sidecar of their rows and hashes: without it there is no result."""
    some = next(iter(tables.values())).sparkSession
    lines = []
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        lines.append(content(some.read.parquet(f"{path}/{name}")).select(F.to_json(F.struct(F.lit(name).alias("name"), "rows", "hash"))).first()[0])
    save_atomic(some, f"{path}/result.json", "\n".join(lines))


def checked_result(spark: SparkSession, path: str) -> DataFrame:
    """name, rows, intact of each table that the sidecar of a result names; there is a row for each table of a result."""
    told = spark.read.schema("name string, rows long, hash string").json(f"{path}/result.json").collect()
    found = None
    for t in told:
        now = content(spark.read.parquet(f"{path}/{t['name']}"))
        row = now.select(F.lit(t["name"]).alias("name"), "rows", ((F.col("rows") == t["rows"]) & (F.col("hash") == t["hash"])).alias("intact"))
        found = row if found is None else found.union(row)
    return found


def stage_fingerprints(snapshots: DataFrame) -> DataFrame:
    """stage, fingerprint: SHA-256 of each stage's snapshot (all columns but stage, as JSON)."""
    return snapshots.select("stage", F.sha2(F.to_json(F.struct(*[c for c in snapshots.columns if c != "stage"])), 256).alias("fingerprint"))


def compared_stages(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """stage, result (same, differs, missing, new) of two tables of fingerprints."""
    a, b = baseline.select("stage", F.col("fingerprint").alias("_a")), candidate.select("stage", F.col("fingerprint").alias("_b"))
    return a.join(b, "stage", "full").select("stage", F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "new").when(F.col("_a") == F.col("_b"), "same").otherwise("differs").alias("result"))


# manifests and marker sets ----------------------------------------------------------------------------------------

# Paths of a terrain product, the first that is set being its primary path; names no longer allowed.
PATHS = ["dem_path", "dom_path", "error_path", "coverage_path", "source_path"]
OLD = ["dem_tif", "dom_png", "depth_png", "depth_preview_png"]


def terrain_products(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """product_id, product_type, primary_path, grid_resolution of manifests of a schema, by primary path.

    A manifest of another schema, or with a product under an old name, is refused as a whole (an error on use).
    """
    fields = ", ".join(f"{c}:string" for c in ["product_id", "product_type", *PATHS, *OLD])
    raw = spark.read.schema(f"schema string, products array<struct<{fields}, grid_resolution:double>>").json(path, multiLine=True)
    old = F.exists("products", lambda p: F.greatest(*[p[c].isNotNull() for c in OLD]))
    bad = ~F.coalesce(F.col("schema") == schema, F.lit(False)) | F.col("products").isNull() | F.coalesce(old, F.lit(False))
    good = raw.select(F.when(bad, F.raise_error(F.lit("no valid terrain manifest")).cast(raw.schema["products"].dataType)).otherwise(F.col("products")).alias("p"))
    first = F.coalesce(*[F.when(F.trim(c) != "", F.col(c)) for c in PATHS], F.lit(""))
    return good.select(F.inline("p")).select("product_id", "product_type", first.alias("primary_path"), F.coalesce("grid_resolution", F.lit(0.0)).alias("grid_resolution")).orderBy("primary_path")


# Names of roles and of projection states in a marker set.
MARKER_ROLES = ["tie_marker", "control_point", "check_point"]
PROJECTION_STATES = ["manual_pinned", "auto_detected", "predicted", "blocked", "disabled"]
MARKER = "struct<id:string, role:string, enabled:boolean, projections:array<struct<image_id:string, x:double, y:double, state:string>>>"


def encoded_markers(markers: DataFrame) -> DataFrame:
    """One JSON text (column json) for each marker (id, role, enabled, projections); numbers that are not finite are null."""
    finite = lambda x: F.when(F.abs(x) < float("inf"), x)
    seen = F.transform("projections", lambda p: F.struct(p["image_id"].alias("image_id"), finite(p["x"]).alias("x"), finite(p["y"]).alias("y"), p["state"].alias("state")))
    return markers.select(F.to_json(F.struct("id", "role", "enabled", seen.alias("projections")), {"ignoreNullFields": "false"}).alias("json"))


def decoded_markers(texts: DataFrame) -> DataFrame:
    """Markers of texts (column json), with error where a role or state is none of the known ones."""
    m = texts.select(F.from_json("json", MARKER).alias("m")).select("m.*")
    state = F.exists("projections", lambda p: ~F.coalesce(p["state"].isin(PROJECTION_STATES), F.lit(False)))
    error = F.when(F.coalesce(F.trim("id"), F.lit("")) == "", "id").when(~F.coalesce(F.col("role").isin(MARKER_ROLES), F.lit(False)), "role").when(F.coalesce(state, F.lit(False)), "state")
    return m.withColumn("error", error)


def sparse_quality(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z, track_length, rms, angle, complete of points in JSON documents; observations are not read."""
    fields = "point_xyz:array<double>, track_len:double, rms_reproj_px:double, triangulation_angle_deg:double, min_tri_angle_deg:double"
    p = spark.read.schema(f"points array<struct<{fields}>>").json(path, multiLine=True).select(F.inline("points"))
    angle = F.coalesce("triangulation_angle_deg", "min_tri_angle_deg")
    known = F.col("track_len").isNotNull() & F.col("rms_reproj_px").isNotNull() & angle.isNotNull()
    at = [F.get("point_xyz", F.lit(k)).alias(a) for k, a in enumerate("xyz")]
    return p.where("size(point_xyz) >= 3").select(*at, F.col("track_len").cast("long").alias("track_length"), F.col("rms_reproj_px").alias("rms"), angle.alias("angle"), known.alias("complete"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, no (from 1), value of every line of text files. Large files are read in blocks; a block's lines are counted, and the blocks of a
    file follow each other, so no task holds a file. The lines are written once, so that all see the same blocks."""
    from fieldmesh.operators.graph import settled

    read = spark.read.text(path, lineSep="\n").select("_metadata.file_path", "_metadata.file_block_start", F.regexp_replace("value", r"\r$", "").alias("value")).toDF("file", "block", "value")
    lines = settled(read.withColumn("at", F.monotonically_increasing_id()))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first")).select("file", "block", "first", ahead.alias("ahead"))
    return lines.join(F.broadcast(blocks), ["file", "block"]).select("file", (F.col("ahead") + F.col("at") - F.col("first") + 1).alias("no"), "value")


def plane_samples(spark: SparkSession, path: str, names: tuple[str, ...] = ("x", "y", "z", "nx", "ny", "nz")) -> DataFrame:
    """x, y, z, nx, ny, nz (of length one) of an ASCII PLY file; samples without a normal go. Columns are found by their names."""
    lines = numbered_lines(spark, path)
    # a file's header is small, its body is not
    ends = lines.where("value = 'end_header'").groupBy("file").agg(F.min("no").alias("end"))
    head = lines.join(F.broadcast(ends), "file").where("no <= end").groupBy("file", "end").agg(F.transform(F.array_sort(F.collect_list(F.struct("no", "value"))), lambda x: x["value"]).alias("a"))
    told = F.filter("a", lambda x: F.startswith(x, F.lit("property ")))
    named = F.transform(told, lambda x: F.element_at(F.split(F.trim(x), r"\s+"), -1))
    count = F.regexp_extract(F.array_join("a", "\n"), r"element vertex (\d+)", 1).cast("int")
    rows = lines.join(F.broadcast(head.select("file", "end", named.alias("named"), count.alias("count"))), "file").where("no > end AND no <= end + count").withColumn("p", F.split(F.trim("value"), r"\s+"))
    got = rows.select(*[F.get("p", (F.array_position("named", n) - 1).cast("int")).try_cast("double").alias(n) for n in names])
    long = F.sqrt(sum((F.col(n) * F.col(n) for n in names[4:]), F.col(names[3]) * F.col(names[3])))
    return got.withColumn("_l", long).where("x is not null and y is not null and z is not null and _l > 1e-12").select(*names[:3], *[(F.col(n) / F.col("_l")).alias(n) for n in names[3:]])


# projects ---------------------------------------------------------------------------------------------------------


def save_project(chunks: dict[str, dict[str, DataFrame]], path: str, active: str) -> None:
    """Tables by chunk and name, and, last, the document that names them."""
    import json

    some = next(iter(next(iter(chunks.values())).values())).sparkSession
    for chunk, tables in chunks.items():
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{path}/chunks/{chunk}/{name}")
    save_atomic(some, f"{path}/doc.json", json.dumps({"active": active, "chunks": [{"name": c, "tables": sorted(t)} for c, t in chunks.items()]}))


def project_chunks(spark: SparkSession, path: str) -> DataFrame:
    """chunk, tables, active of a project."""
    doc = spark.read.schema("active string, chunks array<struct<name:string, tables:array<string>>>").json(f"{path}/doc.json", multiLine=True)
    return doc.select("active", F.inline("chunks")).select(F.col("name").alias("chunk"), "tables", (F.col("name") == F.col("active")).alias("active"))


def open_session(spark: SparkSession, path: str, chunk: str | None = None) -> dict[str, DataFrame]:
    """Tables of a chunk (the active one unless named) by name; an unknown chunk is an error."""
    for r in project_chunks(spark, path).collect():  # a row for each chunk of one project
        if r["chunk"] == chunk or (chunk is None and r["active"]):
            return {t: spark.read.parquet(f"{path}/chunks/{r['chunk']}/{t}") for t in r["tables"]}
    raise KeyError(f"no chunk {chunk} in {path}")


# journals ---------------------------------------------------------------------------------------------------------

# Characters that a journal's fields escape.
ESCAPED = ["%", "\t", "\n", "\r", ","]
FIELDS = ["run", "attempt", "state", "blocked_reason", "dependencies"]


def escaped(value: Column) -> Column:
    for c in ESCAPED:
        value = F.replace(value, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return value


def unescaped(value: Column) -> Column:
    for c in reversed(ESCAPED):
        value = F.replace(value, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return value


def write_journal(runs: DataFrame, path: str, header: str) -> None:
    """Runs (run, attempt, state, blocked_reason, dependencies array) as lines; header is the first line of every file."""
    text = lambda c: escaped(F.coalesce(F.col(c).cast("string"), F.lit("")))
    needs = F.array_join(F.transform(F.coalesce("dependencies", F.array().cast("array<string>")), escaped), ",")
    line = F.concat_ws("\t", F.lit("RUN"), *[text(c) for c in FIELDS[:4]], needs)
    runs.select(line.alias("value")).write.mode("overwrite").text(f"{path}/runs")
    save_atomic(runs.sparkSession, f"{path}/journal", header)


def read_journal(spark: SparkSession, path: str, header: str) -> DataFrame:
    """Runs of a journal. Another header, or a line that is no run, is an error."""
    found = spark.read.text(f"{path}/journal").head()
    if found is None or found[0] != header:
        raise ValueError("unsupported journal schema")
    p = F.split("value", "\t")
    rows = spark.read.text(f"{path}/runs").where("value <> ''")
    bad = (F.size(p) != len(FIELDS) + 1) | (p[0] != "RUN") | p[2].try_cast("long").isNull()
    rows = rows.select(F.when(bad, F.raise_error(F.concat(F.lit("no run: "), "value")).cast("array<string>")).otherwise(p).alias("p"))
    needs = F.when(F.col("p")[5] == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(F.col("p")[5], ","), unescaped))
    return rows.select(unescaped(F.col("p")[1]).alias("run"), F.col("p")[2].cast("long").alias("attempt"), unescaped(F.col("p")[3]).alias("state"), unescaped(F.col("p")[4]).alias("blocked_reason"), needs.alias("dependencies"))
