"""Binary files: point pairs of an image pair, rasters as tiled GeoTIFF, and a sink that writes named files in two phases."""

from __future__ import annotations

import re
import struct
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

# fixed values of the point file: two counts, then records of x, y, their integers, orientation, scale, interest, polarity, octave,
# level, number of descriptor values, and those as floats; all little-endian
HEAD, RECORD = struct.Struct("<QQ"), np.dtype([("x", "<f4"), ("y", "<f4"), ("ix", "<i4"), ("iy", "<i4"), ("orientation", "<f4"), ("scale", "<f4"), ("interest", "<f4"), ("polarity", "i1"), ("octave", "<u4"), ("level", "<u4"), ("values", "<u8")])
# fixed values of TIFF and GeoTIFF: tags, and the kinds of their values
TAGS = {"width": 256, "length": 257, "bits": 258, "compression": 259, "photometric": 262, "samples": 277, "tile_width": 322, "tile_length": 323, "offsets": 324, "counts": 325, "format": 339, "scale": 33550, "tie": 33922, "keys": 34735, "nodata": 42113}
KINDS = {2: "s", 3: "H", 4: "I", 12: "d"}


class CutFile(ValueError):
    """A file that ends too early or says what cannot be."""


# named files -----------------------------------------------------------------------------------------------------------


def _place(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(re.sub("^file:/+", "/", path))


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class _NamedFilesWriter(DataSourceWriter):
    """Tasks write below a folder of the job's own; the commit moves files to their names, an abort deletes the folder."""

    def __init__(self, path: str):
        self.path, self.job = path, f"_job-{uuid.uuid4().hex}"

    def write(self, rows) -> Written:
        fs, path = _place(self.path)
        own, names = f"{path}/{self.job}/{uuid.uuid4().hex}", []
        fs.create_dir(own, recursive=True)
        for r in rows:
            if not r["name"] or "/" in r["name"] or r["name"].startswith(("_", ".")):
                raise ValueError("a file's name is not empty, has no slash, and does not begin with _ or .")
            with fs.open_output_stream(f"{own}/{r['name']}") as f:
                f.write(r["content"])
            names.append(f"{own}/{r['name']}")
        return Written(names)

    def commit(self, messages) -> None:
        fs, path = _place(self.path)
        names = [x for m in messages if m for x in m.names]
        if len({x.rsplit("/", 1)[1] for x in names}) < len(names):
            self.abort(messages)
            raise ValueError("two files have one name")
        for x in names:
            fs.move(x, f"{path}/{x.rsplit('/', 1)[1]}")
        fs.delete_dir(f"{path}/{self.job}")

    def abort(self, messages) -> None:
        fs, path = _place(self.path)
        fs.delete_dir_contents(f"{path}/{self.job}", missing_dir_ok=True)
        fs.delete_dir(f"{path}/{self.job}")


class NamedFiles(DataSource):
    """A sink for rows (name string, content binary): a file each, seen under its name when all tasks have ended."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _NamedFilesWriter(self.options["path"])


def write_files(files: DataFrame, path: str) -> None:
    """Rows (name, content) as files of a folder. A failed task leaves nothing behind."""
    files.sparkSession.dataSource.register(NamedFiles)
    files.select("name", "content").write.format("named_files").option("path", path).mode("append").save()


def _contents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


# point files -------------------------------------------------------------------------------------------------------------


def encode_points(left: np.ndarray, right: np.ndarray) -> bytes:
    """A point file of pairs (n x 2 each) without descriptors."""
    out = [HEAD.pack(len(left), len(right))]
    for p in (left, right):
        r = np.zeros(len(p), RECORD)
        r["x"], r["y"] = p.T
        r["ix"], r["iy"] = np.rint(p.T)
        out.append(r.tobytes())
    return b"".join(out)


def decode_points(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Left and right points of a point file; descriptors are passed over."""
    if len(content) < HEAD.size:
        raise CutFile("a point file ends within its counts")
    at, sides = HEAD.size, []
    for n in HEAD.unpack_from(content):
        if n * RECORD.itemsize > len(content) - at:
            raise CutFile("a point file ends before its last point")
        r = np.frombuffer(content, RECORD, n, at)
        if not r["values"].any():  # records of one size
            at += n * RECORD.itemsize
        else:
            rows = np.zeros(n, RECORD)
            for k in range(n):
                if len(content) - at < RECORD.itemsize:
                    raise CutFile("a point file ends before its last point")
                rows[k] = np.frombuffer(content, RECORD, 1, at)[0]
                at += RECORD.itemsize + 4 * int(rows[k]["values"])
                if at > len(content):
                    raise CutFile("a point file ends within a descriptor")
            r = rows
        sides.append(np.stack([r["x"], r["y"]], 1))
    return sides[0], sides[1]


def write_points(matches: DataFrame, path: str) -> None:
    """A point file for each pair (name, n, xa, ya, xb, yb: points in order of n). A group is one pair of images."""

    def pack(group: pa.Table) -> pa.Table:
        x = {c: group.column(c).to_numpy()[np.argsort(group.column("n").to_numpy(), kind="stable")] for c in ("xa", "ya", "xb", "yb")}
        return pa.table({"name": [group.column("name")[0].as_py()], "content": pa.array([encode_points(np.stack([x["xa"], x["ya"]], 1), np.stack([x["xb"], x["yb"]], 1))], pa.binary())})

    write_files(matches.select("name", "n", "xa", "ya", "xb", "yb").groupBy("name").applyInArrow(pack, "name string, content binary"), path)


def read_points(spark: SparkSession, path: str, most: float = 1e9) -> DataFrame:
    """name, n, xa, ya, xb, yb of point files: as many pairs as the shorter side has; points that are not finite or beyond `most` are left out."""

    def parse(batches):
        for b in batches:
            for name, content in zip(b.column("name").to_pylist(), b.column("content").to_pylist()):
                left, right = decode_points(content)
                k = min(len(left), len(right))
                p = np.hstack([left[:k], right[:k]]).astype(float)
                keep = np.flatnonzero((np.abs(p) <= most).all(1))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keep)), pa.array(keep), *map(pa.array, p[keep].T)], ["name", "n", "xa", "ya", "xb", "yb"])

    return _contents(spark, path).mapInArrow(parse, "name string, n long, xa double, ya double, xb double, yb double")


# rasters -----------------------------------------------------------------------------------------------------------------


def encode_geotiff(z: np.ndarray, x: float, y: float, step: float, nodata: float, tile: int = 64, epsg: int = 32650) -> bytes:
    """A tiled GeoTIFF of 32-bit floats; x, y: the outer corner of the first cell, rows going down."""
    rows, cols = z.shape
    down, across = -(-rows // tile), -(-cols // tile)
    full = np.full((down * tile, across * tile), nodata, "<f4")
    full[:rows, :cols] = z
    tiles = [full[i * tile : (i + 1) * tile, j * tile : (j + 1) * tile].tobytes() for i in range(down) for j in range(across)]
    size = tile * tile * 4
    values = {
        "width": (4, [cols]), "length": (4, [rows]), "bits": (3, [32]), "compression": (3, [1]), "photometric": (3, [1]), "samples": (3, [1]), "tile_width": (4, [tile]), "tile_length": (4, [tile]),
        "offsets": (4, [8 + k * size for k in range(len(tiles))]), "counts": (4, [size] * len(tiles)), "format": (3, [3]), "scale": (12, [step, step, 0.0]), "tie": (12, [0.0, 0.0, 0.0, x, y, 0.0]),
        "keys": (3, [1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, 3072, 0, 1, epsg]), "nodata": (2, [f"{nodata:g}\0".encode()]),
    }
    start = 8 + len(tiles) * size
    beyond = start + 2 + 12 * len(values) + 4
    directory, more = [struct.pack("<H", len(values))], b""
    for name, (kind, v) in sorted(values.items(), key=lambda x: TAGS[x[0]]):
        raw = v[0] if kind == 2 else struct.pack(f"<{len(v)}{KINDS[kind]}", *v)
        count = len(raw) if kind == 2 else len(v)
        if len(raw) > 4:
            raw, more = struct.pack("<I", beyond + len(more)), more + raw + b"\0" * (len(raw) % 2)
        directory.append(struct.pack("<HHI", TAGS[name], kind, count) + raw.ljust(4, b"\0"))
    return b"".join([struct.pack("<2sHI", b"II", 42, start), *tiles, *directory, struct.pack("<I", 0), more])


def decode_geotiff(content: bytes) -> tuple[np.ndarray, float, float, float, float | None]:
    """Values, x, y, step and nodata of what encode_geotiff writes."""
    try:
        mark, version, start = struct.unpack_from("<2sHI", content)
        if (mark, version) != (b"II", 42):
            raise CutFile("no little-endian TIFF")
        found, names = {}, {v: k for k, v in TAGS.items()}
        for k in range(struct.unpack_from("<H", content, start)[0]):
            at = start + 2 + 12 * k
            tag, kind, count = struct.unpack_from("<HHI", content, at)
            if tag in names and kind in KINDS:
                layout = f"<{count}{KINDS[kind]}"
                where = at + 8 if struct.calcsize(layout) <= 4 else struct.unpack_from("<I", content, at + 8)[0]
                found[names[tag]] = struct.unpack_from(layout, content, where)
        (cols,), (rows,), (tile,) = found["width"], found["length"], found["tile_width"]
        if found["bits"] != (32,) or found["format"] != (3,) or found["compression"] != (1,) or found["tile_length"] != (tile,):
            raise CutFile("a raster of another layout")
        down, across = -(-rows // tile), -(-cols // tile)
        full = np.zeros((down * tile, across * tile), np.float32)
        for k, (offset, n) in enumerate(zip(found["offsets"], found["counts"], strict=True)):
            i, j = divmod(k, across)
            full[i * tile : (i + 1) * tile, j * tile : (j + 1) * tile] = np.frombuffer(content, "<f4", tile * tile, offset).reshape(tile, tile)
        nodata = float(found["nodata"][0].rstrip(b"\0")) if "nodata" in found else None
        return full[:rows, :cols], found["tie"][3], found["tie"][4], found["scale"][0], nodata
    except (struct.error, KeyError, ValueError, IndexError) as e:
        raise CutFile(f"a raster file that cannot be read: {e}") from e


def write_geotiffs(cells: DataFrame, path: str, step: float, origin: tuple[float, float] = (0.0, 0.0), block: int = 512, nodata: float = -9999.0) -> None:
    """GeoTIFF files of a grid (r, c, value), one for each block of cells (a bounded group) that has any; origin: the corner of cell (0, 0)."""

    def pack(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        i, j = (k.as_py() for k in key)
        z = np.full((block, block), nodata, np.float32)
        z[group.column("r").to_numpy() - i * block, group.column("c").to_numpy() - j * block] = group.column("value").to_numpy()
        content = encode_geotiff(z, origin[0] + j * block * step, origin[1] - i * block * step, step, nodata, min(64, block))
        return pa.table({"name": [f"r{i}_c{j}.tif"], "content": pa.array([content], pa.binary())})

    rows = cells.where("value IS NOT NULL AND NOT isnan(value)").select("r", "c", F.col("value").cast("double").alias("value"), F.floor(F.col("r") / block).alias("i"), F.floor(F.col("c") / block).alias("j"))
    write_files(rows.groupBy("i", "j").applyInArrow(pack, "name string, content binary"), path)


def read_geotiffs(spark: SparkSession, path: str, origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """r, c, value of GeoTIFF files on one lattice, with rows and columns counted from the origin; cells without data are left out."""

    def parse(batches):
        for b in batches:
            for content in b.column("content").to_pylist():
                z, x, y, step, nodata = decode_geotiff(content)
                r, c = np.nonzero(np.isfinite(z) & (z != np.float32(nodata) if nodata is not None else True))
                top, left = round((origin[1] - y) / step), round((x - origin[0]) / step)
                yield pa.RecordBatch.from_arrays([pa.array(r + top), pa.array(c + left), pa.array(z[r, c].astype(float))], ["r", "c", "value"])

    return _contents(spark, path).mapInArrow(parse, "r long, c long, value double")
