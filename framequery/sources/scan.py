"""Folders of captures and images: listings that tasks read level by level, sizes of pictures by their headers, frames of
any format, and the JSON files that belong to them."""

from __future__ import annotations

import io
import struct
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framequery.functions import rules as ru
from framequery.session import shared_path
from framequery.sources import fits, register, ser

# Extensions of each format; those of videos are known but can't be read.
FORMATS = {"ser": "ser", "fits": "fits", "fit": "fits"}
VIDEOS = ("avi", "mov", "mp4", "m4v")
_LISTING = "path string, size long, modified timestamp, folder boolean"
_UNREADABLE = (ValueError, KeyError, IndexError, OSError, struct.error)


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What lies in each folder, hidden names left out."""
    for batch in batches:
        for path in batch.column("path").to_pylist():
            system, inner = ser.open_path(path)
            prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
            found = [i for i in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)) if not i.base_name.startswith(".")]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([prefix + i.path for i in found], pa.string()),
                    pa.array([i.size if i.is_file else None for i in found], pa.int64()),
                    pa.array([i.mtime for i in found], pa.timestamp("us", "UTC")),
                    pa.array([not i.is_file for i in found], pa.bool_()),
                ],
                names=["path", "size", "modified", "folder"],
            )


def _spread(rows: DataFrame) -> DataFrame:
    """Rows over all tasks: they are small, but each stands for a file or folder to open."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")


def listed(spark: SparkSession, root: str, recursive: bool = False) -> DataFrame:
    """(path, size, modified) of the files of a folder, and of those below it. Hidden files and folders are left out; a
    folder that isn't there has no files. Each level of folders is one job whose tasks list them; a level is written to
    the shared folder, so the driver holds neither names nor counts of files."""
    level, levels = spark.createDataFrame([(root.rstrip("/"),)], "path string"), []
    while True:
        place = shared_path(spark, "listing")
        _spread(level).mapInArrow(_children, _LISTING).write.parquet(place)
        levels.append(spark.read.schema(_LISTING).parquet(place))
        level = levels[-1].where("folder").select("path")
        if not recursive or level.isEmpty():
            return reduce(DataFrame.union, (found.where("NOT folder").drop("folder") for found in levels))


def _ser_size(f: pa.NativeFile, path: str, length: int) -> tuple[int, int]:
    h = ser.parse_header(f.read(ser.HEADER_BYTES), length, path)
    return h["w"], h["h"]


def _fits_size(f: pa.NativeFile, path: str, length: int) -> tuple[int, int]:
    cards = fits.read_cards(f, path)
    return int(cards["NAXIS1"]), int(cards["NAXIS2"])


def _png_size(f: pa.NativeFile, path: str, length: int) -> tuple[int, int]:
    head = f.read(24)
    if head[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError(f"{path} is no PNG")
    return struct.unpack(">2I", head[16:24])


def _avi_size(f: pa.NativeFile, path: str, length: int) -> tuple[int, int]:
    head = f.read(4096)
    return struct.unpack_from("<2I", head, head.index(b"avih") + 40)


def _jpeg_size(f: pa.NativeFile, path: str, length: int) -> tuple[int, int]:
    """The frame header follows segments that tell their lengths."""
    if f.read(2) != b"\xff\xd8":
        raise ValueError(f"{path} is no JPEG")
    while True:
        lead, kind, size = struct.unpack(">BBH", f.read(4))
        if lead != 0xFF or size < 2:
            raise ValueError(f"{path}: no segment")
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">x2H", f.read(5))
            return w, h
        f.seek(size - 2, io.SEEK_CUR)


def _tiff_size(f: pa.NativeFile, path: str, length: int) -> tuple[int, int]:
    """Tags 256 and 257 of the first directory, of 16 or 32 bits."""
    head = f.read(8)
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(head[:4])
    if order is None:
        raise ValueError(f"{path} is no TIFF")
    f.seek(struct.unpack(order + "I", head[4:])[0])
    size = {}
    for _ in range(struct.unpack(order + "H", f.read(2))[0]):
        entry = f.read(12)
        tag, kind = struct.unpack(order + "2H", entry[:4])
        size[tag] = struct.unpack_from(order + ("H" if kind == 3 else "I"), entry, 8)[0]
    return size[256], size[257]


_SIZES: dict[str, Callable] = {
    "ser": _ser_size, "fits": _fits_size, "fit": _fits_size, "png": _png_size, "avi": _avi_size,
    "jpg": _jpeg_size, "jpeg": _jpeg_size, "tif": _tiff_size, "tiff": _tiff_size,
}


def picture_size(path: str) -> tuple[int | None, int | None]:
    """Width and height by the header, nothing else of the file is read; None for what can't be read."""
    system, inner = ser.open_path(path)
    try:
        with system.open_input_file(inner) as f:
            w, h = _SIZES[path.rsplit(".", 1)[-1].lower()](f, path, f.size())
            return (w, h) if 0 < w < 1 << 31 and 0 < h < 1 << 31 else (None, None)
    except _UNREADABLE:
        return None, None


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [picture_size(p) for p in batch.column("path").to_pylist()]
        w, h = (pa.array([s[k] for s in found], pa.int32()) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([*batch.columns, w, h], names=[*batch.schema.names, "w", "h"])


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(_name(path), r"\.([^.]+)$", 1))


def scan(spark: SparkSession, root: str, recursive: bool = False) -> DataFrame:
    """The captures and images of a folder: (path, size, modified, name, extension, target, sort_key, w, h). Target words
    are looked for in the name and its folder's; sort_key orders names with digits as numbers; w and h are NULL where the
    header can't be read."""
    parent = F.coalesce(F.get(F.reverse(F.split("path", "/")), 1), F.lit(""))
    files = listed(spark, root, recursive).withColumns({"name": _name(F.col("path")), "extension": _extension(F.col("path"))})
    known = files.where(F.col("extension").isin(ru.EXTENSIONS)).withColumns({"target": ru.detect_target(F.col("name"), parent), "sort_key": ru.natural_key(F.col("name"))})
    return _spread(known).mapInArrow(_sizes, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in known.schema)}, w int, h int")


def headers(files: DataFrame) -> DataFrame:
    """ser.HEADER_SCHEMA of the captures among files (path), whatever folders they lie in; what can't be read has no row."""
    names = [c.split()[0] for c in ser.HEADER_SCHEMA.split(", ")]

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            rows = []
            for path in batch["path"]:
                try:
                    rows.append(ser.read_header(path))
                except _UNREADABLE:
                    continue
            yield pd.DataFrame(rows, columns=names)

    return _spread(files.where(_extension(F.col("path")) == "ser").select("path")).mapInPandas(run, ser.HEADER_SCHEMA)


def format_of(extension: str) -> str:
    """The data source that reads files of an extension."""
    kind = FORMATS.get(extension.lower())
    if kind is None:
        raise ValueError(f"no codec reads .{extension}" if extension.lower() in VIDEOS else f".{extension} is no capture")
    return kind


def open_frames(spark: SparkSession, path: str) -> DataFrame:
    """(path, frame_idx, w, h, plane) of luma, whatever the format: of one file, or of all that can be read in a folder.
    An image is a capture of one frame. Raises ValueError for a file of another kind."""
    register(spark)
    system, inner = ser.open_path(path)
    one = system.get_file_info(inner).type == fs.FileType.File
    kinds = {format_of(path.rsplit("/", 1)[-1].rpartition(".")[2])} if one else set(FORMATS.values())
    found = []
    if "ser" in kinds:
        found.append(spark.read.format("ser").load(path).mapInArrow(ser.planes, "path string, frame_idx int, w int, h int, plane array<double>"))
    if "fits" in kinds:
        found.append(spark.read.format("fits").load(path).select("path", F.lit(0).alias("frame_idx"), "w", "h", F.col("plane").cast("array<double>").alias("plane")))
    return reduce(DataFrame.union, found)


def baselines(spark: SparkSession, root: str, key: Column | None = None) -> DataFrame:
    """(path, key, value, text) of the JSON objects, over any number of lines, in the files named *.json of a folder and
    those below it. path is the file's name without its ending, or `key` (of the column `file`); value is NULL where text
    is no number. A file that is no object has no rows."""
    stem = F.regexp_extract("file", r"([^/]+)\.[Jj][Ss][Oo][Nn]$", 1) if key is None else key
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(root, wholetext=True)
    rows = read.select(F.url_decode(F.col("_metadata.file_path")).alias("file"), F.from_json("value", "map<string,string>").alias("_map"))
    return rows.select(stem.alias("path"), F.explode("_map").alias("key", "text")).select("path", "key", F.col("text").try_cast("double").alias("value"), "text")


def baseline_key(path: Column) -> Column:
    """Name of a capture's baseline: its folder's name and its own."""
    return F.concat(F.element_at(F.split(path, "/"), -2), F.lit("__"), _name(path))


def capture_metrics(heads: DataFrame) -> DataFrame:
    """(path, key, value): numbers of headers by the name of their baseline."""
    keys = {"frameCount": "frame_count", "imageWidth": "w", "imageHeight": "h", "pixelDepth": "depth", "bytesPerFrame": "bytes_per_frame"}
    return heads.select(baseline_key(F.col("path")).alias("path"), *(F.col(c).cast("double").alias(k) for k, c in keys.items())).unpivot("path", list(keys), "key", "value")
