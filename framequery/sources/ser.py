"""SER captures: header parsing, a Python data source with frame-range partitions, a writer, and a synthetic generator.

Paths may be local or any URI that pyarrow's file systems open; they must be reachable from all executors, since each
partition seeks to its own frames and reads nothing else.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from typing import BinaryIO
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

# The header's layout and the colour ids of the format.
HEADER_BYTES = 178
HEADER = struct.Struct("<14s7i40s40s40s2q")
COLORS = {0: "mono", 8: "bayerRGGB", 9: "bayerGRBG", 10: "bayerGBRG", 11: "bayerBGGR", 16: "rgb", 17: "bgr"}
HEADER_SCHEMA = (
    "path string, file_id string, lu_id int, color_id int, color string, little_endian boolean, w int, h int, depth int, frame_count int, "
    "readable_frames int, bytes_per_frame long, file_bytes long, observer string, instrument string, telescope string, ticks_local long, ticks_utc long"
)
FRAME_SCHEMA = "path string, frame_idx int, w int, h int, depth int, color string, ticks long, data binary"


def text_of(raw: bytes) -> str:
    """Fixed-width ASCII up to the first NUL, trimmed."""
    return raw.split(b"\0", 1)[0].decode("ascii", "replace").strip()


def resolve_color(raw: int, w: int, h: int, depth: int, payload: int, frames: int) -> int:
    """A known colour id, one of the dialect that adds 100, or what the bytes of a frame tell; else an error."""
    for candidate in (raw, raw - 100):
        if candidate in COLORS:
            return candidate
    if frames > 0 and w > 0 and h > 0:
        mono, each = w * h * (2 if depth > 8 else 1), payload / frames
        for size, color in ((mono, 0), (3 * mono, 16)):
            if abs(each - size) <= max(64, size * 0.01):
                return color
    raise ValueError(f"unknown colour id {raw}")


def parse_header(head: bytes, length: int, path: str = "") -> dict:
    """All fields of HEADER_SCHEMA. Raises ValueError for short files, sizes of 0 and depths other than 8 or 16."""
    if len(head) < HEADER_BYTES:
        raise ValueError(f"{path}: {len(head)} bytes are no SER header")
    file_id, lu_id, color, endian, w, h, depth, frames, observer, instrument, telescope, local, utc = HEADER.unpack(head[:HEADER_BYTES])
    if depth not in (8, 16) or w <= 0 or h <= 0 or frames < 0:
        raise ValueError(f"{path}: {w} x {h} at {depth} bits is not readable")
    color = resolve_color(color, w, h, depth, length - HEADER_BYTES, frames)
    per = w * h * (2 if depth > 8 else 1) * (3 if color in (16, 17) else 1)
    return {
        "path": path, "file_id": text_of(file_id), "lu_id": lu_id, "color_id": color, "color": COLORS[color], "little_endian": endian == 0, "w": w, "h": h, "depth": depth,
        "frame_count": frames, "readable_frames": max(0, min(frames, (length - HEADER_BYTES) // per)), "bytes_per_frame": per, "file_bytes": length,
        "observer": text_of(observer), "instrument": text_of(instrument), "telescope": text_of(telescope), "ticks_local": local, "ticks_utc": utc,
    }


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a path or URI. URIs are written as Spark writes paths, blanks and percent signs as they are."""
    return fs.FileSystem.from_uri(quote(path, safe="/:?&=@,+~[]")) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def list_sizes(path: str, suffix: str) -> list[tuple[str, int]]:
    """The files of a folder (or the one file) with their sizes, by name; hidden ones are skipped."""
    system, inner = open_path(path)
    info = system.get_file_info(inner)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = system.get_file_info(fs.FileSelector(inner))
    return [(prefix + f.path, f.size) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.path.lower().endswith(suffix) and not f.base_name.startswith(".")]


def list_files(path: str, suffix: str) -> list[str]:
    return [p for p, _ in list_sizes(path, suffix)]


def read_header(path: str) -> dict:
    system, inner = open_path(path)
    length = system.get_file_info(inner).size
    with system.open_input_file(inner) as f:
        return parse_header(f.read(HEADER_BYTES), length, path)


def read_frames(path: str, first: int, last: int) -> Iterator[tuple]:
    """Rows of FRAME_SCHEMA of the frames [first, last) of a capture; nothing else of it is read."""
    h = read_header(path)
    system, inner = open_path(path)
    trailer = HEADER_BYTES + h["frame_count"] * h["bytes_per_frame"]
    with system.open_input_file(inner) as f:
        ticks: tuple = (None,) * (last - first)
        if h["file_bytes"] >= trailer + 8 * h["frame_count"]:
            f.seek(trailer + 8 * first)
            ticks = struct.unpack(f"<{len(ticks)}q", f.read(8 * len(ticks)))
        f.seek(HEADER_BYTES + first * h["bytes_per_frame"])
        for k in range(first, last):
            yield path, k, h["w"], h["h"], h["depth"], h["color"], ticks[k - first], f.read(h["bytes_per_frame"])


class Share(InputPartition):
    """Files whose headers a task reads, or its share of one file's frames: `part` of `parts`."""

    def __init__(self, paths: list[str], part: int = 0, parts: int = 1):
        self.paths, self.part, self.parts = paths, part, parts


class SerReader(DataSourceReader):
    """The driver only lists files and their sizes; tasks read the headers."""

    def __init__(self, options: dict, headers_only: bool):
        self.headers_only = headers_only
        self.path = options["path"]
        self.per_share = int(options.get("bytesPerPartition", str(64 << 20)))
        self.first = int(options.get("firstFrames", "0"))

    def partitions(self) -> Sequence[InputPartition]:
        found = list_sizes(self.path, ".ser")
        if self.headers_only or self.first:
            return [Share([p for p, _ in found[k : k + 256]]) for k in range(0, len(found), 256)]
        parts = ((path, max(1, -(-size // self.per_share))) for path, size in found)
        return [Share([path], k, n) for path, n in parts for k in range(n)]

    def read(self, partition: Share) -> Iterator[tuple]:
        if self.headers_only:
            for path in partition.paths:
                yield tuple(read_header(path).values())
            return
        if self.first:
            for path in partition.paths:
                yield from read_frames(path, 0, min(self.first, read_header(path)["readable_frames"]))
            return
        path = partition.paths[0]
        n = read_header(path)["readable_frames"]
        yield from read_frames(path, *(n * k // partition.parts for k in (partition.part, partition.part + 1)))


class SerDataSource(DataSource):
    """spark.read.format("ser").load(path): raw frames, bytesPerPartition (64 MB) of a file a task; headersOnly=true: one row a file;
    firstFrames=k: no more than the first k frames of each file, many files a task."""

    @classmethod
    def name(cls) -> str:
        return "ser"

    def _headers_only(self) -> bool:
        return str(self.options.get("headersOnly", "false")).lower() == "true"

    def schema(self) -> str:
        return HEADER_SCHEMA if self._headers_only() else FRAME_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return SerReader(self.options, self._headers_only())

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return SerWriter(self.options, schema, overwrite)


class SerWriter(DataSourceArrowWriter):
    """df.write.format("ser").mode("append" or "overwrite").save(folder): one file for each path of the rows.

    Rows are those of FRAME_SCHEMA, a path's together and in frame order (export.write_captures deals them so); files are
    named by the last part of path. observer, instrument, telescope, ticks_local and ticks_utc are taken from columns of
    these names where there are any. Ticks are appended where every frame has them. A task holds one batch of frames and the ticks of one file; a file's frames are first written beside it,
    as the header tells their number.
    """

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        from framequery.sources.commit import FileCommit

        self.names = schema.names
        missing = {"path", "w", "h", "depth", "color", "data"} - set(self.names)
        if missing:
            raise ValueError(f"rows of captures have no {sorted(missing)}")
        self.out = FileCommit(options["path"], ".ser", overwrite)

    def write(self, iterator: Iterator[pa.RecordBatch]):
        from framequery.sources.commit import Written

        folder, files, now = self.out.attempt(), [], None
        for batch in iterator:
            for k in range(batch.num_rows):
                path = batch.column("path")[k].as_py()
                if now is None or path != now.path:
                    if now is not None:
                        files.append(now.close())
                    row = {n: batch.column(n)[k].as_py() for n in self.names if n not in ("data", "ticks")}
                    now = OneCapture(f"{folder}/{len(files)}", path, row)
                now.add(batch.column("data")[k].as_buffer(), batch.column("ticks")[k].as_py() if "ticks" in self.names else None)
        if now is not None:
            files.append(now.close())
        return Written(files)

    def commit(self, messages: list) -> None:
        self.out.commit(messages)

    def abort(self, messages: list) -> None:
        self.out.abort(messages)


class OneCapture:
    """A file that is being written: its frames, then header, frames and ticks."""

    def __init__(self, place: str, path: str, row: dict):
        from framequery.sources.commit import opened

        self.place, self.path, self.row = place, path, row
        self.name = path.rsplit("/", 1)[-1]
        self.name += "" if self.name.lower().endswith(".ser") else ".ser"
        self.color = next((k for k, v in COLORS.items() if v == row["color"]), None)
        if self.color is None or row["depth"] not in (8, 16) or row["w"] <= 0 or row["h"] <= 0:
            raise ValueError(f"{path}: {row['w']} x {row['h']} {row['color']} at {row['depth']} bits can't be written")
        self.size = row["w"] * row["h"] * row["depth"] // 8 * (3 if self.color in (16, 17) else 1)
        self.ticks: list[int | None] = []
        self.system = open_path(place)[0]
        self.frames: BinaryIO = opened(f"{place}.frames")

    def add(self, data: pa.Buffer, ticks: int | None) -> None:
        if data is None or data.size != self.size:
            raise ValueError(f"{self.path}: frame {len(self.ticks)} has not {self.size} bytes")
        self.frames.write(data)
        self.ticks.append(ticks)

    def close(self) -> tuple[str, str]:
        self.frames.close()
        row, n = self.row, len(self.ticks)
        ticks = [] if None in self.ticks else self.ticks
        strings, inner = tuple(row.get(k) or "" for k in ("observer", "instrument", "telescope")), open_path(self.place)[1]
        with self.system.open_output_stream(f"{inner}.ser") as out, self.system.open_input_stream(f"{inner}.frames") as frames:
            out.write(header_bytes(n, row["w"], row["h"], row["depth"], self.color, strings, row.get("ticks_utc") or 0, row.get("ticks_local") or 0))
            while part := frames.read(8 << 20):
                out.write(part)
            out.write(struct.pack(f"<{len(ticks)}q", *ticks))
        self.system.delete_file(f"{inner}.frames")
        return f"{self.place}.ser", self.name


def unpack(data: bytes, w: int, h: int, depth: int, color: str) -> np.ndarray:
    """A frame as floats in 0..1: (h, w), or (h, w, 3) in RGB order."""
    raw = np.frombuffer(data, "<u2" if depth > 8 else np.uint8)
    flat = raw / (65535.0 if depth > 8 else 255.0)
    if color in ("rgb", "bgr"):
        planes = flat.reshape(h, w, 3)
        return planes[:, :, ::-1] if color == "bgr" else planes
    return flat.reshape(h, w)


def bayer_sites(color: str) -> dict[str, list[tuple[int, int]]]:
    """(row, column) offsets of each colour in a 2 x 2 cell."""
    letters = color.removeprefix("bayer")
    return {c: [(k // 2, k % 2) for k in range(4) if letters[k] == c] for c in "RGB"}


def bayer_channel(mosaic: np.ndarray, color: str, channel: str) -> np.ndarray:
    """Half-size plane of one colour; green is the mean of its two sites."""
    return np.mean([mosaic[y::2, x::2][: mosaic.shape[0] // 2, : mosaic.shape[1] // 2] for y, x in bayer_sites(color)[channel]], axis=0)


def combine_channels(r: np.ndarray, g: np.ndarray, b: np.ndarray, color: str = "bayerRGGB") -> np.ndarray:
    """Full-size RGB of three half-size planes, each sampled bilinearly from where its sites lie in a cell: red and blue at
    their own, green at the cell's centre. Places outside are those of the edge."""
    (ry, rx), (by, bx) = bayer_sites(color)["R"][0], bayer_sites(color)["B"][0]

    def axis(n: int, off: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = (np.arange(2 * n) - off) * 0.5
        low = np.clip(np.floor(at).astype(int), 0, n - 1)
        return low, np.minimum(low + 1, n - 1), np.clip(at - low, 0.0, 1.0)

    def full(plane: np.ndarray, oy: float, ox: float) -> np.ndarray:
        (y0, y1, wy), (x0, x1, wx) = axis(plane.shape[0], oy), axis(plane.shape[1], ox)
        rows = plane[y0] * (1 - wy)[:, None] + plane[y1] * wy[:, None]
        return rows[:, x0] * (1 - wx) + rows[:, x1] * wx

    return np.stack([full(r, ry, rx), full(g, 0.5, 0.5), full(b, by, bx)], axis=-1)


def demosaic(mosaic: np.ndarray, color: str, flip: bool = False) -> np.ndarray:
    """RGB (h, w, 3) of a mosaic in 0..1 by the gradient-corrected linear filters of Malvar, He and Cutler (2004); places
    outside are those of the edge. flip turns the image by 180 degrees."""
    h, w = mosaic.shape
    wide = np.pad(mosaic, 2, mode="edge")

    def at(dy: int, dx: int) -> np.ndarray:
        return wide[2 + dy : 2 + dy + h, 2 + dx : 2 + dx + w]

    near_x, near_y = at(0, -1) + at(0, 1), at(-1, 0) + at(1, 0)
    far_x, far_y = at(0, -2) + at(0, 2), at(-2, 0) + at(2, 0)
    corners = at(-1, -1) + at(-1, 1) + at(1, -1) + at(1, 1)
    green = np.clip((4 * mosaic + 2 * (near_x + near_y) - far_x - far_y) / 8, 0, 1)
    across = np.clip((5 * mosaic + 4 * near_x - corners - far_x + 0.5 * far_y) / 8, 0, 1)
    along = np.clip((5 * mosaic + 4 * near_y - corners - far_y + 0.5 * far_x) / 8, 0, 1)
    other = np.clip((6 * mosaic + 2 * corners - 1.5 * (far_x + far_y)) / 8, 0, 1)
    (ry, rx) = bayer_sites(color)["R"][0]
    in_row, in_column = (np.arange(h) % 2 == ry)[:, None], (np.arange(w) % 2 == rx)[None, :]
    red, blue, by_red = in_row & in_column, ~in_row & ~in_column, in_row & ~in_column
    r = np.where(red, mosaic, np.where(blue, other, np.where(by_red, across, along)))
    g = np.where(red | blue, green, mosaic)
    b = np.where(blue, mosaic, np.where(red, other, np.where(by_red, along, across)))
    out = np.stack([r, g, b], axis=-1)
    return out[::-1, ::-1] if flip else out


def header_bytes(n: int, w: int, h: int, depth: int, color_id: int, strings: tuple[str, str, str] = ("", "", ""), utc: int = 0, local: int = 0) -> bytes:
    names = [s.encode("ascii", "replace")[:40] for s in strings]
    return HEADER.pack(b"LUCAM-RECORDER", 0, color_id, 0, w, h, depth, n, *names, local, utc)


def encode_ser(frames: Sequence[bytes], w: int, h: int, depth: int = 8, color_id: int = 0, ticks: Sequence[int] = (), strings: tuple[str, str, str] = ("", "", ""), utc: int = 0, local: int = 0) -> bytes:
    """A whole SER file: header, frames, and the trailer of ticks where there are any."""
    return header_bytes(len(frames), w, h, depth, color_id, strings, utc, local) + b"".join(frames) + struct.pack(f"<{len(ticks)}q", *ticks)


def write_ser(path: str, frames: Sequence[bytes], **header) -> None:
    system, inner = open_path(path)
    with system.open_output_stream(inner) as f:
        f.write(encode_ser(frames, **header))


def synthetic(w: int = 64, h: int = 48, depth: int = 8, n: int = 3, color_id: int = 0, fill: int = 0xAA, stamp: bool = True, **header) -> bytes:
    """Frames of one fill byte; the first byte of frame i is 0x10 + i where stamped."""
    size = w * h * (2 if depth > 8 else 1) * (3 if color_id in (16, 17) else 1)
    frames = [bytes([(0x10 + i) & 0xFF if stamp else fill]) + bytes([fill]) * (size - 1) for i in range(n)]
    return encode_ser(frames, w=w, h=h, depth=depth, color_id=color_id, **header)


def planes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function over FRAME_SCHEMA rows: (path, frame_idx, w, h, plane ARRAY<DOUBLE>) of luma; mosaics are interpolated first."""
    for batch in batches:
        rows = batch.to_pylist()
        out = []
        for r in rows:
            image = unpack(r["data"], r["w"], r["h"], r["depth"], r["color"])
            image = demosaic(image, r["color"]) if r["color"].startswith("bayer") else image
            out.append((image @ np.array([0.2126, 0.7152, 0.0722]) if image.ndim == 3 else image).ravel())
        columns = [batch.column(i) for i in range(4)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.list_(pa.float64()))], names=["path", "frame_idx", "w", "h", "plane"])
