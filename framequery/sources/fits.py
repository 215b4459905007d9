"""FITS images of 32-bit floats: cards, reader, writer, and a data source of one row a file."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator, Sequence
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from framequery.sources.ser import list_sizes, open_path

# Sizes of the format.
BLOCK, CARD = 2880, 80
SCHEMA = "path string, w int, h int, date_obs string, cards map<string,string>, plane array<float>"
HEADER_SCHEMA = "path string, w int, h int, date_obs string, cards map<string,string>, file_bytes long"


def parse_card(card: str) -> tuple[str, str] | None:
    """Key and value of a card; None for HISTORY, COMMENT, END and blank ones. A comment begins at a slash outside
    quotes; quotes are taken off, doubled ones stand for one."""
    key = card[:8].strip()
    if not key or key in ("HISTORY", "COMMENT", "END") or card[8:10] != "= ":
        return None
    rest, quoted, out = card[10:], False, ""
    for c in rest:
        if c == "'":
            quoted = not quoted
        if c == "/" and not quoted:
            break
        out += c
    value = out.strip()
    if len(value) >= 2 and value[0] == value[-1] == "'":
        value = value[1:-1].replace("''", "'").strip()
    return key, value


def read_cards(f: BinaryIO, path: str = "") -> dict[str, str]:
    """The cards of a header, which f is left behind. Only two-dimensional 32-bit float images are read."""
    cards: dict[str, str] = {}
    ended = False
    while not ended:
        block = f.read(BLOCK)
        if len(block) < BLOCK:
            raise ValueError(f"{path}: the header doesn't end")
        for k in range(0, BLOCK, CARD):
            card = block[k : k + CARD].decode("ascii", "replace")
            if card.rstrip() == "END":
                ended = True
                break
            if (found := parse_card(card)) and found[0] not in cards:
                cards[found[0]] = found[1]
    if cards.get("SIMPLE") != "T" or cards.get("BITPIX") != "-32" or cards.get("NAXIS") != "2":
        raise ValueError(f"{path}: not a two-dimensional 32-bit float image")
    return cards


def decode(data: bytes, path: str = "") -> tuple[dict[str, str], np.ndarray]:
    """Cards and (h, w) plane."""
    f = io.BytesIO(data)
    cards = read_cards(f, path)
    w, h = int(cards["NAXIS1"]), int(cards["NAXIS2"])
    if len(data) < f.tell() + 4 * w * h:
        raise ValueError(f"{path}: the data end early")
    return cards, np.frombuffer(data, ">f4", w * h, f.tell()).reshape(h, w).astype(np.float32)


#: Values that are written without quotes: T, F and numbers.
BARE = re.compile(r"[TF]|[+-]?(\d+\.?\d*|\.\d+)([EeDd][+-]?\d+)?")


class Bare(str):
    """A card's value as it stands."""


def encode(plane: np.ndarray, cards: dict[str, str | float | int] | None = None) -> bytes:
    h, w = plane.shape

    def card(key: str, value: object) -> bytes:
        text = f"'{str(value).replace(chr(39), chr(39) * 2):<8}'" if isinstance(value, str) and not isinstance(value, Bare) and value not in ("T", "F") else f"{value!s:>20}"
        return f"{key:<8}= {text}".ljust(CARD)[:CARD].encode("ascii", "replace")

    lines = [card(k, v) for k, v in {"SIMPLE": "T", "BITPIX": -32, "NAXIS": 2, "NAXIS1": w, "NAXIS2": h, **(cards or {})}.items()]
    head = b"".join([*lines, b"END".ljust(CARD)])
    body = plane.astype(">f4").tobytes()
    return head + b" " * (-len(head) % BLOCK) + body + b"\0" * (-len(body) % BLOCK)


class FitsFiles(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class FitsReader(DataSourceReader):
    """The driver only lists files; a task reads many headers, or files of about bytesPerPartition (64 MB) together."""

    def __init__(self, options: dict, headers_only: bool):
        self.path, self.headers_only = options["path"], headers_only
        self.per_share = int(options.get("bytesPerPartition", str(64 << 20)))

    def partitions(self) -> Sequence[InputPartition]:
        found = sorted({f for suffix in (".fits", ".fit") for f in list_sizes(self.path, suffix)})
        if self.headers_only:
            return [FitsFiles(found[k : k + 256]) for k in range(0, len(found), 256)]
        shares: list[list[tuple[str, int]]] = []
        held = self.per_share
        for f in found:
            if held >= self.per_share:
                shares.append([])
                held = 0
            shares[-1].append(f)
            held += f[1]
        return [FitsFiles(s) for s in shares]

    def read(self, partition: FitsFiles) -> Iterator[tuple]:
        for path, size in partition.files:
            system, inner = open_path(path)
            with system.open_input_file(inner) as f:
                if self.headers_only:
                    cards = read_cards(f, path)
                    yield path, int(cards["NAXIS1"]), int(cards["NAXIS2"]), cards.get("DATE-OBS"), cards, size
                else:
                    cards, plane = decode(f.read(), path)
                    yield path, plane.shape[1], plane.shape[0], cards.get("DATE-OBS"), cards, plane.ravel().tolist()


class FitsDataSource(DataSource):
    """spark.read.format("fits").load(path): one row a file; headersOnly=true: without the plane."""

    @classmethod
    def name(cls) -> str:
        return "fits"

    def _headers_only(self) -> bool:
        return str(self.options.get("headersOnly", "false")).lower() == "true"

    def schema(self) -> str:
        return HEADER_SCHEMA if self._headers_only() else SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return FitsReader(self.options, self._headers_only())

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return FitsWriter(self.options, schema, overwrite)


# Cards that a header sets by itself.
OWN_CARDS = ("SIMPLE", "BITPIX", "NAXIS", "NAXIS1", "NAXIS2", "END")


class FitsWriter(DataSourceArrowWriter):
    """df.write.format("fits").mode("append" or "overwrite").save(folder): one file for each row (path, w, h, plane and,
    where there are such columns, date_obs and cards), named by the last part of path. Any partitioning will do; a task
    holds one batch of planes."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        from framequery.sources.commit import FileCommit

        self.names = schema.names
        missing = {"path", "w", "h", "plane"} - set(self.names)
        if missing:
            raise ValueError(f"rows of images have no {sorted(missing)}")
        self.out = FileCommit(options["path"], ".fits", overwrite)

    def write(self, iterator: Iterator[pa.RecordBatch]):
        from framequery.sources.commit import Written

        folder, files = self.out.attempt(), []
        for batch in iterator:
            for k in range(batch.num_rows):
                path, w, h = (batch.column(n)[k].as_py() for n in ("path", "w", "h"))
                plane = batch.column("plane")[k].values.to_numpy(zero_copy_only=False)
                if len(plane) != w * h:
                    raise ValueError(f"{path}: {len(plane)} pixels aren't {w} x {h}")
                cards = dict(batch.column("cards")[k].as_py() or ()) if "cards" in self.names else {}
                date = batch.column("date_obs")[k].as_py() if "date_obs" in self.names else None
                if date is not None:
                    cards["DATE-OBS"] = date
                name = path.rsplit("/", 1)[-1]
                name += "" if name.lower().endswith(".fits") else ".fits"
                with self.out.file(folder, str(len(files))) as f:
                    f.write(encode(plane.reshape(h, w), {c: Bare(v) if BARE.fullmatch(v) else v for c, v in cards.items() if c not in OWN_CARDS}))
                files.append((f"{folder}/{len(files)}", name))
        return Written(files)

    def commit(self, messages: list) -> None:
        self.out.commit(messages)

    def abort(self, messages: list) -> None:
        self.out.abort(messages)
