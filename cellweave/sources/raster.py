"""TIFF rasters as tables of cells: a data source that reads only the blocks asked for, and a writer of strips.

read_raster gives r, c and a column for each band. Every partition holds some blocks (strips or tiles) of a file, which its
task reads by offset and length, inflates and turns back. Files are opened by pyarrow's file systems (local, hdfs, s3).
"""

from __future__ import annotations

import bisect
import functools
import re
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: Fixed values of the format: numbers of tags, sizes of types by their number, and compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, DESCRIPTION, STRIP_AT, SAMPLES, ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 270, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_BYTES, FORMAT, SCALE, TIE, MATRIX, GEO_KEYS, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34264, 34735, 42113
KINDS = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 7: "s", 8: "h", 9: "i", 11: "f", 12: "d"}
NONE, DEFLATE, OLD_DEFLATE = 1, 8, 32946
FORMATS = {1: "u", 2: "i", 3: "f"}
#: Raw bytes of blocks that a partition holds, about.
PARTITION_BYTES = 16 << 20


def opened(path: str):
    """A file system and the path in it."""
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+://|file:", path) else (fs.LocalFileSystem(), path)


@dataclass
class Header:
    """What a file says of itself; offsets and sizes of its blocks, band by band if bands lie apart."""

    height: int
    width: int
    bands: int
    dtype: str
    compression: int
    predictor: int
    apart: bool
    block: tuple[int, int]
    offsets: list[int]
    sizes: list[int]
    nodata: float | None
    transform: tuple | None
    epsg: int | None
    description: str

    def grid(self) -> tuple[int, int]:
        return -(-self.height // self.block[0]), -(-self.width // self.block[1])


def read_header(path: str) -> Header:
    """The first directory of a classic TIFF file of either byte order."""
    system, name = opened(path)
    with system.open_input_file(name) as f:
        start = f.read(8)
        order = {b"II": "<", b"MM": ">"}.get(start[:2])
        if order is None or struct.unpack(order + "H", start[2:4])[0] != 42:
            raise ValueError(f"not a TIFF file: {path}")
        f.seek(struct.unpack(order + "I", start[4:8])[0])
        (n,) = struct.unpack(order + "H", f.read(2))
        entries = f.read(12 * n)
        tags: dict = {}
        for i in range(n):
            tag, kind, count = struct.unpack(order + "HHI", entries[12 * i : 12 * i + 8])
            if kind not in KINDS:
                continue
            size = struct.calcsize(order + KINDS[kind]) * count
            raw = entries[12 * i + 8 : 12 * i + 12]
            if size > 4:
                f.seek(struct.unpack(order + "I", raw)[0])
                raw = f.read(size)
            tags[tag] = raw[:size].split(b"\0")[0].decode("latin-1") if KINDS[kind] == "s" else struct.unpack(f"{order}{count}{KINDS[kind]}", raw[:size])
    one = lambda tag, default: tags.get(tag, (default,))[0]
    bands, bits, form = one(SAMPLES, 1), set(tags.get(BITS, (1,))), set(tags.get(FORMAT, (1,)))
    if len(bits) > 1 or len(form) > 1 or next(iter(bits)) % 8 or next(iter(form)) not in FORMATS:
        raise ValueError(f"samples of {sorted(bits)} bits in formats {sorted(form)}: {path}")
    compression = one(COMPRESSION, NONE)
    if compression not in (NONE, DEFLATE, OLD_DEFLATE):
        raise ValueError(f"compression {compression} is not read: {path}")
    height, width = one(HEIGHT, 0), one(WIDTH, 0)
    tiled = TILE_AT in tags
    block = (one(TILE_HEIGHT, 0), one(TILE_WIDTH, 0)) if tiled else (min(one(ROWS, height), height), width)
    transform = None
    if MATRIX in tags:
        m = tags[MATRIX]
        transform = (m[0], m[1], m[3], m[4], m[5], m[7])
    elif SCALE in tags and TIE in tags:
        (sx, sy, _), (i, j, _, x, y, _) = tags[SCALE], tags[TIE][:6]
        transform = (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
    keys = tags.get(GEO_KEYS, ())
    epsg = next((keys[k + 3] for k in range(4, len(keys), 4) if keys[k] in (3072, 2048) and keys[k + 1] == 0), None)
    nodata = tags.get(NODATA, "").strip()
    return Header(
        height, width, bands, f"{order}{FORMATS[form.pop()]}{bits.pop() // 8}", compression, one(PREDICTOR, 1), one(PLANAR, 1) == 2 and bands > 1, block,
        list(tags[TILE_AT if tiled else STRIP_AT]), list(tags[TILE_BYTES if tiled else STRIP_BYTES]), float(nodata) if nodata else None, transform, epsg, tags.get(DESCRIPTION, ""),
    )


def restored(raw: bytes, compression: int, predictor: int, dtype: str, shape: tuple[int, int, int]) -> np.ndarray:
    """A block's samples (rows, columns, bands) from its bytes."""
    h, w, s = shape
    kind = np.dtype(dtype)
    if compression != NONE:
        raw = zlib.decompress(raw)
    if predictor == 3:
        planes = np.frombuffer(raw, np.uint8, h * w * s * kind.itemsize).reshape(h, w * kind.itemsize, s).cumsum(1, dtype=np.uint8).reshape(h, kind.itemsize, w * s)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(h, w, s)
    a = np.frombuffer(raw, kind, h * w * s).reshape(h, w, s)
    return a.cumsum(1, dtype=kind.newbyteorder("=")) if predictor == 2 else a


def packed(a: np.ndarray, compression: int, predictor: int) -> bytes:
    """A block's bytes from its samples (rows, columns) of one band, little-endian: the inverse of restored."""
    h, w = a.shape
    if predictor == 3:
        raw = np.ascontiguousarray(a.astype(a.dtype.newbyteorder(">")).view(np.uint8).reshape(h, w, a.itemsize).transpose(0, 2, 1)).reshape(h, -1)
        raw = np.diff(raw, axis=1, prepend=np.zeros((h, 1), np.uint8)).astype(np.uint8)
    elif predictor == 2:
        raw = np.diff(a, axis=1, prepend=np.zeros((h, 1), a.dtype)).astype(a.dtype.newbyteorder("<"))
    else:
        raw = a.astype(a.dtype.newbyteorder("<"))
    return raw.tobytes() if compression == NONE else zlib.compress(raw.tobytes(), 6)


def block_values(f, h: Header, i: int, j: int, bands: list[int]) -> list[np.ndarray]:
    """The bands (from 0) of a file's block (i, j) of blocks, without what a tile has beyond the border."""
    rows, columns = h.grid()
    # the last strip is short, a tile is not
    height = h.block[0] if columns > 1 or len(h.offsets) != rows * (h.bands if h.apart else 1) or h.block[1] != h.width else min(h.block[0], h.height - i * h.block[0])
    at = i * columns + j
    high, wide = min(h.block[0], h.height - i * h.block[0]), min(h.block[1], h.width - j * h.block[1])

    def block(at: int, samples: int) -> np.ndarray:
        f.seek(h.offsets[at])
        return restored(f.read(h.sizes[at]), h.compression, h.predictor, h.dtype, (height, h.block[1], samples))

    if h.apart:
        return [block(b * rows * columns + at, 1)[:high, :wide, 0] for b in bands]
    whole = block(at, h.bands)
    return [whole[:high, :wide, b] for b in bands]


def masked(v: np.ndarray, nodata: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Samples as doubles, and which of them are none."""
    v = np.ascontiguousarray(v)
    v = v.astype(v.dtype.newbyteorder("="))
    gone = np.isnan(v) if v.dtype.kind == "f" else np.zeros(v.shape, bool)
    if nodata is not None and nodata == nodata:
        gone |= v == nodata
    return v.astype(float), gone


class Blocks(InputPartition):
    def __init__(self, path: str, first_row: int, blocks: list[tuple[int, int]]):
        self.path, self.first_row, self.blocks = path, first_row, blocks


class RasterReader(DataSourceReader):
    def __init__(self, files: list[tuple[str, int]], bands: list[int], rows: tuple[int, int], names: list[str]):
        self.files, self.bands, self.rows, self.names = files, bands, rows, names
        self.columns = (0, 1 << 31)

    def pushFilters(self, filters):
        """Bounds of r and c choose blocks; Spark still checks rows."""
        for f in filters:
            column = getattr(f, "attribute", ())
            if column in (("r",), ("c",)) and isinstance(getattr(f, "value", None), int):
                low, high = self.rows if column == ("r",) else self.columns
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    low = max(low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    high = min(high, f.value + (not isinstance(f, LessThan)))
                if column == ("r",):
                    self.rows = low, high
                else:
                    self.columns = low, high
            yield f

    def partitions(self):
        out = []
        for path, first in self.files:
            h = read_header(path)
            rows, columns = h.grid()
            raw = h.block[0] * h.block[1] * len(self.bands) * np.dtype(h.dtype).itemsize
            wanted = [
                (i, j) for i in range(rows) for j in range(columns)
                if first + i * h.block[0] < self.rows[1] and first + min((i + 1) * h.block[0], h.height) > self.rows[0] and j * h.block[1] < self.columns[1] and (j + 1) * h.block[1] > self.columns[0]
            ]
            step = max(1, PARTITION_BYTES // raw)
            out += [Blocks(path, first, wanted[k : k + step]) for k in range(0, len(wanted), step)]
        return out or [Blocks("", 0, [])]

    def read(self, partition: Blocks):
        if not partition.blocks:
            return
        h = read_header(partition.path)
        system, name = opened(partition.path)
        with system.open_input_file(name) as f:
            for i, j in partition.blocks:
                values = [masked(v, h.nodata) for v in block_values(f, h, i, j, self.bands)]
                high, wide = values[0][0].shape
                r, c = np.mgrid[:high, :wide].astype(np.int32)
                own = [pa.array((r + partition.first_row + i * h.block[0]).ravel()), pa.array((c + j * h.block[1]).ravel())]
                for v, gone in values:
                    own.append(pa.array(v.ravel(), mask=gone.ravel()))
                yield pa.RecordBatch.from_arrays(own, names=["r", "c", *self.names])


class RasterSource(DataSource):
    """Options: path (a file, or a folder of files named part-<first row>.tif), bands (numbers from 1, by comma), names, rows (from:to)."""

    @classmethod
    def name(cls) -> str:
        return "raster"

    def files(self) -> list[tuple[str, int]]:
        path = self.options["path"]
        system, name = opened(path)
        if system.get_file_info(name).is_file:
            return [(path, 0)]
        found = [x.base_name for x in system.get_file_info(fs.FileSelector(name)) if re.fullmatch(r"part-\d+\.tif", x.base_name)]
        if not found:
            raise FileNotFoundError(f"no raster at {path}")
        return sorted((f"{path.rstrip('/')}/{x}", int(x[5:-4])) for x in found)

    def bands(self) -> tuple[list[int], list[str]]:
        h = read_header(self.files()[0][0])
        text, names = self.options.get("bands", ""), self.options.get("names", "") or h.description
        every = names.split(",") if names.count(",") == h.bands - 1 and names else [f"b{i + 1:02d}" for i in range(h.bands)]
        chosen = [int(x) - 1 for x in text.split(",")] if text else list(range(h.bands))
        if any(not 0 <= b < h.bands for b in chosen):
            raise ValueError(f"bands {text} of {h.bands}")
        return chosen, [every[b] for b in chosen]

    def schema(self) -> str:
        return "r int, c int, " + ", ".join(f"`{x}` double" for x in self.bands()[1])

    def reader(self, schema):
        bands, names = self.bands()
        low, _, high = self.options.get("rows", "").partition(":")
        return RasterReader(self.files(), bands, (int(low or 0), int(high or 1 << 31)), names)


def read_raster(spark: SparkSession, path: str, bands: list[int] | None = None, rows: tuple[int, int] | None = None, names: list[str] | None = None) -> DataFrame:
    """r, c and the bands (numbers from 1; all by default) as doubles, null where nodata or NaN. Only blocks with any of rows (from, to,
    the latter not included) are read; where Spark pushes filters to Python sources, also those that where() asks for."""
    spark.dataSource.register(RasterSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("raster").option("bands", ",".join(map(str, bands or []))).option("names", ",".join(names or []))
    found = reader.option("rows", f"{rows[0]}:{rows[1]}" if rows else "").load(path)
    return found.where(F.col("r").between(rows[0], rows[1] - 1)) if rows else found


def header_bytes(meta: dict, bands: list[str], dtype: np.dtype, rows: int, sizes: list[int], compression: int, predictor: int) -> tuple[bytes, list[int]]:
    """Header and directory of a file whose blocks have these sizes, and where each block begins (at multiples of 4)."""
    n = len(bands)
    form = {"u": 1, "i": 2, "f": 3}[dtype.kind]
    tags = {WIDTH: ("I", [meta["width"]]), HEIGHT: ("I", [meta["height"]]), BITS: ("H", [dtype.itemsize * 8] * n), COMPRESSION: ("H", [compression]), PHOTOMETRIC: ("H", [1]), DESCRIPTION: ("s", ",".join(bands).encode() + b"\0")}
    tags |= {SAMPLES: ("H", [n]), ROWS: ("H", [rows]), PLANAR: ("H", [2 if n > 1 else 1]), PREDICTOR: ("H", [predictor]), FORMAT: ("H", [form] * n), STRIP_AT: ("I", [0] * len(sizes)), STRIP_BYTES: ("I", sizes)}
    if meta.get("transform"):
        a, b, c, d, e, f = meta["transform"]
        tags |= {SCALE: ("d", [a, -e, 0.0]), TIE: ("d", [0.0, 0.0, 0.0, c, f, 0.0])} if not (b or d) else {MATRIX: ("d", [a, b, 0.0, c, d, e, 0.0, f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0])}
    if meta.get("epsg"):
        tags[GEO_KEYS] = ("H", [1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, 3072, 0, 1, meta["epsg"]])
    tags[NODATA] = ("s", f"{meta.get('nodata', 'nan')}".encode() + b"\0")
    number = {letter: kind for kind, letter in KINDS.items() if kind != 7}
    extra = 8 + 2 + 12 * len(tags) + 4
    begins, where = {}, extra + extra % 2
    for tag in sorted(tags):
        letter, values = tags[tag]
        size = len(values) if letter == "s" else struct.calcsize("<" + letter) * len(values)
        if size > 4:
            begins[tag] = where
            where += size + size % 2
    at, starts = -(-where // 4) * 4, []
    for size in sizes:
        starts.append(at)
        at += -(-size // 4) * 4
    if at >= 1 << 32:
        raise ValueError("a file of 4 GB or more: write fewer rows to each")
    tags[STRIP_AT] = ("I", starts)
    out = bytearray(starts[0] if starts else where)
    struct.pack_into("<2sHIH", out, 0, b"II", 42, 8, len(tags))
    for k, tag in enumerate(sorted(tags)):
        letter, values = tags[tag]
        raw = values if letter == "s" else struct.pack(f"<{len(values)}{letter}", *values)
        place = 10 + 12 * k
        struct.pack_into("<HHI", out, place, tag, number[letter], len(values))
        if tag in begins:
            struct.pack_into("<I", out, place + 8, begins[tag])
            out[begins[tag] : begins[tag] + len(raw)] = raw
        else:
            out[place + 8 : place + 8 + len(raw)] = raw
    return bytes(out), starts


def write_raster(cells: DataFrame, path: str, bands: list[str], meta: dict, rows: int = 64, file_rows: int = 4096, dtype: str = "float32", compression: int = DEFLATE, predictor: int = 1) -> DataFrame:
    """Write cells (r, c, bands) as files part-<first row>.tif of at most file_rows rows below path: first_row, file, length, sha256.

    meta: height, width and, if known, transform, epsg and nodata (the value of cells that are missing, null or NaN; NaN by
    default, 0 in grids of whole numbers). Strips are made in parallel, each file by one task, which gets its strips
    alone; a file appears under its name when it is whole, so a task that runs again does no harm. Rows of strips divide those
    of files.
    """
    if file_rows % rows or rows > 0xFFFF:
        raise ValueError("rows of a file must be a multiple of those of a strip")
    kind, fill = np.dtype(dtype), meta.get("nodata", float("nan"))
    fill = 0 if kind.kind != "f" and fill != fill else fill
    height, width = meta["height"], meta["width"]

    def strip(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        top = key[0] * rows
        out = []
        for b, name in enumerate(bands):
            a = np.full((min(rows, height - top), width), fill, kind)
            known = pdf[name].notna()
            a[pdf.r[known] - top, pdf.c[known]] = pdf[name][known].to_numpy()
            out.append((key[0] * rows // file_rows, b, key[0], packed(a, compression, predictor)))
        return pd.DataFrame(out, columns=["file", "band", "strip", "raw"])

    inside = cells.where(F.col("r").between(0, height - 1) & F.col("c").between(0, width - 1)).select("r", "c", *bands)
    made = inside.groupBy(F.floor(F.col("r") / rows).cast("int").alias("strip")).applyInPandas(strip, "file int, band int, strip int, raw binary")
    every = cells.sparkSession.range(-(-height // file_rows)).select(F.col("id").cast("int").alias("file"))

    def write(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        import hashlib

        number = int(left.file.iloc[0])
        first = number * file_rows
        high = min(file_rows, height - first)
        strips = -(-high // rows)
        have = {(b, s - first // rows): raw for b, s, raw in zip(right.band, right.strip, right.raw, strict=True)}
        empty: dict = {}

        def raw_of(b: int, s: int) -> bytes:
            size = min(rows, high - s * rows)
            if (b, s) not in have and size not in empty:
                empty[size] = packed(np.full((size, width), fill, kind), compression, predictor)
            return have.get((b, s)) or empty[size]

        blocks = [raw_of(b, s) for b in range(len(bands)) for s in range(strips)]
        t = meta.get("transform")
        own = meta | {"height": high, "nodata": fill, "transform": t and (*t[:2], t[2] + t[1] * first, *t[3:5], t[5] + t[4] * first)}
        head, starts = header_bytes(own, bands, kind, rows, [len(x) for x in blocks], compression, predictor)
        system, name = opened(path)
        system.create_dir(name, recursive=True)
        target, part, h, at = f"{name}/part-{first:08d}.tif", f"{name}/_part-{first:08d}-{np.random.default_rng().integers(1 << 62)}", hashlib.sha256(), 0
        with system.open_output_stream(part) as f:
            for start, raw in zip([0, *starts], [head, *blocks], strict=True):
                raw = bytes(start - at) + raw
                f.write(raw)
                h.update(raw)
                at += len(raw)
        system.move(part, target)
        return pd.DataFrame({"first_row": [first], "file": [target.rsplit("/", 1)[-1]], "length": [at], "sha256": [h.hexdigest()]})

    done = every.groupBy("file").cogroup(made.groupBy("file")).applyInPandas(write, "first_row int, file string, length long, sha256 string")
    return cells.sparkSession.createDataFrame(done.collect(), "first_row int, file string, length long, sha256 string")  # a row for each file


def describe_raster(path: str) -> dict:
    """height, width, bands, dtype, epsg, transform and nodata of a raster; the files of a folder count as one."""
    files = RasterSource({"path": path}).files()
    heads = [read_header(p) for p, _ in files]
    first = heads[0]
    height = max(start + h.height for (_, start), h in zip(files, heads, strict=True))
    return {"height": height, "width": first.width, "bands": first.bands, "dtype": np.dtype(first.dtype).name, "epsg": first.epsg, "transform": first.transform, "nodata": first.nodata}


def same_nodata(a: float | None, b: float | None) -> bool:
    return a == b or (a is not None and b is not None and a != a and b != b)


def window_values(header, files: list[tuple[str, int]], rows: tuple[int, int], columns: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first band in rows and columns (from, to) of a raster's files: its values, where there are none, and where no file has cells.
    header: from a file's path its header."""
    shape = rows[1] - rows[0], columns[1] - columns[0]
    values, none, beyond = np.zeros(shape), np.ones(shape, bool), np.ones(shape, bool)
    for path, first in files:
        if first >= rows[1]:
            continue
        h = header(path)
        low, high = max(rows[0], first) - first, min(rows[1], first + h.height) - first
        if low >= high:
            continue
        system, name = opened(path)
        with system.open_input_file(name) as f:
            for i in range(low // h.block[0], -(-high // h.block[0])):
                for j in range(columns[0] // h.block[1], -(-min(columns[1], h.width) // h.block[1])):
                    v, gone = masked(block_values(f, h, i, j, [0])[0], h.nodata)
                    top, left = first + i * h.block[0] - rows[0], j * h.block[1] - columns[0]
                    to = slice(max(0, top), max(0, top + len(v))), slice(max(0, left), max(0, left + v.shape[1]))
                    own = slice(max(0, -top), max(0, -top) + shape[0] - to[0].start), slice(max(0, -left), max(0, -left) + shape[1] - to[1].start)
                    values[to], none[to], beyond[to] = v[own], gone[own], False
    return values, none, beyond


def compared(spark: SparkSession, path: str, template: str | None, shape: tuple[int, int]):
    """n, none, low, high, inside, outside of the first band of a raster of that shape, the last two against a template of its size (0 without one).

    A task takes windows that hold some blocks of either raster, a window's blocks at once, and gives a row of counts.
    """
    files = RasterSource({"path": path}).files()
    others = RasterSource({"path": template}).files() if template is not None else None
    heads = [read_header(own[0][0]) for own in (files, others) if own]
    height, width = shape
    step = max(h.block[0] for h in heads), max(h.block[1] for h in heads)
    across = -(-width // step[1])

    def near(own: list[tuple[str, int]], rows: tuple[int, int]) -> list[tuple[str, int]]:
        """Files that may have some of rows: those that begin in them, and the last before."""
        k = bisect.bisect_right([first for _, first in own], rows[0])
        return own[max(0, k - 1) : bisect.bisect_left([first for _, first in own], rows[1])]

    def run(batches):
        header = functools.lru_cache(maxsize=16)(read_header)
        n, none, inside, outside, low, high = 0, 0, 0, 0, None, None
        for batch in batches:
            for k in batch.column("id").to_pylist():
                i, j = divmod(k, across)
                rows, columns = (i * step[0], min(height, (i + 1) * step[0])), (j * step[1], min(width, (j + 1) * step[1]))
                v, gone, beyond = window_values(header, near(files, rows), rows, columns)
                met = ~beyond
                if others is not None:
                    _, lacking, beyond = window_values(header, near(others, rows), rows, columns)
                    met &= ~beyond
                    inside += int((met & ~lacking & gone).sum())
                    outside += int((met & lacking & ~gone).sum())
                n += int(met.sum())
                none += int((met & gone).sum())
                known = v[met & ~gone]
                if len(known):
                    low, high = (pick([x for x in (now, edge) if x is not None]) for pick, now, edge in ((min, low, float(known.min())), (max, high, float(known.max()))))
        yield pa.record_batch([pa.array([x], t) for x, t in ((n, pa.int64()), (none, pa.int64()), (inside, pa.int64()), (outside, pa.int64()), (low, pa.float64()), (high, pa.float64()))], ["n", "none", "inside", "outside", "low", "high"])

    windows = -(-height // step[0]) * across
    size = max(1, PARTITION_BYTES // (step[0] * step[1] * 8))
    each = spark.range(0, windows, 1, max(1, -(-windows // size))).mapInArrow(run, "n long, none long, inside long, outside long, low double, high double")
    sums = [F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("n", "none", "inside", "outside")]
    return each.agg(*sums, F.min("low").alias("low"), F.max("high").alias("high")).first()


def failed_raster(spark: SparkSession, path: str, epsg: int, resolution: float, template: str | None = None, slack: float = 0.01, most_missing: float = 0.9, about: float = 1.0) -> tuple[list[str], list[str]]:
    """Names of the rules that a raster of probabilities breaks, and of what is odd but no error.

    Rules: crs (none, or another code), resolution (off by more than about), bands (not one), dtype (not float32), range (a value
    out of 0 to 1, with slack), missing (more than most_missing of its cells have none); against a template also size,
    inside (a cell without a value where the template has one), outside (the reverse) and nodata (another tag). Odd: template_crs,
    template_transform, zero (all values are 0). Headers are read here, cells by one job, which moves only counts.
    """
    d = describe_raster(path)
    t = d["transform"]
    off = t is None or max(abs(abs(t[0]) - resolution), abs(abs(t[4]) - resolution)) > about
    failed = [name for name, bad in (("crs", d["epsg"] != epsg), ("resolution", off), ("bands", d["bands"] != 1), ("dtype", d["dtype"] != "float32")) if bad]
    odd, beside = [], None
    if template is not None:
        other = describe_raster(template)
        odd += [f"template_{name}" for name, key in (("crs", "epsg"), ("transform", "transform")) if d[key] != other[key]]
        if (d["height"], d["width"]) != (other["height"], other["width"]):
            failed.append("size")
        else:
            beside = template
            if not same_nodata(d["nodata"], other["nodata"]):
                failed.append("nodata")
    s = compared(spark, path, beside, (d["height"], d["width"]))
    if s.low is not None and (s.low < -slack or s.high > 1 + slack):
        failed.append("range")
    failed += [name for name, n in (("inside", s.inside), ("outside", s.outside)) if n]
    if s.none > most_missing * s.n:
        failed.append("missing")
    if s.high == 0.0:
        odd.append("zero")
    return failed, odd
