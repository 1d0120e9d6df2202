"""TIFF rasters as a Spark source that reads strips or tiles in parallel, and sinks for TIFF and PNG files.

Files are opened by pyarrow's file systems (local folders, HDFS, S3, GCS, by the path's scheme).
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..operators import dataset, tiles

#: Numbers of the TIFF tags that are read or written, and of its compressions, sample kinds and field types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, KIND = 322, 323, 324, 325, 339
PLAIN, DEFLATE = (1,), (8, 32946)
KINDS = {1: "u", 2: "i", 3: "f"}
FIELD = {1: "B", 3: "H", 4: "I", 16: "Q"}

PIXELS = "path string, band int, y int, x int, v double"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


def _tags(f) -> tuple[str, dict[int, tuple]]:
    """Byte order and tags of the first image of an open file."""
    head = f.read_at(16, 0)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack(f"{order}H", head[2:4])[0] if order else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    big = version == 43
    at = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
    n = struct.unpack(order + ("Q" if big else "H"), f.read_at(8 if big else 2, at))[0]
    at, size, wide = at + (8 if big else 2), 20 if big else 12, 8 if big else 4
    entries, found = f.read_at(n * size, at), {}
    for i in range(n):
        tag, kind = struct.unpack(f"{order}HH", entries[i * size : i * size + 4])
        count = struct.unpack(order + ("Q" if big else "I"), entries[i * size + 4 : i * size + 4 + wide])[0]
        if kind not in FIELD:
            continue
        value, need = entries[i * size + 4 + wide : (i + 1) * size], count * struct.calcsize(FIELD[kind])
        if need > wide:
            value = f.read_at(need, struct.unpack(order + ("Q" if big else "I"), value)[0])
        found[tag] = struct.unpack(f"{order}{count}{FIELD[kind]}", value[:need])
    return order, found


class _Part(InputPartition):
    """Strips or tiles of one file: (y, x, offset, bytes) each."""

    def __init__(self, path: str, layout: dict, pieces: list[tuple[int, int, int, int]]):
        self.path, self.layout, self.pieces = path, layout, pieces


class _Files(InputPartition):
    """Whole files, whose heads the task reads."""

    def __init__(self, paths: list[str]):
        self.paths = paths


#: Bytes that opening a file counts for, so that a task reads some files and not thousands.
OPEN_BYTES = 128 << 10


def _layout(path: str) -> tuple[dict, list[tuple[int, int, int, int]]]:
    system, inner = _opened(path)
    with system.open_input_file(inner) as f:
        order, tags = _tags(f)
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, samples, bits, kind = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(BITS, 1), one(KIND, 1)
    if one(COMPRESSION, 1) not in PLAIN + DEFLATE or bits not in (8, 16, 32, 64) or kind not in KINDS or one(PREDICTOR, 1) not in (1, 2) or (one(PLANAR, 1) != 1 and samples > 1):
        raise ValueError(f"{path}: only whole-byte samples, together, plain or deflated, are read")
    if one(PREDICTOR, 1) == 2 and kind == 3:
        raise ValueError(f"{path}: differences of floats aren't read")
    w, h = one(TILE_WIDTH, width), one(TILE_HEIGHT, min(one(ROWS, height), height))
    across = -(-width // w) if width else 0
    layout = {"width": width, "height": height, "samples": samples, "type": f"{order}{KINDS[kind]}{bits // 8}", "deflated": one(COMPRESSION, 1) in DEFLATE, "differences": one(PREDICTOR, 1) == 2, "w": w, "h": h}
    places = zip(tags.get(TILE_OFFSETS, tags.get(OFFSETS, ())), tags.get(TILE_COUNTS, tags.get(COUNTS, ())))
    return layout, [(i // across * h, i % across * w, at, n) for i, (at, n) in enumerate(places)]


class TiffReader(DataSourceReader):
    def __init__(self, path: str, part_bytes: int):
        self.path, self.part_bytes = path, part_bytes

    def partitions(self):
        """About part_bytes of file each; the driver reads the heads of larger files only, and small files go many to a task."""
        system, inner = _opened(self.path)
        lead = self.path[: len(self.path) - len(inner)] if self.path.endswith(inner) else ""
        info = system.get_file_info(inner)
        files = [info] if info.is_file else sorted((x for x in system.get_file_info(fs.FileSelector(inner, recursive=True)) if x.is_file and x.extension.lower() in ("tif", "tiff")), key=lambda x: x.path)
        parts, few, weight = [], [], 0
        for name, bytes_ in ((x.path, x.size) for x in files):
            if bytes_ <= self.part_bytes:
                few.append(lead + name)
                weight += bytes_ + OPEN_BYTES
                if weight >= self.part_bytes:
                    parts.append(_Files(few))
                    few, weight = [], 0
                continue
            layout, pieces = _layout(lead + name)
            held, size = [], 0
            for p in pieces:
                held.append(p)
                size += p[3]
                if size >= self.part_bytes:
                    parts.append(_Part(lead + name, layout, held))
                    held, size = [], 0
            if held:
                parts.append(_Part(lead + name, layout, held))
        return [*parts, *([_Files(few)] if few else [])]

    def read(self, partition):
        for part in [partition] if isinstance(partition, _Part) else (_Part(path, *_layout(path)) for path in partition.paths):
            yield from self._read(part)

    def _read(self, partition):
        m = partition.layout
        system, inner = _opened(partition.path)
        with system.open_input_file(inner) as f:
            for y, x, at, n in partition.pieces:
                data = f.read_at(n, at)
                flat = np.frombuffer(zlib.decompress(data) if m["deflated"] else data, m["type"])
                rows = min(m["h"], len(flat) // (m["w"] * m["samples"]))
                block = flat[: rows * m["w"] * m["samples"]].reshape(rows, m["w"], m["samples"])
                if m["differences"]:
                    block = np.cumsum(block, axis=1, dtype=block.dtype)
                yield from self.rows(partition.path, y, x, block[: m["height"] - y, : m["width"] - x].astype("float64"))  # tiles may reach over the edge

    def rows(self, path: str, y: int, x: int, block: np.ndarray):
        ys, xs = np.indices(block.shape[:2], dtype="int32")
        for band in range(block.shape[2]):
            size = ys.size
            yield pa.RecordBatch.from_arrays([pa.repeat(path, size), pa.array(np.full(size, band, "int32")), pa.array((ys + np.int32(y)).ravel()), pa.array((xs + np.int32(x)).ravel()), pa.array(block[:, :, band].ravel())], names=["path", "band", "y", "x", "v"])


class TileReader(TiffReader):
    """Pixels other than 0 of files that write_tiff_tiles() wrote, in the raster's places; their names are looked at once a piece."""

    def rows(self, path, y, x, block):
        found = re.search(r"([^/_]+)_(\d+)_(\d+)\.tif$", path)
        raster, ty, tx = (int(g) for g in found.groups()) if found and re.fullmatch(r"-?\d+", found[1]) else (None, None, None)
        ys, xs, band = np.nonzero(block != 0)
        place = [pa.nulls(len(ys), pa.int32()) if at is None else pa.array((c + (at + first)).astype("int32")) for c, at, first in ((ys, ty, y), (xs, tx, x))]
        rid = pa.nulls(len(ys), pa.int32()) if raster is None else pa.array(np.full(len(ys), raster, "int32"))
        yield pa.RecordBatch.from_arrays([rid, *place, pa.array(block[ys, xs, band])], names=["raster_id", "y", "x", "v"])


class TiffSource(DataSource):
    """spark.read.format("tiff").load(path): pixels (path, band, y, x, v) of a file or of all .tif and .tiff files under a folder."""

    @classmethod
    def name(cls):
        return "tiff"

    def schema(self):
        return PIXELS

    def reader(self, schema):
        return TiffReader(self.options["path"], int(self.options.get("partBytes", 4 << 20)))


class TileSource(TiffSource):
    """spark.read.format("tiff_tiles").load(path): the raster that write_tiff_tiles() wrote."""

    @classmethod
    def name(cls):
        return "tiff_tiles"

    def schema(self):
        return "raster_id int, y int, x int, v double"

    def reader(self, schema):
        return TileReader(self.options["path"], int(self.options.get("partBytes", 4 << 20)))


class FileWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator):
        system, inner = _opened(self.path)
        made = set()
        for row in iterator:
            target = f"{inner.rstrip('/')}/{row['file']}"
            if (folder := target.rpartition("/")[0]) not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            with system.open_output_stream(target) as out:  # a task that runs again writes the same bytes
                out.write(row["content"])
        return WriterCommitMessage()


class FileSink(DataSource):
    """df.write.format("files").save(path): rows (file, content), each a file under the path."""

    @classmethod
    def name(cls):
        return "files"

    def writer(self, schema, overwrite):
        return FileWriter(self.options["path"])


def read_tiff(spark: SparkSession, path: str) -> DataFrame:
    """(path, band, y, x, v) of TIFF files; zeros are pixels, too."""
    spark.dataSource.register(TiffSource)
    return spark.read.format("tiff").load(path)


def write_files(rows: DataFrame, path: str) -> None:
    rows.sparkSession.dataSource.register(FileSink)
    rows.select("file", "content").write.format("files").mode("append").save(path)


def tiff_bytes(a: np.ndarray, strip_rows: int = 64, order: str = "<", tile: int | None = None, differences: bool = False, deflate: bool = True) -> bytes:
    """A TIFF file of an array (height, width) or (height, width, samples), in strips, or in tiles."""
    a = a if a.ndim == 3 else a[:, :, None]
    height, width, samples = a.shape
    a = a.astype(a.dtype.newbyteorder(order))
    h, w = (tile, tile) if tile else (min(strip_rows, height), width)
    pieces = []
    for y in range(0, height, h):
        for x in range(0, width, w):
            block = a[y : y + h, x : x + w]
            if tile:
                block = np.pad(block, [(0, h - block.shape[0]), (0, w - block.shape[1]), (0, 0)])
            if differences:
                block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
            block = block.astype(a.dtype)  # joining arrays loses the byte order
            pieces.append(zlib.compress(block.tobytes()) if deflate else block.tobytes())
    kind = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
    offsets = 8 + np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
    places = [(OFFSETS if not tile else TILE_OFFSETS, 4, offsets[:-1].tolist()), (COUNTS if not tile else TILE_COUNTS, 4, [len(p) for p in pieces])]
    shape = [(TILE_WIDTH, 4, [w]), (TILE_HEIGHT, 4, [h])] if tile else [(ROWS, 4, [h])]
    entries = sorted([(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [a.dtype.itemsize * 8] * samples), (COMPRESSION, 3, [8 if deflate else 1]), (PHOTOMETRIC, 3, [2 if samples == 3 else 1]), (SAMPLES, 3, [samples]), (PREDICTOR, 3, [2 if differences else 1]), (KIND, 3, [kind] * samples), *places, *shape])
    at, more, table = int(offsets[-1]), b"", b""
    start = at + 2 + 12 * len(entries) + 4
    for tag, field, values in entries:
        value = struct.pack(f"{order}{len(values)}{FIELD[field]}", *values)
        if len(value) > 4:
            value, more = struct.pack(f"{order}I", start + len(more)), more + value
        table += struct.pack(f"{order}HHI", tag, field, len(values)) + value.ljust(4, b"\0")
    head = (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, at)
    return head + b"".join(pieces) + struct.pack(f"{order}H", len(entries)) + table + struct.pack(f"{order}I", 0) + more


def png_bytes(a: np.ndarray) -> bytes:
    """A PNG file of bytes (height, width, 3)."""
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    height, width, _ = a.shape
    lines = b"".join(b"\0" + row.tobytes() for row in a.astype("uint8"))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def write_tiff_tiles(p: DataFrame, path: str, tile: int = 512) -> None:
    """A raster as files of tile x tile pixels, named raster_y_x.tif by their first pixel; absent pixels are 0."""

    def packed(table: pa.Table) -> pa.Table:
        rid, ty, tx = (table.column(c)[0].as_py() for c in ("raster_id", "ty", "tx"))
        a, cells = np.zeros((tile, tile)), tiles.unpacked(table.column("cells"))
        a[cells["y"] - ty * tile, cells["x"] - tx * tile] = cells["v"]
        return pa.table({"file": [f"{rid}_{ty * tile}_{tx * tile}.tif"], "content": [tiff_bytes(a)]})

    cells = p.select("raster_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("v").cast("double").alias("v")).where("y IS NOT NULL AND x IS NOT NULL")
    blocks = tiles.packed(cells, lambda axis, c: (c // tile, c // tile))
    write_files(blocks.groupBy("raster_id", "ty", "tx").applyInArrow(packed, "file string, content binary"), path)


def read_tiff_tiles(spark: SparkSession, path: str) -> DataFrame:
    """The raster that write_tiff_tiles() wrote: (raster_id, y, x, v) of pixels other than 0."""
    spark.dataSource.register(TileSource)
    return spark.read.format("tiff_tiles").load(path)


def write_patch_images(patches: DataFrame, key: list[str], path: str) -> None:
    """Patches (site, cls, key, px, py, r, g, b) as PNG files, in a folder for each site and class; names are as list_patches() reads them, but for their ending."""

    def packed(table: pa.Table) -> pa.Table:
        x, y = (table.column(c).to_numpy() for c in ("px", "py"))
        a = np.zeros((int(y.max()) + 1, int(x.max()) + 1, 3), "uint8")
        a[y, x] = np.stack([table.column(c).to_numpy() for c in "rgb"], axis=1)
        site, cls, *ids = (table.column(c)[0].as_py() for c in ("site", "cls", *key))
        return pa.table({"file": [f"site={site}/cls={cls}/SP{cls}PATCH{'_'.join(map(str, ids))}.png"], "content": [png_bytes(a)]})

    write_files(patches.groupBy("site", "cls", *key).applyInArrow(packed, "file string, content binary"), path)


def write_box_images(pixels: DataFrame, boxes: DataFrame, key: str, size: int, path: str) -> None:
    """write_patch_images() with raster_id and key of the patches of boxes (raster_id, key, site, cls, y0, x0), made where their pixels' tile is, so patches aren't shuffled."""
    file = F.concat(F.lit("site="), F.col("site").cast("string"), F.lit("/cls="), "cls", F.lit("/SP"), "cls", F.lit("PATCH"), F.col("raster_id").cast("string"), F.lit("_"), F.col(key).cast("string"), F.lit(".png"))
    named = boxes.select("raster_id", file.alias("file"), "y0", "x0")
    # Bytes of the three colours in one number, as a file holds them.
    byte = lambda c: F.pmod(F.col(c).cast("long"), F.lit(256))
    colours = pixels.select("raster_id", "y", "x", (byte("r") * 65536 + byte("g") * 256 + byte("b")).alias("rgb"))

    def made(a):
        there = ~np.isnan(a[:, 0]).reshape(-1, size, size)
        v = np.nan_to_num(a[:, 0]).astype("int64").reshape(-1, size, size)
        rgb = np.stack([v >> 16, v >> 8 & 255, v & 255], axis=3).astype("uint8")
        # A patch reaches to its last pixel.
        high, wide = (size - there.any(axis=k)[:, ::-1].argmax(axis=1) for k in (2, 1))
        return {"content": pa.array([png_bytes(i[:h, :w]) for i, h, w in zip(rgb, high.tolist(), wide.tolist())], pa.binary())}

    write_files(dataset.on_boxes(colours, named, "file", size, ("rgb",), made, "content binary"), path)


def png_array(data: bytes) -> np.ndarray:
    """The bytes (height, width, samples) of a PNG file of 8 bits, gray or coloured, with or without alpha; others are refused."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, packed = 8, []
    while at < len(data):
        n = struct.unpack(">I", data[at : at + 4])[0]
        name, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        at += 12 + n
        if name == b"IHDR":
            width, height, bits, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
            if bits != 8 or colour not in PNG_SAMPLES or interlaced:
                raise ValueError("only whole-byte PNG files without a palette, not interlaced, are read")
        elif name == b"IDAT":
            packed.append(body)
    n = PNG_SAMPLES[colour]
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), "uint8").reshape(height, 1 + width * n)
    out = lines[:, 1:].reshape(height, width, n).copy()
    for y in np.flatnonzero(lines[:, 0]).tolist() if lines[:, 0].any() else ():
        kind, row, up = lines[y, 0], out[y], out[y - 1] if y else np.zeros_like(out[y])
        if kind == 1:
            out[y] = np.cumsum(row, axis=0, dtype="uint8")
        elif kind == 2:
            out[y] = row + up
        else:
            left, corner = np.zeros(n, int), np.zeros(n, int)
            for x in range(width):
                above = up[x].astype(int)
                if kind == 3:
                    guess = (left + above) // 2
                else:
                    p = left + above - corner
                    a, b, c = abs(p - left), abs(p - above), abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))
                left, corner = (row[x] + guess) & 255, above
                out[y, x] = left
    return out


#: Samples of a pixel by a PNG file's kind of colour.
PNG_SAMPLES = {0: 1, 2: 3, 4: 2, 6: 4}


class PngReader(DataSourceReader):
    def __init__(self, path: str, files: int):
        self.path, self.files = path, files

    def partitions(self):
        system, inner = _opened(self.path)
        lead = self.path[: len(self.path) - len(inner)] if self.path.endswith(inner) else ""
        info = system.get_file_info(inner)
        names = [lead + x.path for x in ([info] if info.is_file else system.get_file_info(fs.FileSelector(inner, recursive=True))) if x.is_file and x.extension.lower() == "png"]
        return [_Files(sorted(names[i : i + self.files])) for i in range(0, len(names), self.files)]

    def read(self, partition):
        for i in range(0, len(partition.paths), 100):
            rows = []
            for path in partition.paths[i : i + 100]:
                system, inner = _opened(path)
                with system.open_input_file(inner) as f:
                    a = png_array(f.read())
                rows.append((path, *a.shape, a.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["path", "height", "width", "samples", "data"])


class PngSource(DataSource):
    """spark.read.format("png_images").load(path): (path, height, width, samples, data) of a file or of all .png files under a folder, many to a task, which reads them."""

    @classmethod
    def name(cls):
        return "png_images"

    def schema(self):
        return "path string, height int, width int, samples int, data binary"

    def reader(self, schema):
        return PngReader(self.options["path"], int(self.options.get("files", 4000)))


def png_sums(spark: SparkSession, path: str) -> DataFrame:
    """(path, n, r, gx, by) of each PNG file under a folder: its pixels, and sums of red, of green times x and of blue times y."""
    spark.dataSource.register(PngSource)

    def run(batches):
        for b in batches:
            found = []
            for height, width, n, data in zip(*(b.column(c).to_pylist() for c in ("height", "width", "samples", "data"))):
                a = np.frombuffer(data, "uint8").reshape(height, width, n).astype("int64")
                r, g, blue = (a[:, :, c] for c in ((0, 1, 2) if n >= 3 else (0, 0, 0)))
                found.append((height * width, int(r.sum()), int(g.sum(axis=0) @ np.arange(width)), int(blue.sum(axis=1) @ np.arange(height))))
            yield pa.RecordBatch.from_arrays([b.column("path"), *(pa.array(c, pa.int64()) for c in zip(*found))] if found else [b.column("path"), *[pa.array([], pa.int64())] * 4], names=["path", "n", "r", "gx", "by"])

    return spark.read.format("png_images").load(path).mapInArrow(run, "path string, n long, r long, gx long, by long")
