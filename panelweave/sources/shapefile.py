"""A shapefile source and sink, from the published format description."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.geometry import POLYGON
from .tables import check_field_names, list_files

SIDECARS = (".shp", ".dbf", ".shx", ".prj")


def parse_shp(data: bytes) -> list[list[list[tuple[float, float]]] | None]:
    """Rings of each record; only null shapes and polygons are accepted."""
    if struct.unpack(">i", data[:4])[0] != 9994 or struct.unpack("<i", data[32:36])[0] != 5:
        raise ValueError("no polygon shapefile")
    out, at = [], 100
    while at < len(data):
        _, words = struct.unpack(">2i", data[at : at + 8])
        body = data[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        kind = struct.unpack("<i", body[:4])[0]
        if kind == 0:
            out.append(None)
            continue
        if kind != 5:
            raise ValueError(f"shape type {kind}")
        parts, n = struct.unpack("<2i", body[36:44])
        starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), n]
        xy = struct.unpack(f"<{2 * n}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * n])
        pts = list(zip(xy[::2], xy[1::2], strict=True))
        out.append([pts[a:b] for a, b in zip(starts, starts[1:], strict=False)])
    return out


def parse_dbf(data: bytes, encoding: str = "utf-8") -> tuple[list[str], list[list]]:
    n, head, width = struct.unpack("<IHH", data[4:12])
    fields, at = [], 32
    while data[at] != 0x0D:
        name, kind, size, dec = data[at : at + 11].split(b"\0")[0].decode(), chr(data[at + 11]), data[at + 16], data[at + 17]
        fields.append((name, kind, size, dec))
        at += 32
    rows = []
    for i in range(n):
        rec, pos, row = data[head + i * width : head + (i + 1) * width], 1, []
        for _, kind, size, dec in fields:
            text = rec[pos : pos + size].decode(encoding).strip()
            pos += size
            row.append(None if text == "" else (float(text) if dec else int(text)) if kind in "NF" else text)
        rows.append(row)
    return [f[0] for f in fields], rows


class _Reader(DataSourceReader):
    def __init__(self, path: str, fields: list[str]):
        self.path, self.fields = path, fields

    def partitions(self):
        return [InputPartition(self.path)]

    def read(self, partition):
        import pyarrow.fs as pafs

        fs, base = pafs.FileSystem.from_uri(partition.value if "://" in partition.value else "file://" + partition.value)
        load = lambda ext: fs.open_input_file(base[:-4] + ext).read()
        names, rows = parse_dbf(load(".dbf"))
        for poly, row in zip(parse_shp(load(".shp")), rows, strict=True):
            by = dict(zip(names, row, strict=True))
            yield (*[None if by[f] is None else str(by[f]) for f in self.fields], None if poly is None else [[(x, y) for x, y in ring] for ring in poly])


class ShapefileSource(DataSource):
    """``spark.read.format("shapefile")``; options path and fields (comma-separated attributes, read as strings)."""

    @classmethod
    def name(cls):
        return "shapefile"

    def schema(self):
        fields = [f for f in self.options.get("fields", "").split(",") if f]
        return T.StructType([*[T.StructField(f, T.StringType()) for f in fields], T.StructField("polygon", POLYGON)])

    def reader(self, schema):
        return _Reader(self.options["path"], [f.name for f in schema.fields if f.name != "polygon"])


def read_shapefile(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """Polygons with their attributes. All four files must be there, and at least one record."""
    missing = [e for e in SIDECARS if not list_files(spark, path[:-4] + e)]
    if missing:
        raise ValueError(f"{path}: without {missing}")
    spark.dataSource.register(ShapefileSource)
    df = spark.read.format("shapefile").option("fields", ",".join(fields)).load(path)
    if df.isEmpty():
        raise ValueError(f"{path}: no records")
    return df


def shapefile_bytes(rows: list[tuple], fields: list[str], prj: str) -> dict[str, bytes]:
    """The four files of (attributes..., polygon) rows, all attributes as text of up to 254 bytes."""
    bad = check_field_names(fields)
    if bad:
        raise ValueError("; ".join(bad))
    shp, shx, at, box = b"", b"", 50, [float("inf"), float("inf"), float("-inf"), float("-inf")]
    for i, row in enumerate(rows, 1):
        rings = [[(p["x"], p["y"]) if not isinstance(p, tuple) else p for p in r] for r in row[-1]]
        pts = [p for r in rings for p in r]
        b = [min(p[0] for p in pts), min(p[1] for p in pts), max(p[0] for p in pts), max(p[1] for p in pts)]
        box = [min(box[0], b[0]), min(box[1], b[1]), max(box[2], b[2]), max(box[3], b[3])]
        starts = [sum(map(len, rings[:k])) for k in range(len(rings))]
        body = struct.pack("<i4d2i", 5, *b, len(rings), len(pts)) + struct.pack(f"<{len(rings)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in pts)
        shx += struct.pack(">2i", at, len(body) // 2)
        shp += struct.pack(">2i", i, len(body) // 2) + body
        at += 4 + len(body) // 2
    head = lambda n: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, n) + struct.pack("<2i", 1000, 5) + struct.pack("<8d", *(box if rows else [0] * 4), 0, 0, 0, 0)
    texts = [["" if v is None else str(v) for v in r[:-1]] for r in rows]
    widths = [min(254, max([1, *[len(t[k].encode()) for t in texts]])) for k in range(len(fields))]
    desc = b"".join(f.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([w, 0]) + b"\0" * 14 for f, w in zip(fields, widths, strict=True))
    dbf = struct.pack("<4BIHH20x", 3, 124, 1, 1, len(rows), 33 + len(desc), 1 + sum(widths)) + desc + b"\r"
    dbf += b"".join(b" " + b"".join(t.encode()[:w].ljust(w) for t, w in zip(r, widths, strict=True)) for r in texts) + b"\x1a"
    return {".shp": head(50 + len(shp) // 2) + shp, ".shx": head(50 + len(shx) // 2) + shx, ".dbf": dbf, ".prj": prj.encode(), ".cpg": b"UTF-8"}


def write_shapefile(df: DataFrame, path: str, fields: list[str], prj: str, most_rows: int = 100_000) -> None:
    """For unit layers: at most ``most_rows`` polygons, written by the driver."""
    rows = [tuple(r) for r in df.select(*fields, "polygon").limit(most_rows + 1).collect()]
    if len(rows) > most_rows:
        raise ValueError(f"over {most_rows} polygons")
    for ext, data in shapefile_bytes(rows, fields, prj).items():
        with open(path[:-4] + ext, "wb") as f:
            f.write(data)


def polygon_from_wkt(text):
    """A POLYGON's WKT as rings, in SQL functions."""
    rings = F.regexp_extract_all(text, F.lit(r"\(([^()]+)\)"), F.lit(1))
    point = lambda p: F.struct(F.element_at(F.split(F.trim(p), r"\s+"), 1).cast("double").alias("x"), F.element_at(F.split(F.trim(p), r"\s+"), 2).cast("double").alias("y"))
    return F.transform(rings, lambda r: F.transform(F.split(r, ","), point))
