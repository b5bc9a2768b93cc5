"""NIfTI-1 images as rows, and manifests of image and label pairs."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: data type codes of the format
TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
SCHEMA = "path string, shape array<int>, spacing array<double>, affine array<double>, dtype string, img array<float>"


def parse(data: bytes) -> tuple[np.ndarray, list[float], np.ndarray]:
    """Array (z, y, x, and t or channel first if there are any), spacing in x, y, z and the 4x4 affine."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    end = "<" if struct.unpack_from("<i", data)[0] == 348 else ">"
    if struct.unpack_from(end + "i", data)[0] != 348 or data[344:347] not in (b"n+1", b"ni1"):
        raise ValueError("not a NIfTI-1 file")
    dim = struct.unpack_from(end + "8h", data, 40)
    code, pix = struct.unpack_from(end + "h", data, 70)[0], struct.unpack_from(end + "8f", data, 76)
    if code not in TYPES:
        raise ValueError(f"data type {code} is not supported")
    offset, slope, inter = struct.unpack_from(end + "3f", data, 108)
    qform, sform = struct.unpack_from(end + "2h", data, 252)
    shape = [max(1, n) for n in dim[1 : 1 + dim[0]]]
    v = np.frombuffer(data, np.dtype(end + TYPES[code]), int(np.prod(shape)), int(offset)).reshape(shape[::-1])
    if slope and (slope, inter) != (1, 0):
        v = v * slope + inter
    m = np.eye(4)
    if sform > 0:
        m[:3] = np.array(struct.unpack_from(end + "12f", data, 280)).reshape(3, 4)
    elif qform > 0:
        b, c, d, x, y, z = struct.unpack_from(end + "6f", data, 256)
        a = np.sqrt(max(0.0, 1 - b * b - c * c - d * d))
        turn = np.array([[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)], [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)], [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - c * c - b * b]])
        m[:3, :3] = turn * np.array([pix[1], pix[2], pix[3] * (pix[0] if pix[0] else 1)])
        m[:3, 3] = x, y, z
    else:
        m[:3, :3] = np.diag(pix[1:4])
    return v, [float(p) for p in pix[1:4]], m


def encode(v: np.ndarray, affine: np.ndarray | None = None, compress: bool = False) -> bytes:
    """A NIfTI-1 file of an array whose last axes are z, y, x."""
    code = next((c for c, t in TYPES.items() if np.dtype(t) == v.dtype.newbyteorder("=")), None)
    if code is None:
        raise ValueError(f"{v.dtype} is not supported")
    m = np.eye(4) if affine is None else np.asarray(affine, float).reshape(4, 4)
    dims, pix = v.shape[::-1], np.sqrt((m[:3, :3] ** 2).sum(0))
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, len(dims), *dims, *[1] * (7 - len(dims)))
    struct.pack_into("<2h", head, 70, code, v.dtype.itemsize * 8)
    struct.pack_into("<8f", head, 76, 1, *pix, 1, 1, 1, 1)
    struct.pack_into("<3f", head, 108, 352, 1, 0)
    struct.pack_into("<2h", head, 252, 0, 1)
    struct.pack_into("<12f", head, 280, *m[:3].ravel())
    head[344:348] = b"n+1\0"
    out = bytes(head) + np.ascontiguousarray(v).astype(v.dtype.newbyteorder("<")).tobytes()
    return gzip.compress(out) if compress else out


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per .nii or .nii.gz file under a path that Spark's readers open; one file per task step."""
    from ..functions import ship

    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v, spacing, m = parse(content)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([list(v.shape)], pa.list_(pa.int32())), pa.array([spacing]), pa.array([m.ravel().tolist()]), pa.array([str(v.dtype)]), pa.array([v.astype(np.float32).ravel()], pa.list_(pa.float32()))], ["path", "shape", "spacing", "affine", "dtype", "img"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.nii*").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, SCHEMA)


def manifest(spark: SparkSession, path: str, split: str) -> tuple[DataFrame, DataFrame]:
    """Image and label pairs of a split of a JSON manifest, and those with a missing file.

    Presence is decided against one listing of the data folder, as a join.
    """
    doc = spark.read.option("multiLine", True).json(path)
    if doc.select("TYPE").first()[0] != "LABEL":
        raise ValueError("the manifest's TYPE must be LABEL")
    root = F.regexp_replace(F.coalesce(F.col("DATASETS_PATH"), F.lit("")), "/$", "")
    pairs = doc.select(root.alias("root"), F.explode(split).alias("p")).select(F.concat_ws("/", "root", "p.IMAGE").alias("image"), F.concat_ws("/", "root", "p.LABEL").alias("label"))
    where = doc.select(root).first()[0]
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(where).select(F.regexp_replace("path", "^file:/*", "/").alias("f"))
    found = pairs.join(there.withColumnRenamed("f", "image"), "image", "left_semi").join(there.withColumnRenamed("f", "label"), "label", "left_semi").select("image", "label")
    return found, pairs.join(found, ["image", "label"], "left_anti")


def write(df: DataFrame, folder: str, name: str = "path", compress: bool = True) -> DataFrame:
    """Write one file per row into a folder; returns (path, bytes) of what is written. Files are written when that table is read; again is the same.

    df: `name` (file name, without a suffix), shape array<int> (z, y, x), img, and if there are any affine array<double> and dtype. Rows of
    one name overwrite each other. A task writes to a hidden name first and renames, so a lost task leaves no half file.
    """
    from ..functions import ship

    spark = df.sparkSession
    ship(spark)
    suffix = ".nii.gz" if compress else ".nii"
    cols = [F.col(name).alias("name"), "shape", F.col("img").cast("array<double>").alias("img"), F.col("affine") if "affine" in df.columns else F.lit(None).cast("array<double>").alias("affine"), F.col("dtype") if "dtype" in df.columns else F.lit("float32").alias("dtype")]

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        made = set()
        for b in batches:
            for i in range(b.num_rows):
                key, shape, affine, dtype = (b.column(c)[i].as_py() for c in ("name", "shape", "affine", "dtype"))
                v = b.column("img")[i].values.to_numpy(zero_copy_only=False).reshape(shape)
                v = (np.round(v) if np.dtype(dtype).kind in "iu" else v).astype(dtype)
                data, target = encode(v, affine, compress), f"{root}/{key}{suffix}"
                parent, last = target.rsplit("/", 1)
                part = f"{parent}/.{last}.part"
                if parent not in made:
                    where.create_dir(parent, recursive=True)
                    made.add(parent)
                with where.open_output_stream(part) as f:
                    f.write(data)
                where.move(part, target)
                yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([len(data)], pa.int64())], ["path", "bytes"])

    return df.select(*cols).mapInArrow(files, "path string, bytes long")


def write_pairs(volumes: DataFrame, folder: str) -> DataFrame:
    """Image and label files of a table of volumes, channel by channel: images/<sample>_<channel> and labels/<sample>."""
    flat = volumes.where("img is not null").select("sample_id", "shape", "img", "seg")
    size = F.col("shape.d") * F.col("shape.h") * F.col("shape.w")
    shape = F.array("shape.d", "shape.h", "shape.w").alias("shape")
    images = flat.select("sample_id", "shape", "img", F.explode(F.sequence(F.lit(0), F.col("shape.c") - 1)).alias("c"))
    images = images.select(F.concat(F.lit("images/"), F.col("sample_id").cast("string"), F.lit("_"), F.lpad(F.col("c").cast("string"), 4, "0")).alias("path"), shape, F.slice("img", (F.col("c") * size + 1).cast("int"), size.cast("int")).cast("array<double>").alias("img"), F.lit("float32").alias("dtype"))
    labels = flat.where("seg is not null").select(F.concat(F.lit("labels/"), F.col("sample_id").cast("string")).alias("path"), shape, F.col("seg").cast("array<double>").alias("img"), F.lit("int32").alias("dtype"))
    return write(images.unionByName(labels), folder)
