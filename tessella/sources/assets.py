"""Images that documents refer to: where a reference leads, and what is there."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import extract

#: Bytes of an image that is kept, and pixels of one inside a document that is more than decoration.
MOST_BYTES, LEAST_PIXELS = 20 << 20, 32


def target_path(doc: Column, src: Column) -> Column:
    """The path under the root that a reference of a document means; null for other places, data and what leaves the root.

    A leading slash starts at the root, anything else in the document's folder;
    queries and fragments go, percent signs are decoded.
    """
    clean = F.try_url_decode(F.replace(F.regexp_extract(F.trim(src), r"^[^?#]*", 0), F.lit("+"), F.lit("%2B")))
    dirs = F.split(doc, "/")
    base = F.when(clean.startswith("/"), F.array().cast("array<string>")).otherwise(F.slice(dirs, F.lit(1), F.size(dirs) - 1))
    steps = F.concat(base, F.split(clean, "/"))
    up = lambda path: F.when(F.size(path) > 0, F.slice(path, F.lit(1), F.size(path) - 1))  # noqa: E731 -- null above the root
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda path, p: F.when(p.isin("", "."), path).when(p == "..", up(path)).otherwise(F.concat(path, F.array(p))))
    elsewhere = src.contains("://") | F.trim(src).rlike("^(//|mailto:|data:)")
    return F.when(~elsewhere & (F.size(walked) > 0), F.array_join(walked, "/"))


def data_bytes(src: Column) -> Column:
    """The bytes of a base64 data reference, else null."""
    m = F.regexp_extract(F.trim(src), r"(?s)^data:[^,]*;base64,(.*)$", 1)
    return F.when(m != "", F.try_to_binary(F.regexp_replace(m, r"\s+", ""), F.lit("base64")))


def resolved(refs: DataFrame, files: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """refs (doc, src) that lead to an image, with ref_path (empty for data), kind, width, height and size.

    files: rel, size, content of the source's files.  Contents over most bytes
    are not looked at: their kind is that of their name, without a size in
    pixels.
    """
    aimed = refs.withColumn("ref_path", target_path(F.col("doc"), F.col("src"))).withColumn("_data", data_bytes(F.col("src")))
    there = files.select(F.col("rel").alias("ref_path"), F.col("size").alias("_size"), F.when(F.col("size") <= most, F.col("content")).alias("_content"))
    inside = aimed.where("ref_path IS NOT NULL").drop("_data").join(there, "ref_path").select("doc", "src", "ref_path", "_size", "_content")
    carried = aimed.where("_data IS NOT NULL").select("doc", "src", F.lit("").alias("ref_path"), F.octet_length("_data").cast("long").alias("_size"), F.col("_data").alias("_content"))
    names = {"png": "png", "jpg": "jpeg", "jpeg": "jpeg", "gif": "gif", "webp": "webp", "bmp": "bmp", "svg": "svg"}

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [
                (names.get(p.rsplit(".", 1)[-1].lower()), None, None) if c is None else extract.image_size(bytes(c)) or (None, None, None) for p, c in zip(f["ref_path"], f["_content"], strict=True)
            ]
            sizes = pd.DataFrame(found, columns=["kind", "width", "height"]).astype({"width": "Int64", "height": "Int64"})
            yield pd.concat([f[["doc", "src", "ref_path"]].reset_index(drop=True), sizes, f["_size"].rename("size").reset_index(drop=True)], axis=1)

    out = inside.unionByName(carried).mapInPandas(look, "doc string, src string, ref_path string, kind string, width long, height long, size long")
    return out.where("kind IS NOT NULL")


def package_images(files: DataFrame, most: int = MOST_BYTES, least: int = LEAST_PIXELS) -> DataFrame:
    """path, part, kind, width, height, size of the images inside office packages (path, content); small ones are decoration."""

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"], strict=True):
                try:
                    package = zipfile.ZipFile(io.BytesIO(bytes(content)))
                except zipfile.BadZipFile:
                    continue
                for part in package.infolist():
                    if part.file_size > most or not any(f"/{d}/" in f"/{part.filename}" for d in ("media", "Pictures")):
                        continue
                    found = extract.image_size(package.read(part))
                    if found and min(found[1] or least, found[2] or least) >= least:
                        rows.append((path, part.filename, *found, part.file_size))
            yield pd.DataFrame(rows, columns=["path", "part", "kind", "width", "height", "size"]).astype({"width": "Int64", "height": "Int64"})

    return files.select("path", "content").mapInPandas(look, "path string, part string, kind string, width long, height long, size long")

