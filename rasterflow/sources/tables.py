"""Sources and sinks. Array formats of single files are not decoded; inputs are tables."""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import patch_name
from ..functions.frames import fresh, written


def list_patches(spark: SparkSession, folder: str, pattern: str = "*.nc", limit: int | None = None) -> DataFrame:
    """``path`` (relative to ``folder``) of files anywhere below it, with the parts of their names.

    Folders are listed by tasks, level by level: each level's folders are a written table,
    so neither they nor the files pass through the driver. The pattern is applied where a
    folder is listed. Contents are never read. With ``limit`` only the first paths are kept.
    """
    level = written(spark.createDataFrame([("",)], "path string"), "folders")
    found = None
    while not level.isEmpty():
        listed = written(level.repartition("path").mapInArrow(_list_folders(folder.rstrip("/"), pattern), "path string, folder boolean"), "listed")
        files = listed.where("not folder").select("path")
        found = files if found is None else found.unionAll(files)
        level = listed.where("folder").select("path")
    named = found.select("path", patch_name(F.col("path")).alias("n")).select("path", "n.*")
    return named if limit is None else first_paths(named, limit)


def _list_folders(base: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for inside in batch.column(0).to_pylist():
                fs, root = pafs.FileSystem.from_uri(base if "://" in base or base.startswith("file:") else os.path.abspath(base))
                entries = fs.get_file_info(pafs.FileSelector(f"{root}/{inside}" if inside else root))
                rows = [(f"{inside}/{e.base_name}" if inside else e.base_name, e.type == pafs.FileType.Directory) for e in entries]
                rows = [r for r in rows if r[1] or fnmatch.fnmatchcase(r[0].rpartition("/")[2], pattern)]
                for at in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[at : at + 10_000]], t) for k, t in enumerate((pa.string(), pa.bool_()))], names=["path", "folder"])

    return run


def write_empty_files(paths: DataFrame, folder: str, path: str = "path") -> None:
    """An empty file for each path below ``folder``, made by tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = set()
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, root = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else os.path.abspath(folder))
                parent = f"{root}/{name}".rpartition("/")[0]
                if parent not in made:
                    fs.create_dir(parent, recursive=True)
                    made.add(parent)
                fs.open_output_stream(f"{root}/{name}").close()
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    paths.select(path).mapInArrow(run, "n long").agg(F.sum("n")).collect()


def first_paths(patches: DataFrame, n: int, path: str = "path") -> DataFrame:
    """The first ``n`` rows by path."""
    return patches.orderBy(path).limit(n)


def read_bands(spark: SparkSession, path: str, bands: list[str] | None = None, column: str = "band") -> DataFrame:
    """Observations of the wanted bands only; a table partitioned by band reads no other files."""
    df = spark.read.parquet(path)
    return df if bands is None else df.where(F.col(column).isin(bands))


def read_labels(df: DataFrame, label: str = "label") -> DataFrame:
    return df.withColumn(label, F.col(label).cast("smallint"))


IMAGES = "images array<struct<id: bigint, file_name: string>>"


def read_annotation_splits(spark: SparkSession, prefix: str, targets: tuple[str, ...] = ("train", "val", "test"), lines: bool = False) -> DataFrame:
    """``(path, target)`` from annotation files: path ``<year>/<tile>/<file>`` of every image listed.

    Either one document in each file ``<prefix>_<target>.json``, which is then one task, or,
    with ``lines``, what :func:`write_annotation_splits` writes: documents of bounded size,
    a line for each, in a folder for each target.
    """
    if lines:
        images = spark.read.schema(f"{IMAGES}, target string").json(prefix).where(F.col("target").isin(*targets))
    else:
        images = None
        for target in targets:
            one = spark.read.option("multiLine", "true").schema(IMAGES).json(f"{prefix}_{target}.json").withColumn("target", F.lit(target))
            images = one if images is None else images.unionByName(one)
    name = images.select(F.explode("images").alias("i"), "target").select(F.regexp_replace("i.file_name", r"^netcdf/", "").alias("file"), "target")
    part = F.split("file", "_")
    return name.select(F.concat_ws("/", part[0], part[1], "file").alias("path"), "target")


def write_annotation_splits(split: DataFrame, folder: str, file: str = "file", key: str = "id", images: int = 1000, documents: int = 1000) -> None:
    """Images ``(id, file, target)`` as annotation documents, lines of files in a folder for each target.

    A document has about ``images`` images, a file ``documents`` documents at most; images
    are dealt by a digest of their id, so the number of documents follows the number of rows.
    """
    piece = F.pmod(F.xxhash64(key), F.greatest(F.lit(1), F.ceil(F.col("_all") / images)).cast("long"))
    sized = split.join(F.broadcast(split.agg(F.count("*").alias("_all"))), F.lit(True))
    image = F.struct(F.col(key).cast("long").alias("id"), F.col(file).alias("file_name"))
    pieces = sized.groupBy("target", piece.alias("_piece")).agg(F.collect_list(image).alias("images"))
    pieces.select("target", "images").write.option("maxRecordsPerFile", documents).partitionBy("target").json(folder)


def write_split(split: DataFrame, path: str) -> None:
    """One folder for each target."""
    split.write.mode("overwrite").partitionBy("target").parquet(path)


def write_split_lists(split: DataFrame, path: str, order: str = "path") -> None:
    """The same as text lists of paths."""
    split.select("target", "path").sort("target", order).write.mode("overwrite").partitionBy("target").text(path)


def read_split(spark: SparkSession, path: str, target: str | None = None, text: bool = False) -> DataFrame:
    """A written split, or one target of it, whose folder alone is read then."""
    df = spark.read.text(path).withColumnRenamed("value", "path") if text else spark.read.parquet(path)
    return df if target is None else df.where(F.col("target") == target)


def write_tiles(tiles: DataFrame, path: str) -> None:
    """Composite tiles by year and tile name; ``has_label`` beside labels lets empty tiles be skipped in the scan."""
    by = [c for c in ("year", "tile") if c in tiles.columns]
    tiles.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_stored(df: DataFrame, table: str, place: str, buckets: int, key: str = "path") -> None:
    """``df`` as a table in ``buckets`` of ``key`` at ``place``, a sorted file for each.

    Tables with as many buckets are joined on the key, and grouped by it, without a shuffle.
    Take so many that a bucket fits into a task: tiles of a patch are never split.
    """
    dealt = df.repartition(buckets, key).sortWithinPartitions(key)
    dealt.write.mode("overwrite").option("path", place).bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(table)


def read_stored(spark: SparkSession, table: str, place: str | None = None, buckets: int | None = None, key: str = "path") -> DataFrame:
    """A stored table. A session that doesn't know it finds it at ``place``, with its number of buckets."""
    if place and not spark.catalog.tableExists(table):
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(place).schema.fields)
        spark.sql(f"CREATE TABLE `{table}` ({kinds}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{place}'")
    return spark.table(table)


def read_tiles(spark: SparkSession, path: str, split: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Tiles, of a split's patches if given; ``strict`` fails if a patch of the split has none."""
    return tiles_of(spark.read.parquet(path), split, strict)


def tiles_of(tiles: DataFrame, split: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """The tiles of a split's patches. ``strict``: a patch without tiles is an error when the rows' paths are read.

    The check is part of the one join, no job of its own.
    """
    if split is None:
        return tiles
    wanted = split.select("path").distinct()
    if not strict:
        return tiles.join(wanted, "path", "left_semi")
    here, asked = fresh(tiles, "_here", "_asked")
    joined = wanted.withColumnRenamed("path", asked).join(tiles.withColumn(here, F.lit(True)), F.col(asked) == F.col("path"), "left")
    lost = F.raise_error(F.concat(F.lit("no composite of "), F.col(asked).cast("string"))).cast(tiles.schema["path"].dataType)
    return joined.select(*[F.when(F.col(here), F.col("path")).otherwise(lost).alias("path") if c == "path" else F.col(f"`{c}`") for c in tiles.columns])


def composite_meta(tiles: DataFrame, size: str = "img_size") -> DataFrame:
    """One row: sorted bands, the one size, number of patches and tiles of a patch; two sizes raise an error.

    ``tiles`` has ``path, tile_y, tile_x, band`` and a size column.
    """
    sizes = F.count_distinct(size)
    one = F.when(sizes <= 1, F.min(size)).otherwise(F.raise_error(F.lit("patches differ in size")).cast(tiles.schema[size].dataType))
    per_patch = tiles.groupBy("path").agg(F.count_distinct("tile_y", "tile_x").alias("_n"))
    most = per_patch.agg(F.count("*").alias("num_patches"), F.max("_n").alias("num_subpatches_per_patch"))
    return tiles.agg(F.array_sort(F.collect_set("band")).alias("bands"), one.alias("img_size")).join(F.broadcast(most), F.lit(True))


def write_scores(scores: DataFrame, path: str) -> None:
    scores.write.mode("overwrite").option("header", "true").csv(path)


def geojson_lines(split: DataFrame, ring: str = "ring") -> DataFrame:
    """One feature for each row, as text; all other columns are its properties."""
    points = F.transform(ring, lambda p: F.array(p["x"], p["y"]))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(points).alias("coordinates"))
    properties = F.struct(*[c for c in split.columns if c != ring])
    return split.select(F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry"))).alias("value"))


def write_polygons(split: DataFrame, path: str, ring: str = "ring") -> None:
    geojson_lines(split, ring).write.mode("overwrite").text(path)


def write_counts(patch_counts: DataFrame, pixel_counts: DataFrame, path: str) -> None:
    """``patch_counts``, and ``pixel_counts`` by target."""
    patch_counts.write.mode("overwrite").parquet(f"{path}/patch_counts")
    pixel_counts.write.mode("overwrite").partitionBy("target").parquet(f"{path}/pixel_counts")
