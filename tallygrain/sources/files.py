"""Evidence files, labelled folders, OCR texts and embeddings from files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallygrain.functions import sha256state as SHA
from tallygrain.operators.documents import join_pages
from tallygrain.schemas import MANIFEST, OCR_PAGES
from tallygrain.session import work_dir

IMAGE_GLOB = "*.{jpg,jpeg,png,webp,JPG,JPEG,PNG,WEBP}"
# fixed values: MIME type by file ending
MIME = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "heic": "image/heic", "heif": "image/heif", "pdf": "application/pdf", "webp": "image/webp"}
# a larger file is hashed in turns of about this many bytes, so that no task reads it whole
TURN_BYTES = 128 * 1024 * 1024
# bytes of a large file go from task to task in rows of at most this size
ROW_BYTES = 1024 * 1024
# endings that Hadoop unpacks where it reads lines; such files are hashed whole
PACKED = r"(?i)\.(gz|bz2|deflate|lz4|snappy|zst|passthrough)$"
BOM = b"\xef\xbb\xbf"


def _load(spark: SparkSession, source: str, root: str, pattern: str | None, **options: str) -> DataFrame:
    reader = spark.read.format(source).options(recursiveFileLookup="true", **options)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(root)


def scan_files(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    return _load(spark, "binaryFile", root, pattern)


def _in_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of one split after the other as rows of bytes; every line but a file's first begins with its line feed."""
    def row(data: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {"file": [key[0]], "start": [key[1]], "n": [n], "size": [len(data)], "bytes": pa.array([data], pa.binary())}
        )

    key, n, held = None, 0, bytearray()
    for batch in batches:
        files, starts = batch.column(0).dictionary_encode(), batch.column(1).to_numpy(zero_copy_only=False)
        changes = (np.diff(starts) != 0) | (np.diff(files.indices.to_numpy(zero_copy_only=False)) != 0)
        edges = [0, *(np.flatnonzero(changes) + 1), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            now = (files[a].as_py(), int(starts[a]))
            opens_file = now != key and now[1] == 0
            if now != key:
                if held:
                    yield row(bytes(held))
                key, n, held = now, 0, bytearray()
            if not opens_file:
                held += b"\n"
            held += b"\n".join(batch.column(2).slice(a, b - a).to_pylist())
            while len(held) > ROW_BYTES:
                yield row(bytes(held[:ROW_BYTES]))
                del held[:ROW_BYTES]
                n += 1
    if held:
        yield row(bytes(held))


def _one_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state of each file after its rows of bytes, which come sorted."""
    file = state = None
    for batch in batches:
        for now, before, data in zip(*(batch.column(c) for c in ("file", "state", "bytes"))):
            now = now.as_py()
            if now != file:
                if file is not None:
                    yield pa.RecordBatch.from_pydict({"file": [file], "_state": [state]})
                file, state = now, before.as_py()
            state = SHA.extend(state, data.as_py())
    if file is not None:
        yield pa.RecordBatch.from_pydict({"file": [file], "_state": [state]})


def _finish(state: bytes, line_feed: bool) -> str:
    return SHA.finish(SHA.extend(state, b"\n") if line_feed else state)


def _large_digests(spark: SparkSession, root: str, pattern: str | None, large: DataFrame, is_large: Column, count: int, longest: int) -> DataFrame:
    """SHA-256 of files that no task should read whole.

    Spark's text source cuts files into splits and gives the bytes of a line as they
    are, so all tasks read at once and store rows of bytes.  SHA-256 runs from a file's
    first byte to its last: turn by turn, a task per file takes the next
    ``TURN_BYTES`` and hands on the state.  Line feeds at the end and a byte order mark at the
    start, which the source leaves out, follow from the file's length.
    """
    lines = _load(spark, "text", root, pattern, lineSep="\n").where(is_large).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("value").cast("binary").alias("line"),
    )
    stored = work_dir(spark, "large-files")
    schema = "file string, start long, n long, size long, bytes binary"
    (
        lines.mapInArrow(_in_rows, schema)
        .withColumn("turn", F.floor(F.col("start") / TURN_BYTES))
        .write.partitionBy("turn").option("compression", "none").parquet(f"{stored}/rows")
    )
    rows = spark.read.schema(f"{schema}, turn long").parquet(f"{stored}/rows")

    def store(states: DataFrame, turn: int) -> DataFrame:
        states.write.parquet(f"{stored}/states-{turn}")
        return spark.read.schema("file string, line_feed boolean, state binary").parquet(f"{stored}/states-{turn}")

    left_out = F.col("length") - F.col("total")
    states = large.select("file", "length").join(rows.groupBy("file").agg(F.sum("size").alias("total")), "file", "left").select(
        "file",
        left_out.isin(1, 1 + len(BOM)).alias("line_feed"),
        F.when(left_out.isin(0, 1), F.lit(SHA.start()))
        .when(left_out.isin(len(BOM), 1 + len(BOM)), F.lit(SHA.extend(SHA.start(), BOM)))
        .otherwise(F.raise_error(F.concat(F.lit("bytes read differ from the length of "), "file")).cast("binary"))
        .alias("state"),
    )
    states = store(states, 0)
    for turn in range(longest // TURN_BYTES + 1):
        after = (
            rows.where(F.col("turn") == turn)
            .join(states.select("file", "state"), "file")
            .select("file", "start", "n", "bytes", "state")
            .repartition(2 * count, "file")
            .sortWithinPartitions("file", "start", "n")
            .mapInArrow(_one_turn, "file string, _state binary")
        )
        states = store(
            states.join(after, "file", "left").select("file", "line_feed", F.coalesce("_state", "state").alias("state")), turn + 1
        )
    return states.select("file", F.udf(_finish, "string", useArrow=True)("state", "line_feed").alias("digest"))


def _hashed_files(spark: SparkSession, root: str, pattern: str | None) -> DataFrame:
    """path, length, modificationTime and digest of every file."""
    kept = ["path", "length", "modificationTime"]
    files = scan_files(spark, root, pattern)
    whole = files.select(*kept, F.sha2("content", 256).alias("digest"))
    if not SHA.available():
        return whole
    is_large = (F.col("_metadata.file_size") > TURN_BYTES) & ~F.col("_metadata.file_name").rlike(PACKED)
    large = files.where(is_large).select(*kept, F.col("_metadata.file_path").alias("file"))
    count, longest = large.agg(F.count("*"), F.max("length")).first()
    if not count:
        return whole
    digests = _large_digests(spark, root, pattern, large, is_large, count, longest)
    small = files.where(~is_large).select(*kept, F.sha2("content", 256).alias("digest"))
    return small.unionByName(large.join(digests, "file", "left").select(*kept, "digest"))


def evidence_manifest(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """One row per file.  Bytes are hashed where they are read and go no further.

    Files above ``TURN_BYTES`` are hashed by this call, in turns; the others where the
    rows are used.  Folder layout: ``root/<claim>/<kind>/<file>``; the file id is its path
    below the root.
    """
    relative = F.regexp_extract("path", r"([^/]+/[^/]+/[^/]+)$", 1)
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    mime = F.lit("application/octet-stream")
    for suffix, name in MIME.items():
        mime = F.when(ending == suffix, name).otherwise(mime)
    return _hashed_files(spark, root, pattern).select(
        relative.alias("file_id"),
        F.split(relative, "/")[0].alias("claim_id"),
        F.split(relative, "/")[1].alias("kind"),
        F.substring(F.split(relative, "/")[2], 1, 120).alias("filename"),
        mime.alias("mime_type"),
        F.col("length").alias("size_bytes"),
        F.concat(F.lit("0x"), "digest").alias("sha256"),
        F.col("modificationTime").alias("created_at"),
    )


def integrity_audit(manifest: DataFrame, rescan: DataFrame) -> DataFrame:
    """Do the stored bytes still have the recorded digest?  A missing file does not."""
    now = rescan.select("file_id", F.col("sha256").alias("_now"))
    return manifest.join(now, "file_id", "left").select(
        "file_id", "claim_id", F.coalesce(F.col("sha256") == F.col("_now"), F.lit(False)).alias("intact")
    )


def labelled_folder(spark: SparkSession, root: str) -> DataFrame:
    """Training pictures in ``root/{genuine,fraud}/<group>/``; loose files form ``_flat``.

    A group's ``manifest.json``, where there is one, is shown as a note.
    """
    files = scan_files(spark, root, IMAGE_GLOB).drop("content")
    label = F.regexp_extract("path", r"/(genuine|fraud)/(?:[^/]+/)?[^/]+$", 1)
    group = F.regexp_extract("path", r"/(?:genuine|fraud)/([^/]+)/[^/]+$", 1)
    rows = files.withColumn("label", label).where(F.col("label") != "").select(
        "path",
        F.concat_ws("/", F.lit("TRAINING"), F.col("label"), F.when(group == "", "_flat").otherwise(group)).alias("claim_id"),
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file_id"),
        "label",
    )
    notes = (
        spark.read.schema(MANIFEST)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "manifest.json")
        .option("multiLine", "true")
        .json(root)
        .withColumn("_path", F.input_file_name())
    )
    note = notes.select(
        F.concat_ws(
            "/", F.lit("TRAINING"), F.regexp_extract("_path", r"/(genuine|fraud)/([^/]+)/manifest\.json$", 1),
            F.regexp_extract("_path", r"/(genuine|fraud)/([^/]+)/manifest\.json$", 2),
        ).alias("claim_id"),
        F.concat_ws(" · ", "lossType", "district", "note").alias("note"),
    )
    return rows.join(note, "claim_id", "left")


def read_ocr_pages(spark: SparkSession, path: str) -> DataFrame:
    return join_pages(spark.read.schema(OCR_PAGES).parquet(path))


EmbedImages = Callable[[list[bytes]], list[list[float]]]
ReadImages = Callable[[list[bytes]], list[str]]


def embed_files(files: DataFrame, embed: EmbedImages) -> DataFrame:
    """Vectors from a user's embedding function, batch by batch next to the bytes.

    ``files`` has path and content (see ``scan_files``).
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "vec": embed(list(batch["content"]))})

    return files.select("path", "content").mapInPandas(run, "path string, vec array<float>")


def read_texts(files: DataFrame, read: ReadImages) -> DataFrame:
    """Texts from a user's OCR function; a batch that cannot be read gives empty texts."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = read(list(batch["content"]))
            yield pd.DataFrame({"path": batch["path"], "text": texts})

    return files.select("path", "content").mapInPandas(run, "path string, text string")
