"""Token ids as flat binary files with 64-bit document offsets.

A set of files is a folder with, per part,

* ``part-N-*.bin``: ids of its documents, little-endian unsigned 16-bit integers
  if the vocabulary fits, else 32-bit, one after another;
* ``part-N-*.off``: little-endian signed 64-bit integers: the place of each
  document's first id among the ids of *all* parts, and, last, where the part ends;
* ``part-N-*.doc``: the ids of its documents, 64 bits each, then one byte each that
  is 1 where the id is null;

and a ``manifest`` table: part, file, docs, tokens, base. Parts hold ascending
ranges of document ids. A part's base is the prefix sum of the tokens of the parts
before it, so no task needs to see another's ids. Files are read by memory map
where the folder is a local path, and through the file system's own reader else.

Null documents are empty texts; an empty text has the end id alone. Null document
ids come first; equal ids are in order of their texts.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.llm.bpe import encoder
from gaugework.llm.tables import running_base, text_of

MANIFEST = "part int, file string, docs long, tokens long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"

#: Words a worker keeps in each of two generations, about 130 MB in all. Asking the model anew
#: for words that were forgotten is half of the work with a quarter of that.
WORDS = 400_000


def _system(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (
        pafs.LocalFileSystem(),
        folder,
    )


def _write_part(folder: str, vocabulary: str, end: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(vocabulary, WORDS)
        kind = "<u2" if encode.vocabulary <= 65536 else "<u4"
        system, root = _system(folder)
        # An attempt has files of its own; only those of the attempt that Spark
        # commits are in the manifest.
        part = TaskContext.get().partitionId()
        file = f"part-{part:06d}-{uuid.uuid4().hex[:12]}"
        system.create_dir(root, recursive=True)
        last, tokens = np.array([end], kind).tobytes(), 0
        lengths, ids = [], []
        with system.open_output_stream(f"{root}/{file}.bin") as out:
            for batch in batches:
                for text in batch.column("text"):
                    packed = np.frombuffer(encode.encode(text.as_py()), "<u4")
                    out.write(packed.astype(kind).tobytes() + last)
                    lengths.append(len(packed) + 1)
                ids.append(batch.column("doc_id"))
        if not lengths:
            system.delete_file(f"{root}/{file}.bin")
            return
        column = pa.chunked_array(ids)
        with system.open_output_stream(f"{root}/{file}.doc") as out:
            out.write(column.fill_null(0).to_numpy().astype("<i8").tobytes())
            out.write(column.is_null().to_numpy().astype("u1").tobytes())
        with system.open_output_stream(f"{root}/{file}.len") as out:
            out.write(np.array(lengths, "<i8").tobytes())
        tokens = sum(lengths)
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array([part], pa.int32()), "file": [file], "docs": [len(lengths)], "tokens": [tokens]}
        )

    return run


def _write_offsets(folder: str):
    """The offsets of a part, once its base is known; the same bytes on every attempt."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_stream(f"{root}/{row['file']}.len") as source:
                    lengths = np.frombuffer(source.read(), "<i8")
                offsets = row["base"] + np.concatenate([[0], np.cumsum(lengths)])
                with system.open_output_stream(f"{root}/{row['file']}.off") as out:
                    out.write(offsets.astype("<i8").tobytes())
            yield batch

    return run


def write_token_files(docs: DataFrame, folder: str, vocabulary: str = "byte_bpe_50k.json", end: int = 0) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into ``folder``; returns the manifest read back.

    Texts are dealt by ranges of (doc_id, hash of the text), so that no id, null
    included, fills one part. They are shuffled once; afterwards only counts move.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    key = [F.asc_nulls_first("doc_id"), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*key).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    files = f"{folder}/files"
    ordered.mapInArrow(_write_part(files, vocabulary, end), MANIFEST).write.parquet(f"{folder}/written")
    written = spark.read.schema(MANIFEST).parquet(f"{folder}/written")
    based = running_base(written, [], ["part"], "tokens", "base")
    # A row for each part: spread them, so that as many tasks write offsets.
    spread = based.repartition(max(1, written.count()), "part")
    spread.mapInArrow(_write_offsets(files), MANIFEST + ", base long").write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST + ", base long").parquet(f"{folder}/manifest")


def open_part(folder: str, file: str, docs: int, tokens: int) -> tuple[np.ndarray, ...]:
    """(document ids, whether null, offsets, ids) of one part; ids mapped, not read, if local."""
    system, root = _system(f"{folder}/files")

    def whole(kind: str) -> bytes:
        with system.open_input_stream(f"{root}/{file}.{kind}") as source:
            return source.read()

    named, offsets = whole("doc"), np.frombuffer(whole("off"), "<i8")
    width = system.get_file_info(f"{root}/{file}.bin").size // max(1, tokens)
    kind = "<u2" if width == 2 else "<u4"
    if isinstance(system, pafs.LocalFileSystem):
        ids = np.memmap(f"{root}/{file}.bin", kind, "r", shape=(tokens,))
    else:
        ids = np.frombuffer(whole("bin"), kind)
    return np.frombuffer(named, "<i8", docs), np.frombuffer(named, "u1", docs, 8 * docs), offsets, ids


def _read_part(folder: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                names, null, offsets, ids = open_part(folder, row["file"], row["docs"], row["tokens"])
                places = offsets - offsets[0]
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(places, places[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names, mask=null.astype(bool)),
                        pa.array(offsets[:-1]),
                        pa.array(np.diff(offsets)),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return run


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and the checksum of the ids of each document, from the files."""
    manifest = read_manifest(spark, folder)
    spread = manifest.repartition(max(1, manifest.count()), "part")
    return spread.mapInArrow(_read_part(folder), ROWS)
