"""Token ids as flat binary files with 64-bit document offsets.

Rows are range-partitioned and sorted by id, so partition p holds smaller ids
than partition p + 1, and each task writes one shard: ``.bin`` has the ids of
its documents, one after another, as little-endian unsigned integers (16 bits
where the vocabulary has at most 65,536 ids, else 32); ``.idx`` has n document
ids and n + 1 offsets into it, all 64-bit.  Every attempt of a task writes files
of its own name, and only the attempt that Spark accepts is listed in the
manifest.  A shard's base, its first token's place in the whole corpus, is the
sum of the tokens of the shards before it.

Readers map the files into memory where the folder is local to them.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorewell.llm import common, tokens

#: Documents that a reader takes out of a shard at a time.
READ_DOCS = 2000


def _folder(uri: str):
    if "://" in uri or uri.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(uri)
    return pyarrow.fs.LocalFileSystem(), uri


def _writer(folder: str, path: str, end_id: int, kind: str):
    def run(batches):
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}"
        fs, base = _folder(folder)
        out = None
        ids, ends = [], [np.zeros(1, np.int64)]
        total = 0
        for batch in batches:
            if out is None:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(f"{base}/{name}.bin")
            for _, _, part, offsets in tokens.encoded(batch["_t"], path, end_id):
                out.write(part.astype(kind).tobytes())
                ends.append(total + offsets[1:])
                total += len(part)
            ids.append(batch["_id"].fill_null(np.iinfo(np.int64).min).to_numpy())
        if out is None:
            return
        out.close()
        doc = np.concatenate(ids).astype("<i8")
        with fs.open_output_stream(f"{base}/{name}.idx") as f:
            f.write(doc.tobytes())
            f.write(np.concatenate(ends).astype("<u8").tobytes())
        yield pa.RecordBatch.from_pydict(
            {"shard": pa.array([shard], pa.int32()), "docs": [len(doc)], "tokens": [total], "kind": [kind], "path": [f"{folder}/{name}"]}
        )

    return run


def write_token_files(
    docs: DataFrame, folder: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write shards and return their manifest: shard, docs, tokens, kind, path, base.

    Texts are encoded whole; a null text is empty and has the end id alone.
    Rows that repeat an id or have none are documents of their own, in the order
    of id (null first, stored as the smallest 64-bit integer), then text.  An
    empty table gives an empty manifest.  Other columns are ignored.
    """
    spark = docs.sparkSession
    kind = "<u2" if max(end_id + 1, tokens.encoder(vocabulary).vocabulary) <= 1 << 16 else "<u4"
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_t"))
    order = [F.col("_id").asc_nulls_first(), F.col("_t").asc_nulls_first()]
    written = (
        # by the text's beginning too, in the same order, so that rows of one id or of none are many ranges
        rows.repartitionByRange(order[0], F.substring("_t", 1, 64).asc_nulls_first())
        .sortWithinPartitions(*order)
        .mapInArrow(
            _writer(folder, vocabulary, end_id, kind), "shard int, docs long, tokens long, kind string, path string"
        )
    )
    manifest = common.saved(written, "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    return manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("long")))


def open_shard(path: str, docs: int, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token ids, document ids, offsets) of a shard, mapped into memory if it is a local file."""
    fs, base = _folder(path)

    def load(name: str, dtype: str) -> np.ndarray:
        if isinstance(fs, pyarrow.fs.LocalFileSystem):
            return np.memmap(name, dtype, mode="r")
        with fs.open_input_file(name) as f:
            return np.frombuffer(f.read(), dtype)

    index = load(f"{base}.idx", "<i8")
    return load(f"{base}.bin", kind), index[:docs], index[docs:].view("<u8").astype(np.int64)


def _reader(with_ids: bool):
    def run(batches):
        for batch in batches:
            for m in batch.to_pylist():
                ids, doc, offsets = open_shard(m["path"], m["docs"], m["kind"])
                for a in range(0, len(doc), READ_DOCS):
                    b = min(a + READ_DOCS, len(doc))
                    part = ids[offsets[a] : offsets[b]].astype("<u4")
                    at = offsets[a : b + 1] - offsets[a]
                    crc = [zlib.crc32(part[x:y]) for x, y in zip(at[:-1], at[1:])]
                    cols = [
                        pa.array(doc[a:b], mask=doc[a:b] == np.iinfo(np.int64).min),
                        pa.array(m["base"] + offsets[a:b]),
                        pa.array(np.diff(at)),
                        pa.array(crc, pa.int64()),
                    ]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        cols.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(part.view("<i4"))))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(cols, names)

    return run


def read_token_files(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and the ids, if asked for) of every document in the shards.

    The number of read tasks is given, so that the few small rows of a manifest
    are not merged into one task that would read every file.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return common.spread(manifest, "shard").mapInArrow(_reader(with_ids), schema)
