"""Token-ID files with a minimal perfect hash index: documents are dealt into ranges of doc_id, each task encodes its range and writes
shards of raw ids; index files map any document's key to its shard and place, in constant time.

A folder holds a small Parquet table `layout` (the number of index files, the end id), shards and index files. All integers are
little-endian.

    shard-TTTTTTTT-PPPP.ids (task T, part P; in this order the documents ascend by doc_id)
      bytes 0-7   "TSIDS002"
      8-31        three u64: documents, ids, bytes of an id (2 or 4)
      then        the ids, raw, document after document
    index-BBBBBBBB.mph (the keys that hash to B)
      bytes 0-7   "TSMPH002"
      8-31        three u64: keys n, levels, words of the bit arrays
      then        for each level: u64 bits m of its bit array, u64 its first word
      then        the bit arrays (u64 words), then for each word u64 the bits set in all words before it
      then        for each slot: u32 fingerprint, u32 bytes of an id, u64 shard (T * 65536 + P), u64 first id in the shard, u64 number of
                  ids, u64 number of ids in all documents before, u64 documents of the same doc_id

A key is looked up level by level: at level l it has bit mix(key, l) % m; the first level where that bit is set gives the slot, the
number of bits set before it. All n slots are used: the hash is minimal and perfect. The slot's stored fingerprint tells strange keys,
all but one in 2^32."""

from __future__ import annotations

import binascii
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagsim.llm.common import documents, emptied, shared_path, stored
from tagsim.llm.tokens import encode_bytes

SHARD_MAGIC, INDEX_MAGIC = b"TSIDS002", b"TSMPH002"
END_ID = 2
#: A shard is closed when it holds this many ids.
SHARD_IDS = 4_000_000
#: Documents to a task; texts that are encoded at once; keys of an index file.
TASK_DOCS = 8192
BATCH_DOCS = 512
INDEX_KEYS = 1 << 16
LEVEL_BITS = 1.6
#: Shards whose ids are added up in one task: those of this many write tasks.
START_TASKS = 1024


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def keys_of(doc_ids: pa.Array, turns: np.ndarray) -> np.ndarray:
    """A 64-bit key of each document: its doc_id, null or not, and its turn (0, 1, ...) among documents of one id."""
    own = doc_ids.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
    none = doc_ids.is_null().to_numpy(zero_copy_only=False)
    return np.where(none, _mix(own, 63), _mix(own, 61)) ^ (turns.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class PerfectHash:
    """A minimal perfect hash of different 64-bit keys: bit arrays by level, and for each word the bits set before it."""

    def __init__(self, sizes: np.ndarray, starts: np.ndarray, words: np.ndarray, before: np.ndarray):
        self.sizes, self.starts, self.words, self.before = sizes, starts, words, before

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        if len(np.unique(keys)) != len(keys):
            raise ValueError("keys repeat")
        sizes, starts, arrays, at, level = [], [], [], 0, 0
        while len(keys):
            m = -(-int(len(keys) * LEVEL_BITS + 1) // 64) * 64
            place = (_mix(keys, level) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(place, minlength=m) == 1
            arrays.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(m)
            starts.append(at)
            at += m // 64
            keys, level = keys[~alone[place]], level + 1
        words = np.concatenate(arrays) if arrays else np.empty(0, dtype=np.uint64)
        ones = np.bitwise_count(words).astype(np.uint64)
        return cls(np.array(sizes, dtype=np.uint64), np.array(starts, dtype=np.uint64), words, np.cumsum(ones, dtype=np.uint64) - ones)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 if no level has it."""
        out, todo = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, (m, start) in enumerate(zip(self.sizes, self.starts, strict=True)):
            if not len(todo):
                break
            place = _mix(keys[todo], level) % m
            word, bit = (start + place // np.uint64(64)).astype(np.int64), place % np.uint64(64)
            found = (self.words[word] >> bit) & np.uint64(1) == 1
            w, b = word[found], bit[found]
            below = self.words[w] & ((np.uint64(1) << b) - np.uint64(1))
            out[todo[found]] = (self.before[w] + np.bitwise_count(below).astype(np.uint64)).astype(np.int64)
            todo = todo[~found]
        return out


SLOT = np.dtype([("fingerprint", "<u4"), ("width", "<u4"), *[(c, "<u8") for c in ("shard", "first", "n", "start", "copies")]])


def _fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 77) >> np.uint64(32)).astype(np.uint32)


def pack_shard(ids: list[bytes]) -> tuple[bytes, int]:
    """A shard of documents, given the ids of each as 32-bit integers; and the bytes of an id in it."""
    flat = np.frombuffer(b"".join(ids), dtype="<u4")
    width = 2 if not len(flat) or int(flat.max()) < 1 << 16 else 4
    return SHARD_MAGIC + struct.pack("<3Q", len(ids), len(flat), width) + flat.astype("<u2" if width == 2 else "<u4").tobytes(), width


SHARD_HEAD = 32


def pack_index(keys: np.ndarray, columns: dict[str, np.ndarray]) -> bytes:
    """An index file of keys, with the slots' other fields by name."""
    index, table = PerfectHash.of(keys), np.zeros(len(keys), dtype=SLOT)
    at = index.slots(keys)
    table["fingerprint"][at] = _fingerprints(keys)
    for name, values in columns.items():
        table[name][at] = values
    head = INDEX_MAGIC + struct.pack("<3Q", len(keys), len(index.sizes), len(index.words))
    levels = np.stack([index.sizes, index.starts], axis=1).astype("<u8").tobytes()
    return b"".join([head, levels, index.words.astype("<u8").tobytes(), index.before.astype("<u8").tobytes(), table.tobytes()])


def find(data: bytes, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of keys and an index file: which it has, and the slots of all (of those it lacks, any)."""
    if data[:8] != INDEX_MAGIC:
        raise ValueError("not an index file")
    n, levels, words = struct.unpack("<3Q", data[8:32])
    pairs = np.frombuffer(data, "<u8", 2 * levels, 32).reshape(-1, 2)
    bits = np.frombuffer(data, "<u8", 2 * words, 32 + 16 * levels)
    table = np.frombuffer(data, SLOT, n, 32 + 16 * levels + 16 * words)
    at = PerfectHash(pairs[:, 0], pairs[:, 1], bits[:words], bits[words:]).slots(keys)
    out = table[np.maximum(at, 0)] if n else np.zeros(len(keys), dtype=SLOT)
    return (at >= 0) & (out["fingerprint"] == _fingerprints(keys)), out


def shard_name(shard: int) -> str:
    return f"shard-{shard >> 16:08d}-{shard & 65535:04d}.ids"


def _filesystem(base: str):
    """base: a whole URI. The file system behind it, and the path in it; s3a and s3n are names of s3."""
    from pyarrow import fs

    kind, _, path = base.partition(":")
    if kind == "file":
        return fs.LocalFileSystem(), "/" + path.lstrip("/")
    return fs.FileSystem.from_uri(("s3" if kind in ("s3a", "s3n") else kind) + ":" + path)


def _put(files, root: str, name: str, data: bytes) -> None:
    """Under a name of its own first, renamed when whole: a task that runs again makes the same file."""
    with files.open_output_stream(trial := f"{root}/.{name}.{uuid.uuid4().hex}") as out:
        out.write(data)
    files.move(trial, f"{root}/{name}")


def _layout(spark: SparkSession, folder: str) -> tuple[int, str]:
    """Number of index files; and the folder as the whole URI that Spark takes it for, whatever its default file system is."""
    table = spark.read.parquet(f"{folder}/layout")
    return table.first()["n_index"], table.inputFiles()[0].rpartition("/layout/")[0]


def _bucket(n_index: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "turn"), F.lit(n_index)).cast("int")


def _with_turns(written: DataFrame) -> DataFrame:
    """With turn (0, 1, ... among documents of one id, in their order) and copies (how many they are)."""
    if written.groupBy(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull()).count().filter("count > 1").isEmpty():
        return written.withColumns({"turn": F.lit(0), "copies": F.lit(1).cast("long")})
    # a shard's documents of one id are bounded by the shard; over shards only their counts are added up
    inside = F.row_number().over(Window.partitionBy("doc_id", "shard").orderBy("first")) - 1
    counts = written.groupBy("doc_id", "shard").agg(F.count(F.lit(1)).alias("here"))
    over = Window.partitionBy("doc_id")
    counts = counts.select("doc_id", "shard", (F.sum("here").over(over.orderBy("shard")) - F.col("here")).alias("before"), F.sum("here").over(over).alias("copies"))
    own, counts = written.withColumn("inside", inside).alias("w"), counts.alias("c")
    joined = own.join(counts, F.col("w.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("w.shard") == F.col("c.shard")))
    return joined.select("w.*", (F.col("inside") + F.col("before")).cast("int").alias("turn"), "copies").drop("inside")


def shard_starts(written: DataFrame) -> DataFrame:
    """shard, shard_start (ids in all shards before it). Sums of many shards are added up first, so no task sees all shards."""
    sums = stored(written.groupBy("shard").agg(F.sum("n").alias("n")).withColumn("part", F.expr(f"shard div {START_TASKS << 16}")), "shard_sums")
    parts = sums.groupBy("part").agg(F.sum("n").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("shard")) - F.col("n")
    return sums.withColumn("inside", inside).join(parts, "part").select("shard", (F.col("part_start") + F.col("inside")).alias("shard_start"))


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes docs into shards and index files under folder, a new one that all executors share.

    Shards and the documents in them are in ascending order of doc_id, null first; documents of one id are ordered by a hash of their
    text and have turns 0, 1, ... A null text is empty. Every document ends with end_id. Rows that repeat are documents of their own. An
    empty table writes no shard. Other columns aren't read. A document's ids are held whole by one task. A file is written under a name
    of its own and renamed when whole; a task that runs again after a lost executor makes the same bytes."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n_docs = own.count()
    n_index = max(1, -(-n_docs // INDEX_KEYS))
    spark.createDataFrame([(n_index, end_id)], "n_index int, end_id int").coalesce(1).write.parquet(f"{folder}/layout")
    base = _layout(spark, folder)[1]
    # the row's own number lets one id, or one row that repeats, spread over several tasks
    own = own.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash").asc()]
    ranged = own.repartitionByRange(max(1, -(-n_docs // TASK_DOCS)), *order, F.col("row").asc())
    ranged = ranged.withColumn("task", F.spark_partition_id()).sortWithinPartitions(*order, "text").select("doc_id", "text", "task")
    end = struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(base)
        doc_ids: list = []
        ids: list[bytes] = []
        held, part = 0, 0

        def close(task: int) -> pa.RecordBatch:
            nonlocal held, part
            data, width = pack_shard(ids)
            shard = task << 16 | part
            _put(files, root, shard_name(shard), data)
            n = np.array([len(b) // 4 for b in ids], dtype=np.int64)
            columns = [pa.array(doc_ids, pa.int64()), pa.array(np.full(len(n), shard, dtype=np.int64)), pa.array(np.cumsum(n) - n), pa.array(n), pa.array(np.full(len(n), width, dtype=np.int32))]
            doc_ids.clear(), ids.clear()
            held, part = 0, part + 1
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "shard", "first", "n", "width"])

        for batch in batches:
            task = batch.column("task")[0].as_py() if len(batch) else 0
            for s in range(0, len(batch), BATCH_DOCS):
                some = batch.slice(s, BATCH_DOCS)
                for doc_id, found in zip(some.column("doc_id").to_pylist(), encode_bytes(some.column("text").to_pylist(), tokenizer_path), strict=True):
                    doc_ids.append(doc_id), ids.append(found + end)
                    held += len(found) // 4 + 1
                    if held >= shard_ids:
                        yield close(task)
        if ids:
            yield close(task)

    written = stored(ranged.mapInArrow(write, "doc_id long, shard long, first long, n long, width int"), "token_file_documents")
    starts = stored(shard_starts(written), "token_file_starts")
    placed = _with_turns(written).join(starts, "shard").withColumn("start", F.col("shard_start") + F.col("first")).withColumn("bucket", _bucket(n_index))
    placed = placed.select("bucket", "doc_id", "turn", "width", "shard", "first", "n", "start", "copies").repartitionById(n_index, "bucket").sortWithinPartitions("bucket", "doc_id", "turn")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)  # the rows of one index file
        if sum(len(b) for b in held):
            files, root = _filesystem(base)
            rows = pa.Table.from_batches(held).combine_chunks()
            keys = keys_of(rows.column("doc_id").combine_chunks(), rows.column("turn").to_numpy())
            data = pack_index(keys, {c: rows.column(c).to_numpy() for c in SLOT.names[1:]})
            _put(files, root, f"index-{rows.column('bucket')[0].as_py():08d}.mph", data)
            yield pa.RecordBatch.from_arrays([pa.array([len(rows)])], names=["n"])

    placed.mapInArrow(index, "n long").agg(F.sum("n")).first()
    emptied(written, starts)


def _looked_up(keys: DataFrame, base: str, n_index: int) -> DataFrame:
    """keys: doc_id, turn. doc_id, turn and the slot's fields, of the keys that the folder has. A task reads the index files of its keys, each
    once."""
    dealt = keys.withColumn("bucket", _bucket(n_index)).select("bucket", "doc_id", "turn").repartitionById(n_index, "bucket").sortWithinPartitions("bucket")
    names = SLOT.names[1:]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = None  # a task has one index file
        for batch in batches:
            if len(batch):
                if data is None:
                    files, root = _filesystem(base)
                    path = f"{root}/index-{batch.column('bucket')[0].as_py():08d}.mph"
                    if not files.get_file_info(path).is_file:  # no document's key falls to it
                        return
                    with files.open_input_stream(path) as f:
                        data = f.read()
                there, slots = find(data, keys_of(batch.column("doc_id"), batch.column("turn").to_numpy()))
                at = pa.array(np.flatnonzero(there))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("turn").take(at), *[pa.array(slots[c][there].astype(np.int64)) for c in names]], names=["doc_id", "turn", *names])

    return dealt.mapInArrow(look, "doc_id long, turn int, " + ", ".join(f"{c} long" for c in names))


def read_token_files(ids: DataFrame, folder: str, with_ids: bool = True, id_col: str = "doc_id") -> DataFrame:
    """ids: doc_id. doc_id, turn, start, n_tokens, ids_crc32, ids (binary, 32-bit; only with_ids), of every document of these ids, read from
    the files in folder and from nothing else. An id that the files lack has no row; a null id is that of the documents without one;
    an id that is asked for twice comes twice. No ids give no rows. Other columns aren't read."""
    n_index, base = _layout(ids.sparkSession, folder)
    asked = ids.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(0).alias("turn"))
    found = stored(_looked_up(asked, base, n_index), "token_file_slots")
    more = found.filter("copies > 1").select("doc_id", F.explode(F.sequence(F.lit(1), (F.col("copies") - 1).cast("int"))).alias("turn"))
    if not more.isEmpty():
        found = found.unionByName(_looked_up(more, base, n_index))
    wanted = found.select("doc_id", "turn", "width", "shard", "first", "n", "start").repartition("shard").sortWithinPartitions("shard", "first")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(base)
        shard, f = None, None
        for batch in batches:
            for s in range(0, len(batch), BATCH_DOCS):
                some, data = batch.slice(s, BATCH_DOCS), []
                for now, width, first, n in zip(*[some.column(c).to_pylist() for c in ("shard", "width", "first", "n")], strict=True):
                    if now != shard:
                        if f is not None:
                            f.close()
                        shard, f = now, files.open_input_file(f"{root}/{shard_name(now)}")
                        if f.read_at(8, 0) != SHARD_MAGIC:
                            raise ValueError(f"{shard_name(now)} is not a shard")
                    raw = f.read_at(n * width, SHARD_HEAD + first * width)
                    data.append(raw if width == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes())
                out = [some.column("doc_id"), some.column("turn"), some.column("start"), some.column("n"), pa.array([binascii.crc32(x) for x in data], pa.int64())]
                names = ["doc_id", "turn", "start", "n_tokens", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(out + [pa.array(data, pa.binary())] * with_ids, names=names + ["ids"] * with_ids)
        if f is not None:
            f.close()

    return wanted.mapInArrow(read, "doc_id long, turn int, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder, docs = shared_path(spark, "token_files"), documents(spark, sf_dir)
    write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_token_files(docs.select("doc_id").distinct(), folder, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")
