"""Token ids in Arrow files of fixed-size-list batches.

Documents are range-sorted by id; each partition writes its token stream, cut into sequences of equal length, as one
Arrow IPC file: a column of fixed-size lists of ids and one of masks (false: padding after the last token).  Batches
are uncompressed, so any token is found by arithmetic in a memory-mapped file and read without a copy.  A second, small
Arrow file beside it holds each document's place.  Ids are stored in 16 bits where the vocabulary allows, else in 32.

Files are named by partition and attempt; the written list of files commits them, so a lost or repeated attempt leaves
at most a file that no list names.

Edge cases: null text is empty text (its only token is the end id); a null ``doc_id`` comes first; rows that share a
``doc_id`` are ordered by text; an empty table writes no file; texts of any length run on over as many sequences as
they need; columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import slices
from .common import fresh_dir, held, materialise, table

#: Tokens of a sequence, sequences of a batch, text bytes of a file.
LENGTH, BATCH, FILE_BYTES = 2048, 128, 24 << 20
#: Remembered words of a Python worker.
MEMO = 600_000
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class Encoder:
    """The library's ids of whole texts, word by word; ids of words seen before are remembered.

    Works for files whose normalizer lower-cases and turns white space into spaces, whose splitter is SPLIT without white
    space, and whose words end in END; for any other file all texts go to the library.  Texts of settled characters are
    cut as the splitter cuts them, and new words encoded many at a time; word ends in the ids tell them apart.  Other texts
    are cut at spaces and line ends, and their pieces remembered.
    """

    #: Fixed values of the format: its splitting pattern, and the mark of a word's end.
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    END = "</w>"
    #: ASCII but for the sign that starts special tokens, and the letters and signs beside it that lower-case to one character.
    SETTLED = re.compile("[\t\n\r !-;=-~À-įı-ž]*")
    #: The splitting pattern for settled, lower-cased texts.
    WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|[^\\s0-9a-zß-öø-ž]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        # the same merges for words that are settled, lower-cased and cut already
        self.merges = Tokenizer.from_file(path)
        self.merges.normalizer = normalizers.Sequence([])
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.type = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.ends = np.zeros(self.size, bool)
        for token, i in self.library.get_vocab(with_added_tokens=False).items():
            self.ends[i] = token.endswith(self.END)
        self.plain = self.is_plain(json.loads(self.library.to_str()))
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def is_plain(self, spec: dict) -> bool:
        """Whether the file has the form that words can be encoded alone for."""

        def steps(part: dict | None, inner: str) -> list[dict]:
            return [] if part is None else part.get(inner) or [part]

        normal = [(x["type"], x.get("pattern", {}).get("Regex"), x.get("content")) for x in steps(spec["normalizer"], "normalizers")]
        split = [(x["type"], x.get("pattern", {}).get("Regex"), x.get("behavior"), x.get("invert")) for x in steps(spec["pre_tokenizer"], "pretokenizers")]
        return (
            normal == [("NFC", None, None), ("Replace", r"\s+", " "), ("Lowercase", None, None)]
            and split and split[0] == ("Split", self.SPLIT, "Removed", True) and [x[0] for x in split[1:]] in ([], ["ByteLevel"])
            and spec["model"]["type"] == "BPE" and spec["model"].get("end_of_word_suffix") == self.END
        )

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.type).tobytes()

    def learn(self, new: list[str]) -> None:
        """Encode words that aren't remembered, many at a time."""
        parts = [new[at : at + 1000] for at in range(0, len(new), 1000)]
        for some, found in zip(parts, self.merges.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, self.type)
            ends = ((np.flatnonzero(self.ends[ids]) + 1) * self.type.itemsize).tolist()
            if len(ends) == len(some):
                blob = ids.tobytes()
                self.words.update(zip(some, map(blob.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))
            else:
                self.words |= {w: self.whole(w) for w in some}

    def piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            if len(self.pieces) > MEMO:
                self.pieces.clear()
            found = self.pieces[piece] = self.whole(piece) if piece else b""
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.plain:
            return [self.whole(t) for t in texts]
        if len(self.words) > MEMO:
            self.words.clear()
        settled, find, get = self.SETTLED.fullmatch, self.WORDS.findall, self.words.get
        out, waiting, new = [], [], {}
        for t in texts:
            if settled(t):
                words = find(t.lower())
                found = list(map(get, words))
                if places := [i for i, x in enumerate(found) if x is None]:
                    missing = [words[i] for i in places]
                    new.update(dict.fromkeys(missing))
                    waiting.append((found, places, missing))
            else:
                found = list(map(self.piece, t.replace("\n", " ").split(" ")))
            out.append(found)
        self.learn(list(new))
        for found, places, missing in waiting:
            for i, w in zip(places, missing, strict=True):
                found[i] = get(w)
        return list(map(b"".join, out))


def encoder_of(path: str) -> Encoder:
    """One encoder for each Python worker and file; what it remembers serves the worker's next tasks."""
    return held(("tokens", path), lambda: Encoder(path))


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path of a URI; Hadoop's names of object stores are those of Arrow."""
    for ours, theirs in (("s3a://", "s3://"), ("s3n://", "s3://"), ("wasbs://", "abfss://")):
        if uri.startswith(ours):
            uri = theirs + uri[len(ours) :]
    return pa.fs.FileSystem.from_uri(uri)


class FileWriter:
    """Appends documents' ids to one file of sequences and, on close, their places to the file beside it."""

    def __init__(self, base: str, kind: np.dtype, length: int):
        self.fs, self.path = filesystem(base)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.kind, self.length = kind, length
        ids = pa.list_(pa.from_numpy_dtype(kind), length)
        self.schema = pa.schema([("ids", ids), ("mask", pa.list_(pa.bool_(), length))])
        self.out = self.fs.open_output_stream(f"{self.path}.arrow")
        self.writer = pa.ipc.new_file(self.out, self.schema)
        self.waiting: list[bytes] = []
        self.bytes = self.total = 0
        self.places: list[tuple] = []

    def append(self, doc_id: int | None, blob: bytes) -> None:
        n = len(blob) // self.kind.itemsize
        self.places.append((doc_id, self.total, n))
        self.total += n
        self.waiting.append(blob)
        self.bytes += len(blob)
        if self.bytes >= self.length * BATCH * self.kind.itemsize:
            self.flush()

    def flush(self, last: bool = False) -> None:
        ids = np.frombuffer(b"".join(self.waiting), self.kind)
        step = self.length * BATCH
        whole = len(ids) if last else len(ids) // step * step
        for at in range(0, whole, step):
            some = ids[at : at + step]
            short = -len(some) % self.length
            mask = np.concatenate([np.ones(len(some), bool), np.zeros(short, bool)])
            some = np.concatenate([some, np.zeros(short, self.kind)])
            arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (some, mask)]
            self.writer.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))
        self.waiting = [ids[whole:].tobytes()]
        self.bytes = len(self.waiting[0])

    def close(self) -> None:
        self.flush(last=True)
        self.writer.close()
        self.out.close()
        columns = [pa.array(c, t.type) for c, t in zip(zip(*self.places, strict=True), INDEX, strict=True)]
        with self.fs.open_output_stream(f"{self.path}.index.arrow") as out, pa.ipc.new_file(out, INDEX) as writer:
            writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=INDEX))


class FileReader:
    """Random access to the tokens and documents of one file."""

    def __init__(self, base: str):
        fs, path = filesystem(base)
        local = isinstance(fs, pa.fs.LocalFileSystem)
        of = (lambda p: pa.memory_map(p)) if local else fs.open_input_file
        self.file = pa.ipc.open_file(of(f"{path}.arrow"))
        self.index = pa.ipc.open_file(of(f"{path}.index.arrow")).read_all()
        self.length = self.file.schema.field("ids").type.list_size
        self.at, self.ids = -1, None

    def tokens(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids from ``start`` on, as views of the batches that hold them."""
        step = self.length * BATCH
        while n > 0:
            k, offset = divmod(start, step)
            if k != self.at:
                self.at, self.ids = k, self.file.get_batch(k).column("ids").flatten().to_numpy(zero_copy_only=True)
            some = self.ids[offset : offset + n]
            yield some
            start, n = start + len(some), n - len(some)


def write_files(docs: DataFrame, path: str, end_id: int = 1, length: int = LENGTH, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the files; returns their written list: part, base (path without ending), n_tokens, start.

    ``start`` is the number of tokens in the files before.
    """
    spark = docs.sparkSession
    target = fresh_dir(spark, "tokens")
    rows = docs.select("doc_id", "text")
    size = rows.select(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(spark.sparkContext.defaultParallelism, size // file_bytes + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, part = None, None, TaskContext.get().partitionId()
        for batch in slices(batches):
            if not batch.num_rows:
                continue
            if writer is None:
                encoder = encoder_of(path)
                end = np.array([end_id], encoder.type).tobytes()
                base = f"{target}/part-{part:06d}-{uuid.uuid4().hex}"
                writer = FileWriter(base, encoder.type, length)
            blobs = encoder.encode([t or "" for t in batch.column("text").to_pylist()])
            for doc_id, blob in zip(batch.column("doc_id").to_pylist(), blobs, strict=True):
                writer.append(doc_id, blob + end)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "base": [base], "n_tokens": [writer.total]})

    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    sorted_rows = rows.repartitionByRange(int(files), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(*order)
    written = materialise(sorted_rows.mapInArrow(run, "part long, base string, n_tokens long"), "token-files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return written.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def read_documents(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files, read back from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, first in zip(batch.column("base").to_pylist(), batch.column("start").to_pylist(), strict=True):
                reader = FileReader(base)
                starts, counts = (reader.index.column(c).to_pylist() for c in ("start", "n_tokens"))
                sums = []
                for start, n in zip(starts, counts, strict=True):
                    crc = 0
                    for ids in reader.tokens(start, n):
                        crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                    sums.append(crc)
                places = [pa.array([first + s for s in starts], pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())]
                ids = reader.index.column("doc_id").combine_chunks()
                yield pa.RecordBatch.from_arrays([ids, *places], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = files.select("base", "start").repartition("base")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_documents(write_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


QUERIES = {"op4_token_files": op4_token_files}
