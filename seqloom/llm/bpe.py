"""Byte-level BPE encoding and decoding with a contiguous rank array.

A word's parts and the ranks of its adjacent pairs lie in two short arrays; the least rank is found by a scan, its
boundary deleted, and the ranks beside it refreshed.  Words too long for scans keep the same pairs in a heap, which
takes them in the same order (least rank, then leftmost).  Encoded words are remembered in a table of bounded size.

Vocabulary, merges and added tokens come from a tokenizer file whose path is a parameter; it is read on the executors.

Edge cases: null text is empty text, which has no ids; strings of added tokens in a text become those tokens; texts of
any length are encoded whole; repeated rows give repeated rows; an empty table gives an empty result; a null ``doc_id``
is kept; columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import held, table

#: Fixed values of the byte-level format: its splitting pattern, and the bytes that stand for themselves.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN_BYTES = (range(0x21, 0x7F), range(0xA1, 0xAD), range(0xAE, 0x100))
#: Characters that all Unicode versions class alike; texts with others are split by the library's own splitter.
SETTLED = re.compile("[\x00-ͯЀ-ԯ -⁯₠-₿　-ヿ一-龥가-힣]*")
LONGEST_SCAN = 128
#: Remembered words of a Python worker.
MEMO = 400_000
NONE = 1 << 60


def byte_alphabet() -> dict[int, str]:
    """Byte -> the character that stands for it in the vocabulary; the others follow from U+0100 on."""
    plain = {b: chr(b) for r in PLAIN_BYTES for b in r}
    rest = [b for b in range(256) if b not in plain]
    return plain | {b: chr(256 + n) for n, b in enumerate(rest)}


class Codec(dict):
    """A tokenizer; as a dict, word -> its ids."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        alphabet = byte_alphabet()
        of_char = {c: b for b, c in alphabet.items()}
        self.bytes_ids = [vocab[alphabet[b]] for b in range(256)]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        #: (left id, right id) -> rank; rank -> merged id
        self.ranks = {(vocab[a], vocab[b]): n for n, (a, b) in enumerate(pairs)}
        self.merged = [vocab[a + b] for a, b in pairs]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.added = added
        self.added_split = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        size = max([*vocab.values(), *added.values()]) + 1
        self.token_bytes = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(of_char[c] for c in token) if all(c in of_char for c in token) else token.encode()
        for token, i in added.items():
            self.token_bytes[i] = token.encode()
        self.decimal = [str(i) for i in range(size)]
        self.words = regex.compile(SPLIT).findall
        self.path, self.library = path, None

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = tuple(self.merge([self.bytes_ids[b] for b in word.encode("utf-8", "surrogatepass")]))
        if len(self) >= MEMO:
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids

    def merge(self, parts: list[int]) -> list[int]:
        if len(parts) > LONGEST_SCAN:
            return self.merge_long(parts)
        rank = self.ranks.get
        ranks = [rank(pair, NONE) for pair in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            at = ranks.index(least)
            parts[at] = self.merged[least]
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank((parts[at - 1], parts[at]), NONE)
            if at < len(ranks):
                ranks[at] = rank((parts[at], parts[at + 1]), NONE)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same merges for a long word: pairs wait in a heap, stale ones are passed over."""
        n, rank = len(parts), self.ranks.get
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (r := rank((a, b), NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j], k = self.merged[r], -1, right[j]
            right[i] = k
            if k < n:
                left[k] = i
                if (x := rank((parts[i], parts[k]), NONE)) != NONE:
                    heapq.heappush(heap, (x, i, parts[i], parts[k]))
            if (h := left[i]) >= 0 and (x := rank((parts[h], parts[i]), NONE)) != NONE:
                heapq.heappush(heap, (x, h, parts[h], parts[i]))
        return [p for p in parts if p >= 0]

    def split(self, text: str) -> list[str]:
        if SETTLED.fullmatch(text):
            return self.words(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def encode(self, text: str) -> list[int]:
        if self.added_split is None or not self.added_split.search(text):
            return list(chain.from_iterable(map(self.__getitem__, self.split(text))))
        ids, at = [], 0
        for m in self.added_split.finditer(text):
            ids += chain.from_iterable(map(self.__getitem__, self.split(text[at : m.start()])))
            ids.append(self.added[m[0]])
            at = m.end()
        return ids + list(chain.from_iterable(map(self.__getitem__, self.split(text[at:]))))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


def codec(path: str) -> Codec:
    """One codec for each Python worker and file."""
    return held(("bpe", path), lambda: Codec(path))


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array<int>) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in slices(batches):
            ids = [own.encode(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of each list of ids (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in slices(batches):
            texts = [own.decode(i or []) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each text: encoded, then decoded from its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in slices(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                ids = own.encode(text or "")
                decimal = ",".join(map(own.decimal.__getitem__, ids))
                rows.append((len(ids), sha(decimal.encode()), sha(own.decode(ids).encode())))
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            arrays = [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that few texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op10_bpe": op10_bpe}
