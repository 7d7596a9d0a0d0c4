"""Fragments as numbers, in NumPy: sequences are laid end to end and each run of k symbols becomes one integer.

Windows are as many as symbols, so they never travel as rows: what travels is the sequences, or pieces of them.
"""

from __future__ import annotations

from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Symbols that are worked on at a time, about; buckets that k-mers are dealt to; symbols of a bucket's minimizer.
AT_A_TIME, BUCKETS, SEED = 1 << 22, 1024, 11
BASES = "ACGT"  # in the order of strings
_CODE = np.full(256, 4, np.uint8)
_CODE[[ord(b) for b in BASES]] = range(4)
U = np.uint64


def symbols_of(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts end to end (as code points), and the number of each text's symbols."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.cast(pa.large_string()).combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_string())
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts), np.int64)
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    found = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    if len(found) and found.max() > 127:
        lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        return np.frombuffer(bytes(found).decode().encode("utf-32-le"), np.uint32), lengths
    return found, np.diff(offsets)


def coded(symbols: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """The place of each symbol among those present (in their order), the bits of a place, and the symbols present."""
    if symbols.dtype == np.uint8:
        present = np.flatnonzero(np.bincount(symbols, minlength=256))
        at = np.zeros(256, np.uint8)
        at[present] = range(len(present))
        return at[symbols], max(1, (len(present) - 1).bit_length()), present
    present, at = np.unique(symbols, return_inverse=True)
    return at, max(1, (len(present) - 1).bit_length()), present


def runs_packed(codes: np.ndarray, k: int, bits: int) -> np.ndarray:
    """Number of each run of k codes; k * bits is 64 at most."""
    part, size, out, done = codes.astype(U), 1, None, 0
    while True:
        if k & size:
            out = part if out is None else (out[: len(codes) - done - size + 1] << U(bits * size)) | part[done : len(codes) - size + 1]
            done += size
        if 2 * size > k:
            return out
        part = (part[: len(part) - size] << U(bits * size)) | part[size:]
        size *= 2


def numbered(codes: np.ndarray, k: int, bits: int) -> tuple[np.ndarray, int]:
    """A number for each run of k codes, equal for equal runs and ordered as they are, and its bits."""
    if len(codes) < k:
        return np.zeros(0, U), 1
    if k * bits <= 64:
        return runs_packed(codes, k, bits), k * bits
    half = k // 2
    (a, _), (b, _) = numbered(codes, half, bits), numbered(codes, k - half, bits)
    a, b, size = np.unique(a, return_inverse=True)[1], np.unique(b, return_inverse=True)[1], len(codes).bit_length()
    return (a[: len(codes) - k + 1].astype(U) << U(size)) | b[half:].astype(U), 2 * size


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))


def sizes(starts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(starts, n))


def ramp(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. below each count, end to end."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def slices(lengths: np.ndarray, most: int = AT_A_TIME) -> list[tuple[int, int]]:
    """Rows from..to that hold about so many symbols; a longer row is a slice of its own."""
    out, start, total = [], 0, 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > most:
            out.append((start, i))
            start, total = i, 0
        total += n
    return [*out, (start, len(lengths))] if start < len(lengths) else out


def text_slices(texts: pa.Array):
    """Rows from..to of a batch, and their texts, in slices of bounded size."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    for a, b in slices(lengths):
        yield a, b, texts.slice(a, b - a)


# ---- how often k-mers occur: neighbouring k-mers travel together in pieces of up to 64 symbols, to the bucket of their minimizer


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def pieces_of(text: bytes, k: int) -> tuple[np.ndarray, ...]:
    """bucket, high and low word, number of k-mers, count of each distinct piece, by bucket; k is 32 at most.

    Windows with a symbol outside BASES are not in any piece.
    """
    none = tuple(np.zeros(0, t) for t in (np.int64, U, U, np.uint8, np.uint32))
    codes = _CODE[np.frombuffer(text, np.uint8)]
    n = len(codes) - k + 1
    if n < 1:
        return none
    bad = np.concatenate([[0], np.cumsum(codes > 3)])
    valid = bad[k:] == bad[:-k]
    codes = np.concatenate([codes & 3, np.zeros(64, np.uint8)])
    m = min(k, SEED)
    low = _mixed(runs_packed(codes[: n + k - 1], m, 2))
    span, left = 1, k - m + 1  # sliding minimum by doubling
    while span < left:
        step = min(span, left - span)
        low, span = np.minimum(low[: len(low) - step], low[step:]), span + step
    bucket = (low[:n] & U(BUCKETS - 1)).astype(np.int16)
    bucket[~valid] = -1
    starts = runs(bucket)
    counts = sizes(starts, n)
    good = bucket[starts] >= 0
    starts, counts = starts[good], counts[good]
    most = min(64 - k + 1, 32)  # no k-mer begins beyond the first word
    cut = -(-counts // most)
    at = ramp(cut) * most
    starts, counts = np.repeat(starts, cut) + at, np.minimum(most, np.repeat(counts, cut) - at)
    if not len(starts):
        return none
    words, length = runs_packed(codes, 32, 2), counts + (k - 1)
    full = U(0xFFFFFFFFFFFFFFFF)
    # shifts by 64 are none, hence in two steps
    high = words[starts] & np.where(length >= 32, full, ~((full >> U(1)) >> (2 * np.minimum(length, 32) - 1).astype(U)))
    low = np.where(length > 32, words[np.minimum(starts + 32, len(words) - 1)] & ~((full >> U(1)) >> (2 * np.maximum(length - 32, 1) - 1).astype(U)), U(0))
    of = bucket[starts].astype(np.int64)
    order = np.lexsort((low, high, of * 64 + counts))
    of, high, low, counts = of[order], high[order], low[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (counts[1:] != counts[:-1]) | (high[1:] != high[:-1]) | (low[1:] != low[:-1])]))
    return of[first], high[first], low[first], counts[first].astype(np.uint8), sizes(first, len(of)).astype(np.uint32)


SENT = pa.schema([("bucket", pa.int32()), ("high", pa.binary()), ("low", pa.binary()), ("n", pa.binary()), ("times", pa.binary()), ("fragment", pa.string()), ("count", pa.int64())])
TALLIED = pa.schema([("n", pa.int64()), ("n_kmers", pa.int64()), ("first_kmer", pa.string())])


def sent_kmers(k: int):
    """Batches of texts -> what each bucket gets of them: packed pieces, and k-mers with other symbols as they are."""

    def rows(texts: list[str]) -> pa.RecordBatch | None:
        of, high, low, n, times = pieces_of("\n".join(texts).encode(), k)
        starts = runs(of)
        out = [[], [], [], [], [], [], []]
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(of)], strict=True):
            for column, x in zip(out, (int(of[a]), *(y[a:b].tobytes() for y in (high, low, n, times)), None, None), strict=True):
                column.append(x)
        plain = Counter()
        for text in texts:
            if text.strip(BASES):
                plain.update(f for i in range(len(text) - k + 1) if (f := text[i : i + k]).strip(BASES))
        for f, c in plain.items():
            for column, x in zip(out, (crc32(f.encode()) % BUCKETS, None, None, None, None, f, c), strict=True):
                column.append(x)
        return pa.record_batch([pa.array(c, t.type) for c, t in zip(out, SENT, strict=True)], schema=SENT)

    def run(batches):
        kept, size = [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                kept.append(text or "")
                size += len(kept[-1]) + 1
                if size >= AT_A_TIME:
                    yield rows(kept)
                    kept, size = [], 0
        if kept:
            yield rows(kept)

    return run


def expanded(high: np.ndarray, low: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """The k-mers of all pieces."""
    j = ramp(n).astype(U) << U(1)
    words = (np.repeat(high, n) << j) | ((np.repeat(low, n) >> U(1)) >> (U(63) - j))
    return words >> U(64 - 2 * k)


def added(plain: list[np.ndarray], keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often they are among the plain ones, or in the sums of their counts."""
    if plain:
        once = np.sort(np.concatenate(plain))  # far faster than sorting places
        starts = runs(once)
        keys, counts = [*keys, once[starts]], [*counts, sizes(starts, len(once))]
    if len(keys) == 1:
        return keys[0], counts[0]
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys)
    keys = keys[order]
    starts = runs(keys)
    return keys[starts], np.add.reduceat(counts[order], starts) if len(starts) else counts


def spelled(key: int, k: int) -> str:
    return "".join(BASES[key >> 2 * i & 3] for i in range(k - 1, -1, -1))


def tallied_kmers(k: int):
    """Rows of SENT in order of their bucket -> how many of each bucket's k-mers occur how often, and the first of them."""

    def told(once, keys, counts, plain):
        best: dict[int, list] = {}
        if once or keys:
            values, times = added(once, keys, counts)
            order = np.argsort(times, kind="stable")
            starts = runs(times[order])
            for s, c in zip(starts.tolist(), sizes(starts, len(order)).tolist(), strict=True):
                best[int(times[order[s]])] = [c, spelled(int(values[order[s]]), k)]
        for f, c in plain.items():
            b = best.setdefault(c, [0, f])
            b[0], b[1] = b[0] + 1, min(b[1], f)
        return pa.record_batch([pa.array(x, t.type) for x, t in zip(([*best], [b[0] for b in best.values()], [b[1] for b in best.values()]), TALLIED, strict=True)], schema=TALLIED)

    def run(batches):
        now, once, keys, counts, plain, fresh = None, [], [], [], Counter(), 0
        for batch in batches:
            for r in batch.to_pylist():
                if r["bucket"] != now:
                    if now is not None:
                        yield told(once, keys, counts, plain)
                    now, once, keys, counts, plain, fresh = r["bucket"], [], [], [], Counter(), 0
                if r["fragment"] is not None:
                    plain[r["fragment"]] += r["count"]
                    continue
                high, low, n, times = (np.frombuffer(r[c], t) for c, t in (("high", U), ("low", U), ("n", np.uint8), ("times", np.uint32)))
                n, often = n.astype(np.int64), times > 8
                few = np.repeat(np.flatnonzero(~often), times[~often])  # copies by themselves where there are few
                once.append(expanded(high[few], low[few], n[few], k))
                if often.any():
                    keys.append(expanded(high[often], low[often], n[often], k))
                    counts.append(np.repeat(times[often].astype(np.int64), n[often]))
                fresh += len(once[-1]) + (len(keys[-1]) if often.any() else 0)
                if fresh > max(AT_A_TIME, len(keys[0]) if keys else 0):
                    keys, counts = ([x] for x in added(once, keys, counts))
                    once, fresh = [], 0
        if now is not None:
            yield told(once, keys, counts, plain)

    return run


def windows_of(texts, k: int, before: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """row, place in the row and number of each run of k symbols, the numbers' bits, and the numbers of the runs of ``before``
    (symbols of another text, numbered alike)."""
    symbols, lengths = symbols_of(texts)
    ahead = 0 if before is None else len(before)
    codes, bits, _ = coded(symbols if before is None else np.concatenate([before, symbols]))
    number, width = numbered(codes, k, bits)
    n = np.maximum(lengths - k + 1, 0)
    row, at = np.repeat(np.arange(len(n)), n), ramp(n)
    return row, at, number[ahead + np.repeat(np.cumsum(lengths) - lengths, n) + at], width, number[: max(ahead - k + 1, 0)]


def set_sizes(k: int):
    """Batches of seq_ord and seq, equal seq_ord together -> seq_ord, n_kmers: distinct runs of k symbols, where there are any."""

    def told(ords: list[int], texts: list[str]) -> pa.RecordBatch:
        group, ords = runs(np.array(ords)), np.array(ords)
        row, _, number, width, _ = windows_of(pa.array(texts, pa.large_string()), k)
        if width + len(ords).bit_length() > 64:
            number = np.unique(number, return_inverse=True)[1].astype(U)
            width = len(number).bit_length()
        of = np.repeat(np.arange(len(group)), sizes(group, len(ords)))[row]
        pair = np.sort((of.astype(U) << U(width)) | number)
        n = np.bincount((pair[runs(pair)] >> U(width)).astype(np.int64), minlength=len(group))
        return pa.record_batch([pa.array(ords[group][n > 0], pa.int64()), pa.array(n[n > 0], pa.int64())], names=["seq_ord", "n_kmers"])

    def run(batches):
        ords, texts, size = [], [], 0
        for batch in batches:
            for o, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if size >= AT_A_TIME and o != ords[-1]:
                    yield told(ords, texts)
                    ords, texts, size = [], [], 0
                ords.append(o)
                texts.append(t or "")
                size += len(texts[-1])
        if ords:
            yield told(ords, texts)

    return run
