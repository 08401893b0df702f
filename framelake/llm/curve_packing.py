"""Packing along a space-filling curve.

Each document's token ids (with the end id) give a hashed vector: each id's share of them, projected by signs that a hash
of the id picks to DIMS coordinates. The coordinates' Hilbert key orders the documents, so that like
ones stand side by side; a hash of the row breaks ties, which also spreads large groups of copies over tasks. Along
that order documents are laid end to end and cut at every multiple of the sequence length, so that only the last
sequence has padding. Global offsets come from a range partition of the keys alone: running sums inside a partition
plus the totals of those before it. The ids are then joined to their offsets and cut.

A worker keeps the ids of runs between ASCII blanks (the tokenizer drops blanks and never joins across them), at most
MEMORY of them; then only those of the batch at hand stay. The vocabulary's special tokens, which a text may spell out in exactly their
letters, are single ids: texts are cut at them before anything is put in lower case.

Null or empty text: the end id alone. Repeated ids stay separate rows. Other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, id_text, mix, sliced, staged, staged_texts

DIMS, BITS = 3, 16
MEMORY = 200_000
_MARKS = b".,;:!?"
_encoders: dict[str, RunEncoder] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Byte-level tokenizers write a byte as the letter of its number; those that are no visible letter follow from 256 on.
_VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_LETTERS = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _VISIBLE)}


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}H", *ids)


class RunEncoder:
    """Token ids of texts as packed 16-bit integers, by way of a bounded memory of runs."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        if any(x.normalized or x.lstrip or x.rstrip or x.single_word for x in added.values()):
            raise ValueError("special tokens are found as they are spelt, with nothing around them")
        self.tokenizer.encode_special_tokens = True  # runs are in lower case, where a special token's letters are no special token
        self.between, self.end = next(((x.content, i) for i, x in added.items()), (None, None))
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        self.letters = self._letters_alone()
        self.special = re.compile("(" + "|".join(re.escape(x.content) for x in sorted(added.values(), key=lambda x: -len(x.content))) + ")") if added else None
        self.marked = {self._mark(x.content): _packed([i]) for i, x in added.items()}
        self.known: dict[bytes, bytes] = dict(self.marked)

    def _letters_alone(self):
        """The model, if the tokenizer hands it a run of small letters whole and byte by byte, so that such runs may go to it
        past the normaliser and the splitting expression, which take most of the time; None for any other tokenizer."""
        steps = json.loads(self.tokenizer.to_str())
        kinds = lambda x: [s["type"] for s in (x or {}).get("normalizers", (x or {}).get("pretokenizers", [x] if x else []))]
        splits = (steps["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        plain = kinds(steps["normalizer"]) == ["NFC", "Replace", "Lowercase"] and kinds(steps["pre_tokenizer"]) == ["Split", "ByteLevel"] and steps["model"]["type"] == "BPE"
        return self.tokenizer.model if plain and r"|[\p{L}]+|" in splits[0]["pattern"].get("Regex", "") and not splits[1]["add_prefix_space"] else None

    @staticmethod
    def _is_small_letters(run: str) -> bool:
        """Latin letters, composed and small, for which nothing is normalised and nothing splits."""
        return run.isalpha() and run.islower() and (run.isascii() or (max(run) < "\u0250" and run == run.lower() and unicodedata.is_normalized("NFC", run)))

    @staticmethod
    def _mark(special: str) -> bytes:
        """A key that no run has."""
        return b" " + special.encode()

    def runs(self, text: str) -> list[bytes]:
        if not self.special or not self.special.search(text):
            return text.encode("utf-8", "surrogatepass").lower().split()
        out: list[bytes] = []
        for i, part in enumerate(self.special.split(text)):
            out += [self._mark(part)] if i % 2 else part.encode("utf-8", "surrogatepass").lower().split()
        return out

    def tokenize(self, runs: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Runs and their ids. Many go to the tokenizer as one text, with a special token between them, at which it cuts
        before it does anything else; runs that spell a special token go one by one."""
        told = [r.decode("utf-8", "replace") for r in runs]
        if self.letters:
            other = []
            tokenize = self.letters.tokenize
            for i, (r, t) in enumerate(zip(runs, told, strict=True)):
                if self._is_small_letters(t):
                    yield r, _packed([x.id for x in tokenize(t if t.isascii() else r.decode("latin-1").translate(_BYTE_LETTERS))])
                else:
                    other.append(i)
            runs, told = [runs[i] for i in other], [told[i] for i in other]
        if self.between is None or any(self.special.search(t) for t in told):
            plain = [i for i, t in enumerate(told) if self.between is not None and not self.special.search(t)]
            alone = sorted(set(range(len(runs))).difference(plain))
            for i, e in zip(alone, self.tokenizer.encode_batch_fast([told[i] for i in alone], add_special_tokens=False), strict=True):
                yield runs[i], _packed(e.ids)
            runs, told = [runs[i] for i in plain], [told[i] for i in plain]
        if not runs:
            return
        self.tokenizer.encode_special_tokens = False  # one tokenizer serves both ways, as it takes 24 MB of a worker
        try:
            ids = np.array(self.tokenizer.encode_batch_fast([self.between.join(told)], add_special_tokens=False)[0].ids, "<u2")
        finally:
            self.tokenizer.encode_special_tokens = True
        ends = np.append(np.flatnonzero(ids == self.end), len(ids))
        raw = ids.tobytes()
        yield from zip(runs, (raw[a:b] for a, b in zip([0, *(2 * ends[:-1] + 2).tolist()], (2 * ends).tolist(), strict=True)), strict=True)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Runs are looked up in lower case, as the tokenizer takes them. A run that ends in one mark after a letter is
        its parts' ids, one after the other: the tokenizer cuts there too."""
        runs = [self.runs(t) for t in texts]
        known, met = self.known, set().union(*runs)
        if len(known) > MEMORY:
            kept = {r: known[r] for r in met if r in known}
            known.clear()
            known.update(kept | self.marked)
        new = met.difference(known)
        marked = [r for r in new if r[-1] in _MARKS and len(r) > 1 and 97 <= r[-2] <= 122]
        plain = new.difference(marked)
        plain.update(x for r in marked for x in (r[:-1], r[-1:]) if x not in known)
        plain = list(plain)
        for at in range(0, len(plain), 1 << 14):
            known.update(self.tokenize(plain[at : at + (1 << 14)]))
        for r in marked:
            known[r] = known[r[:-1]] + known[r[-1:]]
        out = [b"".join(map(known.__getitem__, rs)) for rs in runs]
        for r in new:
            if len(r) > 64:  # rare ones, and large
                known.pop(r, None)
        return out


def encoder(path: str) -> RunEncoder:
    if path not in _encoders:
        _encoders[path] = RunEncoder(path)
    return _encoders[path]


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The Hilbert index of integer points (rows), by Skilling's transposition, for all rows at once."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) > 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


@cache
def _signs() -> np.ndarray:
    """DIMS signs for every 16-bit id."""
    h = mix(np.arange(1 << 16, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(1))
    return np.stack([1 - 2 * ((h >> U64(k)) & U64(1)).astype(np.int8) for k in range(DIMS)])


def curve_keys(all_ids: list[np.ndarray]) -> np.ndarray:
    """One Hilbert key for each document's ids: the mean of their signs, spread over the grid."""
    if not all_ids:
        return np.zeros(0, np.int64)
    sizes = np.array([len(x) for x in all_ids])
    cat = np.concatenate(all_ids)
    starts = np.cumsum(sizes) - sizes
    points = np.stack([np.add.reduceat(row[cat], starts, dtype=np.int64) for row in _signs()], axis=1) / sizes[:, None]
    squashed = 0.5 + np.arctan(8 * points) / np.pi
    return hilbert(np.minimum((squashed * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def tokenized(docs: DataFrame, path: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, curve, ids): ids as little-endian 16-bit integers, the end id included."""
    path = path or default_vocabulary()
    end = np.array([end_id], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in sliced(batches):
            ids = [x + end for x in e.encode(batch.column(1).to_pylist())]
            keys = curve_keys([np.frombuffer(x, "<u2") for x in ids])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(keys, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n", "curve", "ids"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n long, curve long, ids binary")


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running token offsets inside a sorted partition; its first row names the partition."""
    total, first = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        if first is None:
            first = (batch.column(1)[0].as_py(), batch.column(0)[0].as_py())
        n = batch.column(2).to_numpy()
        at = total + np.cumsum(n) - n
        total = int(at[-1] + n[-1])
        size = batch.num_rows
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.int64()), batch.column(2), pa.array(np.full(size, first[0]), pa.int64()), pa.array(np.full(size, first[1]), pa.int64())], names=["row", "at", "n", "part_key", "part_row"])


def curve_offsets(keys: DataFrame) -> DataFrame:
    """(row, global_at) for rows of (row, key, n): tokens before each row in the order of key, then row. The running sums are
    written once, so that partitions' totals and rows come from the same bounds, which each planning would sample anew."""
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keys.select("row", "key", "n").repartitionByRange(parts, "key", "row").sortWithinPartitions("key", "row")
    local = staged(ordered.mapInArrow(_running, "row long, at long, n long, part_key long, part_row long"))
    before = Window.orderBy("part_key", "part_row").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    totals = local.groupBy("part_key", "part_row").agg(F.sum("n").alias("tokens")).select("part_row", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    return local.join(F.broadcast(totals), "part_row").select("row", (F.col("at") + F.col("base")).alias("global_at"))


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _cutter(size: int):
    names = [x.split()[0] for x in PIECES.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for doc_id, raw, at in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                wide = np.frombuffer(raw, "<u2").astype("<u4")
                n, start = len(wide), 0
                while start < n:
                    sequence, offset = divmod(at + start, size)
                    length = min(n - start, size - offset)
                    rows.append((doc_id, start, length, zlib.crc32(wide[start : start + length].tobytes()), n, sequence, offset))
                    start += length
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [()] * len(names))], names=names)

    return cut


def pack_along_curve(docs: DataFrame, size: int = 4096, path: str | None = None, end_id: int = 2) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence."""
    rows = staged_texts(tokenized(docs, path, end_id).withColumn("row", F.monotonically_increasing_id()))
    low = 63 - DIMS * BITS
    key = F.shiftleft("curve", low).bitwiseOR(F.shiftrightunsigned(F.xxhash64("row"), 64 - low))
    offsets = curve_offsets(rows.select("row", key.alias("key"), "n"))
    return rows.select("row", "doc_id", "ids").join(offsets, "row").select("doc_id", "ids", "global_at").mapInArrow(_cutter(size), PIECES)


def op8_packing(docs: DataFrame) -> DataFrame:
    return pack_along_curve(docs)
