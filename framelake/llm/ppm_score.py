"""LM scoring by prediction by partial matching.

The model is a trie of byte contexts up to ORDER bytes, counted over the training documents; lower orders are sums of
the highest one, so the trie is a set of tables (context and symbol, count). A symbol unseen in a context escapes to
the next shorter one: of T occurrences of D distinct symbols a symbol with count c gets (c - 1/2) / T and the escape
D / 2T, and symbols that the longer context has seen are excluded below it: their counts leave T and D. Beyond
order 0 the symbols left share evenly. Bytes 0xFF, which no UTF-8 text has, stand before a text (ORDER of them) and end it.

Documents are dealt into blocks, packed and compressed together for the shuffle. A block asks for the distinct grams
and words it holds, with its own counts of them, by letters: one packed list of keys for each of at most FAN values of
the first digit of a hash of the key. Where that is not enough to spread the keys, the letters of FAN blocks with one
digit are merged and dealt again by the next digit, and so on, so the number of letters grows with the blocks (times
the digits, 2 up to 0.9 TB), not with their square. A part (all keys with the same digits) adds up the lists it gets, so
the model is a table spread by key; the log probability of every gram, with all escapes settled, is worked out by joins
of that table. Each part then answers its letters, the answers go back the way that the letters came, and the block
scores its documents. Nothing is broadcast, no task holds more than a block, the letters merged at once, or a part. A
word's key is a 62-bit hash.

Texts are scored with A-Z in lower case. Null or empty text: the end alone. Repeated rows count and score each. Null
ids count as the id ''. Without training documents all symbols are equally likely. Other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Callable, Iterator
from functools import partial
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, LOWER_BYTES, U64, id_text, mix, span_hashes, spans, staged

ORDER = 5
END_WORD = 1  # the key of the end, counted as a word
BLOCK_BYTES = 14_000_000
FAN = 256
GRAM, WORD = 0, 1
_PAD = b"\xff" * ORDER


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The key of ORDER + 1 bytes that ends at each symbol of all texts, their ends too, and each text's first position."""
    stream = np.frombuffer(_PAD + b"".join(t + _PAD for t in texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    firsts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
    keys = np.zeros(len(stream) - ORDER, U64)
    for k in range(ORDER + 1):
        keys = (keys << U64(8)) | stream[k : k + len(keys)]
    use = np.ones(len(keys), bool)
    ends = np.cumsum(sizes + ORDER - 1) - ORDER  # where each text's end symbol stands
    for k in range(1, ORDER):
        use[(ends + k)[ends + k < len(use)]] = False
    return keys[use], firsts


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all texts' words, each text's end after its own, and each text's first position."""
    buf = np.frombuffer(b" ".join(texts), np.uint8)
    starts, ends = spans(~BLANK[buf])
    keys = span_hashes(buf, starts, ends) >> U64(2) | U64(2)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    stops = np.searchsorted(starts, np.cumsum(sizes))
    keys = np.insert(keys, stops, U64(END_WORD))
    stops = stops + np.arange(1, len(texts) + 1)
    return keys, np.concatenate(([0], stops[:-1]))


def _slices(docs: list[tuple], size: int = 1 << 19) -> Iterator[tuple[bool, list[tuple], list[bytes]]]:
    """Whether held out, documents and lower-cased texts of runs of documents, about so many bytes each."""
    for held, own in groupby(docs, key=lambda d: d[2]):
        part: list[tuple] = []
        texts: list[bytes] = []
        total = 0
        for d in own:
            raw = d[1].encode("utf-8", "surrogatepass").translate(LOWER_BYTES)
            if part and total + len(raw) > size:
                yield held, part, texts
                part, texts, total = [], [], 0
            part.append(d)
            texts.append(raw)
            total += len(raw)
        if part:
            yield held, part, texts


def _pack(x: np.ndarray) -> bytes:
    """Numbers with their byte planes together, compressed."""
    return zlib.compress(np.ascontiguousarray(x.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _pack_sorted(x: np.ndarray) -> bytes:
    return _pack(np.diff(x.astype(np.int64), prepend=np.int64(0)))


def _unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.int64).ravel()


def _unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpack(raw))


def _squeeze(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=6).compress(raw, asbytes=True)


def _expand(raw: bytes) -> bytes:
    return pa.Codec("zstd").decompress(raw[8:], int.from_bytes(raw[:8], "little"), asbytes=True)


def _bundles(batches: Iterator[pa.RecordBatch], size: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Documents of each block, many to a compressed row."""
    pool: dict[int, list[tuple]] = {}
    held = 0

    def flush() -> pa.RecordBatch:
        rows = [(block, _squeeze(pickle.dumps(docs, 5))) for block, docs in pool.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["block", "docs"])

    for batch in batches:
        for doc_id, text, held_out, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            pool.setdefault(block, []).append((doc_id, text, held_out))
            held += len(text)
            if held > size * 16:
                yield flush()
                pool, held = {}, 0
    if pool:
        yield flush()


def _documents(table: pa.Table) -> list[tuple]:
    """A block's documents, in an order that does not depend on how its rows came."""
    docs = [d for raw in table.column("docs").to_pylist() for d in pickle.loads(_expand(raw))]
    return sorted(docs, key=lambda d: (d[2], d[0] is None, d[0] or 0, d[1]))


def _distinct(docs: list[tuple]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted distinct grams, then words, of a block, with their training counts."""
    made = []
    for keys_of in (_grams, _words):
        seen: list[tuple[np.ndarray, np.ndarray]] = []
        for held, _, texts in _slices(docs, 1 << 21 if keys_of is _grams else 1 << 19):
            u, c = np.unique(keys_of(texts)[0], return_counts=True)
            seen.append((u, c * (not held)))
        keys, inverse = np.unique(np.concatenate([u for u, _ in seen]), return_inverse=True)
        made.append((keys, np.bincount(inverse, np.concatenate([c for _, c in seen]), len(keys)).astype(np.int64)))
    return made


class Index:
    """Positions of keys in a sorted array, by slots of a hash: a few passes over a table that fits a cache."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys)).bit_length() + 1)
        slot = self._slot(keys)
        self.order = np.argsort(slot, kind="stable").astype(np.int32)
        self.keys = np.append(keys[self.order], U64(0))
        self.first = np.searchsorted(slot[self.order], np.arange(1 << self.bits, dtype=np.int64)).astype(np.int32)
        self.order = np.append(self.order, np.int32(0))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """All keys must be there."""
        at = self.first[self._slot(keys)]
        left = np.flatnonzero(self.keys[at] != keys)
        while len(left):
            at[left] += 1
            left = left[self.keys[at[left]] != keys[left]]
        return self.order[at]


def _dealt(keys: np.ndarray, fan: int, digit: int = 0) -> list[np.ndarray]:
    """Positions of the keys with each value of a digit of their hash, in order."""
    part = (mix(keys) >> U64(20)) // U64(fan**digit) % U64(fan)
    order = np.argsort(part, kind="stable")
    return np.split(order, np.searchsorted(part[order], np.arange(1, fan, dtype=U64)))


#: Lists from a sender (a block, or where letters were merged) to all keys with the digits of "to".
LETTERS = "sender long, to long, grams binary, gram_counts binary, words binary, word_counts binary"
ANSWERS = "sender long, to long, gram_values binary, word_values binary"
_KINDS = (("grams", "gram_counts", "gram_values"), ("words", "word_counts", "word_values"))


def _table(rows: list[tuple], schema: str) -> pa.Table:
    fields = [f.split() for f in schema.split(", ")]
    return pa.table([pa.array(c, pa.int64() if k == "long" else pa.binary()) for c, (_, k) in zip(zip(*rows, strict=True) if rows else [()] * len(fields), fields, strict=True)], names=[n for n, _ in fields])


def _letters(sender: int, to: int, lists: list[tuple[np.ndarray, np.ndarray]], fan: int, digit: int) -> pa.Table:
    """A letter for each value of the digit that occurs. lists: keys and counts of grams, then of words."""
    (grams, gc), (words, wc) = lists
    rows = []
    for d, (g, w) in enumerate(zip(_dealt(grams, fan, digit), _dealt(words, fan, digit), strict=True)):
        if len(g) or len(w):
            rows.append((sender, to * fan + d, _pack_sorted(grams[g]), _pack(gc[g]), _pack_sorted(words[w]), _pack(wc[w])))
    return _table(rows, LETTERS)


def _ask(table: pa.Table, fan: int) -> pa.Table:
    return _letters(table.column("block")[0].as_py(), 0, _distinct(_documents(table)), fan, 0)


def _sums(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct keys of all lists, and their counts added up."""
    out = []
    for keys, counts, _ in _KINDS:
        u, inverse = np.unique(np.concatenate([_unpack_sorted(x) for x in table.column(keys).to_pylist()]), return_inverse=True)
        out.append((u.astype(U64), np.bincount(inverse, np.concatenate([_unpack(x) for x in table.column(counts).to_pylist()]), len(u)).astype(np.int64)))
    return out


def _merger(fan: int, digit: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """The letters of one place and bundle of senders as one sender's, dealt by the next digit."""

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        return _letters(key[1].as_py(), key[0].as_py(), _sums(table), fan, digit)

    return merge


def _add_up(table: pa.Table) -> pa.Table:
    """Total training counts of a part's keys."""
    sums = _sums(table)
    n = sum(len(u) for u, _ in sums)
    return pa.table({
        "part": pa.array(np.full(n, table.column("to")[0].as_py()), pa.int64()), "kind": pa.array(np.concatenate([np.full(len(u), k) for k, (u, _) in zip((GRAM, WORD), sums, strict=True)]), pa.int8()),
        "key": pa.array(np.concatenate([u for u, _ in sums]).view(np.int64), pa.int64()), "c": pa.array(np.concatenate([c for _, c in sums]), pa.int64()),
    })


def _replies(asked: pa.Table, tables: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    """For each letter its grams' log probabilities and its words' counts, in the order of its lists."""
    rows = []
    for sender, to, grams, words in zip(*(asked.column(c).to_pylist() for c in ("sender", "to", "grams", "words")), strict=True):
        g, w = (v[np.searchsorted(k, _unpack_sorted(x))] if len(k) else np.zeros(0) for (k, v), x in zip(tables, (grams, words), strict=True))
        rows.append((sender, to, g.astype(np.float32).tobytes(), zlib.compress(w.astype(np.int64).tobytes(), 1)))
    return _table(rows, ANSWERS)


def _answer(asked: pa.Table, model: pa.Table) -> pa.Table:
    tables = []
    for kind in (GRAM, WORD):
        at = model.column("kind").to_numpy() == kind
        keys, values = model.column("key").to_numpy()[at], model.column("value").to_numpy()[at]
        order = np.argsort(keys)
        tables.append((keys[order], values[order]))
    return _replies(asked, tables)


def _values(lists: list[np.ndarray], answers: pa.Table, fan: int, digit: int) -> list[np.ndarray]:
    """Values of grams and words, put together from the answers to the letters that they were dealt into."""
    out = [np.zeros(len(lists[0])), np.zeros(len(lists[1]), np.int64)]
    dealt = [_dealt(keys, fan, digit) for keys in lists]
    for to, g, w in zip(*(answers.column(c).to_pylist() for c in ("to", "gram_values", "word_values")), strict=True):
        out[GRAM][dealt[GRAM][to % fan]] = np.frombuffer(g, np.float32)
        out[WORD][dealt[WORD][to % fan]] = np.frombuffer(zlib.decompress(w), np.int64)
    return out


def _pass_back(fan: int, digit: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Answers to merged letters as answers to those that they were merged from."""

    def back(asked: pa.Table, answers: pa.Table) -> pa.Table:
        keys = [u for u, _ in _sums(asked)]
        return _replies(asked, [(k.view(np.int64), v) for k, v in zip(keys, _values(keys, answers, fan, digit), strict=True)])

    return back


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _scored(docs: pa.Table, answers: pa.Table, fan: int, tokens: int, distinct: int) -> pa.Table:
    """A block's documents with the values of their keys."""
    rows: list[tuple] = []
    if docs.num_rows:
        own = _documents(docs)
        (grams, _), (words, _) = _distinct(own)
        gv, wv = _values([grams, words], answers, fan, 0)
        base = np.log10((wv + 0.1) / (tokens + 0.1 * (distinct + 1)))
        gram_index, word_index = Index(grams), Index(words)
        for held, part, texts in _slices(own):
            keys, first_gram = _grams(texts)
            score = np.add.reduceat(gv[gram_index.find(keys)], first_gram)
            keys, first_word = _words(texts)
            at = word_index.find(keys)
            n = np.diff(np.append(first_word, len(keys)))
            known, low = np.add.reduceat((wv[at] > 0).astype(np.int64), first_word), np.add.reduceat(base[at], first_word)
            rows += zip((d[0] for d in part), [held] * len(part), n.tolist(), known.tolist(), low.tolist(), score.tolist(), strict=True)
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SCORES.split(", ")])


def gram_values(grams: DataFrame) -> DataFrame:
    """(key, value): the log10 probability of each gram's last byte after the others, escapes and exclusion included.

    grams: (key, c), c the training count, 0 for grams that only held-out documents have.
    """
    low = [(1 << 8 * (k + 1)) - 1 for k in range(ORDER + 1)]  # the last k + 1 bytes: order k
    part = lambda c, k: F.col(c).bitwiseAND(low[k])
    context = lambda c, k: F.shiftright(part(c, k), 8)
    seen: dict[int, DataFrame] = {ORDER: grams.where("c > 0").select(F.col("key").alias("g"), "c")}
    for k in range(ORDER - 1, -1, -1):
        seen[k] = staged(seen[k + 1].groupBy(part("g", k).alias("g")).agg(F.sum("c").alias("c")))
    stats = {k: seen[k].groupBy(F.shiftright("g", 8).alias("x")).agg(F.sum("c").alias("t"), F.count("*").alias("d")) for k in seen}
    # By the longer context: how much of the shorter one's occurrences belongs to symbols that the longer one has seen.
    excluded = {
        k: seen[k + 1].select("g", part("g", k).alias("short")).join(seen[k].select(F.col("g").alias("short"), "c"), "short").groupBy(F.shiftright("g", 8).alias("x")).agg(F.sum("c").alias("xt"), F.count("*").alias("xd"))
        for k in range(ORDER)
    }
    out = grams.select("key", "c", F.lit(0.0).alias("value"), (F.col("c") > 0).alias("done"))
    left = out.where("not done").select("key", F.lit(0.0).alias("value"), F.lit(False).alias("done"))
    top = stats[ORDER]
    done = seen[ORDER].withColumn("x", F.shiftright("g", 8)).join(top, "x").select(F.col("g").alias("key"), F.log10((F.col("c") - 0.5) / F.col("t")).alias("value"))
    for k in range(ORDER, -1, -1):
        own = stats[k].select(F.col("x").alias("x"), "t", "d")
        left = left.withColumn("x", context("key", k)).join(own, "x", "left").drop("x")
        if k < ORDER:
            left = left.withColumn("x", context("key", k + 1)).join(excluded[k], "x", "left").drop("x")
            left = left.withColumn("s", part("key", k)).join(seen[k].select(F.col("g").alias("s"), "c"), "s", "left").drop("s")
        else:
            left = left.withColumn("xt", F.lit(0)).withColumn("xd", F.lit(0)).withColumn("c", F.lit(None).cast("long"))
        total, kinds = F.col("t") - F.coalesce("xt", F.lit(0)), F.col("d") - F.coalesce("xd", F.lit(0))
        whole = total + kinds  # 0 where the context is new or the longer one has seen all its symbols: no step is coded
        coded: Column = ~F.col("done") & F.col("t").isNotNull() & (kinds > 0)
        hit = coded & F.col("c").isNotNull()
        step = F.when(hit, F.log10((F.col("c") - 0.5) / total)).when(coded, F.log10(kinds * 0.5 / total)).otherwise(F.lit(0.0))
        left = left.select("key", (F.col("value") + step).alias("value"), (F.col("done") | hit).alias("done"), *([F.col("d").alias("d0")] if k == 0 else []))
    rest = F.log10(1.0 / (256 - F.coalesce("d0", F.lit(0))))
    return done.unionByName(left.select("key", F.when(F.col("done"), F.col("value")).otherwise(F.col("value") + rest).alias("value")))


def score_documents(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Scores of all documents by a model trained on those for which held_out (over doc_id) is false."""
    texts = id_text(docs, id_col, text_col).withColumn("held", F.coalesce(held_out, F.lit(False)))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(2, math.ceil(size / block_bytes))
    digits = next(d for d in range(1, 64) if FAN**d >= n)
    fan = max(2, math.ceil(max(n, 12) ** (1 / digits)))
    dealt = texts.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("long")).mapInArrow(_bundles, "block long, docs binary")
    blocks = dealt.repartition(n, "block").groupBy("block")
    letters = [staged(blocks.applyInArrow(lambda table: _ask(table, fan), LETTERS))]
    bundle = F.floor(F.col("sender") / fan).cast("long").alias("bundle")
    for digit in range(1, digits):
        places = letters[-1].withColumn("bundle", bundle).repartition(n, "to", "bundle").groupBy("to", "bundle")
        letters.append(staged(places.applyInArrow(_merger(fan, digit), LETTERS)))
    parts = max(n, 12)
    counts = staged(letters[-1].repartition(parts, "to").groupBy("to").applyInArrow(_add_up, "part long, kind byte, key long, c long"))
    words = counts.where(F.col("kind") == WORD)
    tokens, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    grams = counts.where(F.col("kind") == GRAM)
    values = grams.select("part", "kind", "key").join(gram_values(grams.select("key", "c")), "key").select("part", "kind", "key", "value")
    model = values.unionByName(words.select("part", "kind", "key", F.col("c").cast("double").alias("value"))).repartition(parts, "part")
    answers = letters[-1].select("sender", "to", "grams", "words").repartition(parts, "to").groupBy("to").cogroup(model.groupBy("part")).applyInArrow(_answer, ANSWERS)
    for digit in range(digits - 1, 0, -1):
        asked = letters[digit - 1].withColumn("bundle", bundle).repartition(n, "to", "bundle").groupBy("to", "bundle")
        got = answers.withColumn("place", F.floor(F.col("to") / fan).cast("long")).repartition(n, "place", "sender").groupBy("place", "sender")
        answers = asked.cogroup(got).applyInArrow(_pass_back(fan, digit), ANSWERS)
    score = partial(_scored, fan=fan, tokens=int(tokens), distinct=int(distinct))
    scored = blocks.cogroup(answers.repartition(n, "sender").groupBy("sender")).applyInArrow(lambda a, b: score(a, b), SCORES)
    return scored.withColumn("train_tokens", F.lit(int(tokens)).cast("long"))


def op5_lm_score(docs: DataFrame) -> DataFrame:
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0
    return score_documents(docs, held).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
