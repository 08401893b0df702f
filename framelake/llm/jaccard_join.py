"""N-gram Jaccard join: a blocked sparse product of the document by shingle incidence matrix.

A document's set holds the 64-bit hashes of its windows of five lower-cased words. Documents with equal sets form a
class, and only its first document goes on. Under one global order of shingles (frequent ones last), two sets that
reach the threshold share a shingle among the first |A| - ceil(t|A|) + 1 of each (their heads), and their sizes differ
by no more than the factor t. One shuffle brings the heads' shingles together. Lists of up to SMALL classes give pairs,
whose overlap in the heads is counted; what else two sets may share is bounded by the longer tail plus the shingles of
the heads that stand in longer lists, and pairs that can't reach the threshold even so are dropped. In longer lists, in
the order of sizes, classes are tied to the first of their run until a step in size exceeds the factor. Shingles known
to be very frequent (FREQUENT at most) are dealt into lists of about HOT classes where they are read, and the runs of such
lists are chained afterwards; lists of others are as long as they occur, below the count at which that table ends. Both kinds of ties join classes into families.

Such ties hold long texts together that share one line, in families that grow faster than the input. So classes of a family
first meet by sketches of one to two bits a shingle: the parity of the shingles in each of n cells, n a power of two. The
cells in which two sketches differ (the longer one folded onto the shorter) are no more than the shingles that one set
alone has, so pairs that differ in too many can't be linked, and a family falls into those parts that the other pairs
hold together. Only classes that have such a pair send their sets.

The overlap counts of a family are the product of its incidence matrix with its transpose, computed block by block. A
family that is too large for one block is dealt into bands of sizes, each a factor t wide, and bands into blocks: only
blocks of one band or of two neighbouring ones can hold linked sets, and each such pair of blocks is a task of its own,
where stripes of rows meet only the rows whose sizes allow the threshold, and columns that one row alone has are left
out. Only what ties linked classes together, and each class's number of links, leaves a task, so rows never grow with
the square of a group. A set travels once for every block of its own and the neighbouring bands, which the count of
links of a large family of like texts and sizes needs.

The order of shingles only saves work; any order gives the same links. Its frequent ones are found by counting, in
every task, shingles that occur again among the texts it reads, and the most frequent FREQUENT of the sums are sent
to all tasks (8 MB at most).

Null or empty text: an empty set, linked with nothing. Documents without an id are not linked and have no component.
Rows that share id and text count as one document; a set is made from the rows that have its first id and that text's
digest. One id that has several texts stands in the class of each, and its
texts share a component. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import U64, drop_staged, id_text, mix, small_batches, span_hashes, staged, staged_path, staged_texts, windows, words_of
from .graph import components

WIDTH, PERCENT = 5, 80
FREQUENT = 1 << 19
SMALL, HOT = 16, 1000
BLOCK_ROWS, BLOCK_CELLS, SALTS, PIVOTS, SENT = 1024, 2_000_000, 32, 32, 100_000
SKETCH_ROWS, SKETCH_CELLS, SKETCH_WORDS = 4096, 32_000_000, 2_000_000


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of a text's windows of words; of all its words if there are fewer."""
    words = span_hashes(*words_of(text))
    if len(words) >= width:
        return np.unique(windows(words, width))
    return windows(words, len(words)) if len(words) else words


def class_keys(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit digests of a set."""
    if not len(s):
        return 0, 0
    a, b = mix(s + U64(len(s))), mix(s ^ U64(0xD6E8FEB86659FD93))
    sums = int(a.sum(dtype=U64)) + len(s), int(b.sum(dtype=U64)) + int(np.bitwise_xor.reduce(b))
    first, second = ((x + (1 << 63)) % (1 << 64) - (1 << 63) for x in sums)
    return first, second


def sketch(s: np.ndarray) -> bytes:
    """The parity of a set's shingles in each of n cells, n the least power of two, 64 at least, not below the set's size."""
    n = max(64, 1 << (len(s) - 1).bit_length()) if len(s) else 64
    odd = np.bincount((s & U64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Rows of 64-bit words of sketches, as sketches of the same sets with fewer cells."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def _profile(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """A row for each document (size, class and sketch), and rows of shingles that occur again here, with their counts."""
    names = ["doc_id", "size", "cls", "check", "digest", "sketch", "shingle", "times"]
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.binary(), *[pa.int64()] * 2]
    met: set[tuple[int, int]] = set()
    pool: list[np.ndarray] = []
    held = 0

    def again() -> pa.RecordBatch:
        u, c = np.unique(np.concatenate(pool) if pool else np.zeros(0, U64), return_counts=True)
        u, c = u[c > 1], c[c > 1]
        return pa.RecordBatch.from_arrays([*(pa.nulls(len(u), k) for k in kinds[:6]), pa.array(u.view(np.int64)), pa.array(c, pa.int64())], names=names)

    for batch in batches:
        rows = []
        for doc_id, text, digest in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            s = shingles(text, width)
            cls = class_keys(s)
            rows.append((doc_id, len(s), *cls, digest, sketch(s)))
            if cls not in met:
                if len(met) < 1 << 18:
                    met.add(cls)
                pool.append(s)
                held += len(s)
                if held > 4_000_000:
                    yield again()
                    pool, held = [], 0
        yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 6, kinds, strict=False)), *(pa.nulls(len(rows), k) for k in kinds[6:])], names=names)
    yield again()


def _prefixes(batches: Iterator[pa.RecordBatch], width: int, percent: int, hot: int, frequent) -> Iterator[pa.RecordBatch]:
    """(shingle, salt, cls, size) of each set's first shingles in the global order; salt is -1 where a list is not dealt."""
    hashes, ranks = frequent.value
    met: set[tuple[int, int]] = set()
    for batch in batches:
        out: list[tuple[np.ndarray, np.ndarray, int, int]] = []
        for text in batch.column(0).to_pylist():
            s = shingles(text, width)
            n = len(s)
            cls = class_keys(s)
            if not n or cls in met:
                continue
            if len(met) < 1 << 18:
                met.add(cls)
            keep = n - (percent * n + 99) // 100 + 1
            salt = np.full(keep, -1, np.int32)
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, s), len(hashes) - 1)
                rank = np.where(hashes[at] == s, ranks[at], 0)
                order = np.argsort(rank, kind="stable")[:keep]
                s, rank = s[order], rank[order]
                salt = np.where(rank > hot, np.int64(cls[1]) % (rank // hot + 1), -1).astype(np.int32)
            out.append((s[:keep], salt, cls[0], n))
        sizes = [len(x[0]) for x in out]
        cat, salts = (np.concatenate([x[k] for x in out]) if out else np.zeros(0, t) for k, t in ((0, U64), (1, np.int32)))
        cls, size = (np.repeat(np.array([x[k] for x in out], t), sizes) for k, t in ((2, np.int64), (3, np.int32)))
        yield pa.RecordBatch.from_arrays([pa.array(cat.view(np.int64)), pa.array(salts), pa.array(cls), pa.array(size)], names=["shingle", "salt", "cls", "size"])


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The set of each row whose text is one of the class that it is asked for."""
    for batch in batches:
        sets = [shingles(t, width) for t in batch.column("text").to_pylist()]
        same = [class_keys(s) == (a, b) for s, a, b in zip(sets, batch.column("cls").to_pylist(), batch.column("check").to_pylist(), strict=True)]
        kept = [n for n in batch.schema.names if n not in ("text", "check")]
        made = pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array([s.tobytes() for s in sets], pa.binary())], names=[*kept, "hashes"])
        yield made.filter(pa.array(same, pa.bool_()))


def overlaps(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Overlap counts of rows with columns (indices into sets), accumulated over chunks of shared shingles."""
    use = np.unique(np.concatenate([rows, columns]))
    cat = np.concatenate([sets[i] for i in use])
    owner = np.repeat(np.arange(len(use)), [len(sets[i]) for i in use])
    _, code, count = np.unique(cat, return_inverse=True, return_counts=True)
    shared = count > 1
    dense = np.cumsum(shared) - 1
    inside = shared[code]
    owner, code = owner[inside], dense[code[inside]]
    r, c = np.searchsorted(use, rows), np.searchsorted(use, columns)
    out = np.zeros((len(rows), len(columns)), np.float32)
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    step = max(256, min(4096, 8_000_000 // max(1, len(use))))
    for first in range(0, int(dense[-1]) + 1 if len(dense) else 0, step):
        lo, hi = np.searchsorted(code, [first, first + step])
        part = np.zeros((len(use), step), np.float32)
        part[owner[lo:hi], code[lo:hi] - first] = 1
        out += part[r] @ part[c].T
    return out


def _rooted(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after ties between a and b: hook on the least, then jump."""
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _plausible(key: tuple, table: pa.Table, percent: int) -> pa.Table:
    """Ties (a, b) of classes whose sketches leave a link possible, of one pair of blocks; key: family, band, step to the
    other band, i, j. A row of pairs ties its first class to all, and a column its first one, so ties are not squared."""
    _, once = np.unique(np.stack([table.column(c).to_numpy() for c in ("cls", "block")], axis=1), axis=0, return_index=True)
    table = table.take(pa.array(once))  # rows that share id and text
    cls, size, band, block = (table.column(c).to_numpy() for c in ("cls", "size", "band", "block"))
    low, step, i, j = (k.as_py() for k in key[1:])
    bits = [np.frombuffer(x, U64) for x in table.column("sketch").to_pylist()]
    words = np.array([len(b) for b in bits])
    order = np.argsort(size, kind="stable")
    left = order[(band[order] == low) & (block[order] == i)]
    right = order[(band[order] == low + step) & (block[order] == j)]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for wide in np.unique(words[left]):
        for other in np.intersect1d(np.unique(words[right]), [wide // 2, wide, 2 * wide]):  # the factor of sizes is below two
            n = min(wide, other)
            rows, columns = left[words[left] == wide], right[words[right] == other]
            a, b = (folded(np.stack([bits[k] for k in x]), n) for x in (rows, columns))
            many = int(max(1, min(256, SKETCH_WORDS // (n * len(columns)))))
            for at in range(0, len(rows), many):
                some = rows[at : at + many]
                lo, hi = np.searchsorted(size[columns], [-(-percent * size[some[0]] // 100), 100 * size[some[-1]] // percent + 1])
                if lo >= hi:
                    continue
                to = columns[lo:hi]
                apart = np.bitwise_count(a[at : at + many, None, :] ^ b[None, lo:hi, :]).sum(2, dtype=np.int64)
                x, y = size[some].astype(np.int64)[:, None], size[to].astype(np.int64)[None, :]
                ok = ((100 + percent) * apart <= (100 - percent) * (x + y)) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y)) & (some[:, None] != to[None, :])
                first = some[ok.argmax(0)]
                r, c = np.nonzero(ok)
                chains = np.unique(np.stack([some[r], first[c]]), axis=1) if len(r) else np.zeros((2, 0), np.int64)
                held = ok.any(0)
                found += [(to[held], first[held]), (chains[0], chains[1])]
    root = np.arange(len(cls))
    use = np.zeros(len(cls), bool)
    if found:
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        use[a] = use[b] = True
        root = _rooted(root, a, b)
    return pa.table({"a": cls[use], "b": cls[root[use]]})


def _linked(key: tuple, table: pa.Table, percent: int) -> pa.Table:
    """Ties (rep, root) and numbers of links of one pair of blocks; key: family, band, step to the other band, i, j."""
    _, once = np.unique(np.stack([table.column(c).to_numpy() for c in ("rep", "cls", "block")], axis=1), axis=0, return_index=True)
    table = table.take(pa.array(once))  # rows that share id and text
    reps, copies, band, block = (table.column(c).to_numpy() for c in ("rep", "copies", "band", "block"))
    sets = [np.frombuffer(x, U64) for x in table.column("hashes").to_pylist()]
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    low, step, i, j = (k.as_py() for k in key[1:])
    root = np.arange(len(sets))
    links = np.zeros(len(sets), np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    left = order[(band[order] == low) & (block[order] == i)]
    right = order[(band[order] == low + step) & (block[order] == j)]
    for at in range(0, len(left), 256):
        rows = left[at : at + 256]
        lo, hi = np.searchsorted(size[right], [-(-percent * size[rows[0]] // 100), 100 * size[rows[-1]] // percent + 1])
        columns = right[lo:hi]
        if not len(columns):
            continue
        both = np.rint(overlaps(sets, rows, columns)).astype(np.int64)
        union = size[rows][:, None] + size[columns][None, :] - both
        ok = (100 * both >= percent * union) & (rows[:, None] != columns[None, :])
        links[rows] += (ok * copies[columns][None, :]).sum(1)
        if step or i != j:
            links[columns] += (ok * copies[rows][:, None]).sum(0)
        a, b = np.nonzero(ok)
        found.append((rows[a], columns[b]))
    if found:
        root = _rooted(root, *(np.concatenate(x) for x in zip(*found, strict=True)))
    use = links > 0
    return pa.table({"rep": reps[use], "root": reps[root[use]], "links": links[use], "cls": table.column("cls").to_numpy()[use]})


def _frequent(profile: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that come last in the order, at most FREQUENT, with their ranks: a cut by powers of two keeps the bound."""
    counts = profile.where("times is not null").groupBy("shingle").agg(F.sum("times").alias("times")).where("times >= 8")
    level = F.floor(F.log2("times") * 4).cast("int")
    bins = counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()  # at most 256 rows
    total, least = 0, 1 << 30
    for level_, n in sorted(((r.level, r.n) for r in bins), reverse=True):
        if (total := total + n) > FREQUENT:
            break
        least = level_
    top = counts.where(level >= least).toPandas()
    hashes = top["shingle"].to_numpy(np.int64).view(U64) if len(top) else np.zeros(0, U64)
    order = np.argsort(hashes)
    times = top["times"].to_numpy(np.int64) if len(top) else np.zeros(0, np.int64)
    return hashes[order], times[order]


def _ties(lists: DataFrame, percent: int, paths: tuple[str, str]) -> DataFrame:
    """(a, b): classes that may be linked, or stand in one chain of such classes. lists: (shingle, salt, cls, size). What it
    writes on the way is in the paths, for as long as the result is read."""
    shared = staged(lists.withColumn("members", F.count("*").over(Window.partitionBy("shingle", "salt"))).where("members > 1 or salt >= 0"), paths[0])
    inside = shared.where((F.col("members") <= SMALL) & (F.col("salt") < 0)).groupBy("shingle").agg(F.array_sort(F.collect_set(F.struct("size", "cls"))).alias("s"))
    two = F.flatten(F.transform("s", lambda x, i: F.transform(F.filter(F.slice("s", i + 2, F.size("s")), lambda y: x["size"] * 100 >= y["size"] * percent), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    pairs = inside.where(F.size("s") > 1).select(F.explode(two).alias("p")).groupBy("p.x", "p.y").agg(F.count("*").alias("both"))
    pairs = pairs.select(F.col("x.cls").alias("a"), F.col("x.size").alias("na"), F.col("y.cls").alias("b"), F.col("y.size").alias("nb"), "both")

    long = shared.where((F.col("members") > SMALL) | (F.col("salt") >= 0))
    extra = long.groupBy("cls").agg(F.count_distinct("shingle").alias("q"))
    pairs = pairs.join(extra.select(F.col("cls").alias("a"), F.col("q").alias("qa")), "a", "left").join(extra.select(F.col("cls").alias("b"), F.col("q").alias("qb")), "b", "left")
    tail = lambda n: F.ceil(F.col(n) * percent / 100) - 1
    most = F.col("both") + F.least(F.coalesce("qa", F.lit(0)), F.coalesce("qb", F.lit(0))) + F.greatest(tail("na"), tail("nb"))
    close = pairs.where(most * (100 + percent) >= (F.col("na") + F.col("nb")) * percent).select("a", "b")

    along = Window.partitionBy("shingle", "salt").orderBy("size", "cls")
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = (F.lag("size").over(along) * 100 < F.col("size") * percent) | F.lag("size").over(along).isNull()
    runs = staged(long.withColumn("start", F.when(step, F.col("cls"))).withColumn("first", F.last("start", ignorenulls=True).over(so_far)).select("shingle", "salt", "cls", "size", "first"), paths[1])
    # Runs of the lists that one shingle is dealt into, chained in the same way.
    dealt = runs.where("salt >= 0").groupBy("shingle", "salt", "first").agg(F.min("size").alias("low"), F.max("size").alias("high"))
    over = Window.partitionBy("shingle").orderBy("low", "first")
    reach = F.max("high").over(over.rowsBetween(Window.unboundedPreceding, -1))
    chained = dealt.withColumn("start", F.when(reach.isNull() | (reach * 100 < F.col("low") * percent), F.col("first"))).withColumn("chain", F.last("start", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    tied = runs.where("first <> cls").select(F.col("first").alias("a"), F.col("cls").alias("b")).unionByName(chained.where("chain <> first").select(F.col("chain").alias("a"), F.col("first").alias("b")))
    return close.unionByName(tied).distinct()


def _blocks(members: DataFrame, percent: int, most: tuple[int, int] | None = None) -> DataFrame:
    """Members with their band, the number of its blocks, and of those of the bands beside it. What belongs to a large
    family meets its members under SALTS keys; a small one is a block of its own and joins nothing. most: rows and cells
    of a block."""
    block_rows, block_cells = most or (BLOCK_ROWS, BLOCK_CELLS)
    salted = members.withColumn("salt", F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int"))
    spread = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    whole = members.groupBy("family").agg(F.count("*").alias("n"), F.sum("size").alias("cells"))
    large = whole.where((F.col("n") > block_rows) | (F.col("cells") > block_cells)).select("family", F.lit(True).alias("large"))
    width = math.log(100 / percent) * (1 + 1e-9)
    banded = staged(salted.join(spread(large), ["family", "salt"], "left").withColumn("band", F.when(F.col("large"), F.floor(F.log("size") / width)).otherwise(0).cast("int")))
    load = banded.where("large").groupBy("family", "band").agg(F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(F.sum("size") / block_cells)).cast("int").alias("blocks"))
    beside = lambda by, name: load.select("family", (F.col("band") - by).alias("band"), F.col("blocks").alias(name))
    near = load.join(beside(1, "up"), ["family", "band"], "left").join(beside(-1, "down"), ["family", "band"], "left")
    return banded.join(spread(near), ["family", "band", "salt"], "left").na.fill(1, ["blocks"]).na.fill(0, ["up", "down"])


def _block_pairs(sets: DataFrame, columns: tuple[str, ...] = ("rep", "cls", "copies", "band", "block", "hashes")) -> DataFrame:
    """Every set once for each pair of blocks that it belongs to."""
    sets = sets.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))

    def pairs(n: str, band: Column, step: int, i, j) -> Column:
        others = F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.expr("cast(array() as array<int>)"))
        return F.transform(others, lambda o: F.struct(band.alias("low"), F.lit(step).alias("step"), i(o).alias("i"), j(o).alias("j")))

    own, band = F.col("block"), F.col("band")
    to = F.concat(
        pairs("blocks", band, 0, lambda o: F.least(own, o), lambda o: F.greatest(own, o)),
        pairs("up", band, 1, lambda o: own, lambda o: o),
        pairs("down", band - 1, 1, lambda o: o, lambda o: own),
    )
    return sets.withColumn("to", F.explode(to)).select(*columns, "family", "to.low", "to.step", "to.i", "to.j")


def _parted(members: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(cls, family) of those members that may have a link by their sketches, in the parts that such pairs hold together."""
    placed = _blocks(members, percent, (SKETCH_ROWS, SKETCH_CELLS)).select("rep", "digest", "cls", "check", "size", "family", "band", "blocks", "up", "down")
    sent = placed.join(sketches.withColumnRenamed("doc_id", "rep"), ["rep", "digest", "cls", "check"])
    met = _block_pairs(sent, ("cls", "size", "band", "block", "sketch")).groupBy("family", "low", "step", "i", "j")
    ties = met.applyInArrow(lambda key, table: _plausible(key, table, percent), "a long, b long")
    return components(ties).select(F.col("node").alias("cls"), F.col("component").alias("family"))


def _with_pivots(members: DataFrame) -> DataFrame:
    """Members with pivot: whether one is among the PIVOTS of its band of a large family, the first in the order of a hash."""
    first = Window.partitionBy("family", "band").orderBy(F.xxhash64("cls", F.lit(1)), "cls")
    chosen = members.where("large").select("cls", "family", "band", F.row_number().over(first).alias("n")).where(F.col("n") <= PIVOTS)  # pruned in every task
    return members.join(chosen.select("cls", F.lit(True).alias("pivot")), "cls", "left")


def _series(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))


def _pair(low: Column, step: int, i: Column, j: Column) -> Column:
    return F.struct(low.cast("int").alias("low"), F.lit(step).alias("step"), i.cast("int").alias("i"), j.cast("int").alias("j"))


_NO_PAIR = "cast(array() as array<struct<low:int,step:int,i:int,j:int>>)"
_PAIRED = ("rep", "cls", "copies", "band", "block", "hashes", "family", "to.low", "to.step", "to.i", "to.j")


def _pivot_pairs(sets: DataFrame) -> DataFrame:
    """Small families whole; of large ones every set in its block once for the pivots (block -1) of its own and the
    neighbouring bands, and the pivots once for each of those blocks."""
    own, band, pivots = F.col("own"), F.col("band"), F.lit(-1)
    sets = sets.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    meets = F.array(_pair(band, 0, pivots, own), _pair(band, 1, own, pivots), _pair(band - 1, 1, pivots, own))
    as_row = F.when(F.col("large"), meets).otherwise(F.array(_pair(band, 0, own, own)))
    as_pivot = F.when(
        F.col("pivot"),
        F.concat(
            F.transform(_series(F.col("blocks")), lambda o: _pair(band, 0, pivots, o)), F.transform(_series(F.col("up")), lambda o: _pair(band, 1, pivots, o)), F.transform(_series(F.col("down")), lambda o: _pair(band - 1, 1, o, pivots))
        ),
    ).otherwise(F.expr(_NO_PAIR))
    both = F.array(F.struct(own.alias("block"), as_row.alias("tos")), F.struct(pivots.alias("block"), as_pivot.alias("tos")))
    spread = sets.withColumn("as", F.explode(both)).withColumn("block", F.col("as.block")).withColumn("to", F.explode("as.tos"))
    return spread.select(*_PAIRED)


def _outside(members: DataFrame, joined: DataFrame) -> DataFrame:
    """The large families that the pivots have not made one: members with outer, whether one stands outside its family's
    largest component, the numbers of blocks of both kinds in its band (inner, outer), and of those of the bands beside."""
    parts = members.where("large").join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    sizes = parts.groupBy("family", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("family").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("kinds")).where("kinds > 1").select("family", "main")
    spread = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = parts.drop("blocks", "up", "down").withColumn("salt", F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int"))
    marked = staged(salted.join(spread(main), ["family", "salt"]).withColumn("outer", F.col("component") != F.col("main")).drop("main", "component"))
    count = lambda kind: F.greatest(F.ceil(F.count_if(kind) / BLOCK_ROWS), F.ceil(F.coalesce(F.sum(F.when(kind, F.col("size"))), F.lit(0)) / BLOCK_CELLS)).cast("int")
    load = marked.groupBy("family", "band").agg(count(~F.col("outer")).alias("in0"), count(F.col("outer")).alias("out0"))
    beside = lambda by, a, b: load.select("family", (F.col("band") - by).alias("band"), F.col("in0").alias(a), F.col("out0").alias(b))
    near = load.join(beside(1, "in_up", "out_up"), ["family", "band"], "left").join(beside(-1, "in_down", "out_down"), ["family", "band"], "left").na.fill(0)
    return marked.join(spread(near), ["family", "band", "salt"]).drop("salt", "large", "pivot")


def _outside_pairs(sets: DataFrame) -> DataFrame:
    """Pairs of blocks with an outer one in them: outer blocks count from 0, inner ones from -1 down. Two inner sets are
    in one component already, so they need not meet."""
    band, outer = F.col("band"), F.col("outer")
    own = F.when(outer, F.pmod(F.xxhash64("rep"), F.col("out0"))).otherwise(-1 - F.pmod(F.xxhash64("rep"), F.col("in0"))).cast("int")
    sets = sets.withColumn("block", own)
    mine = F.col("block")
    inner = lambda o: -1 - o
    with_outer = lambda here, up, down: [
        F.transform(_series(F.col(up)), lambda o: _pair(band, 1, mine, o)), F.transform(_series(F.col(down)), lambda o: _pair(band - 1, 1, o, mine)),
        F.transform(_series(F.col(here)), lambda o: _pair(band, 0, F.least(mine, o), F.greatest(mine, o))),
    ]
    with_inner = [
        F.transform(_series(F.col("in_up")), lambda o: _pair(band, 1, mine, inner(o))), F.transform(_series(F.col("in_down")), lambda o: _pair(band - 1, 1, inner(o), mine)),
        F.transform(_series(F.col("in0")), lambda o: _pair(band, 0, inner(o), mine)),
    ]
    to = F.concat(*with_outer("out0", "out_up", "out_down"), F.when(outer, F.concat(*with_inner)).otherwise(F.expr(_NO_PAIR)))
    return sets.withColumn("to", F.explode(to)).select(*_PAIRED)


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", count_links: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every document; n_links counts linked documents, copies included.

    Without count_links (n_links is null) a large family is first compared with PIVOTS sets of each band alone, and then only
    pairs with a set outside its largest component are: a family of near copies of one text takes work linear in its sets, and
    the components are the same."""
    spark = docs.sparkSession
    texts = id_text(docs, id_col, text_col)
    digested = texts.withColumn("digest", F.xxhash64("text"))
    profile = staged_texts(digested.mapInArrow(partial(_profile, width=width), "doc_id long, size int, cls long, check long, digest long, sketch binary, shingle long, times long"))
    frequent = spark.sparkContext.broadcast(_frequent(profile))
    rows = profile.where("times is null").select("doc_id", "size", "cls", "check", "digest")
    grouped = rows.where("size > 0 and doc_id is not null").groupBy("cls", "check", "size")
    classes = grouped.agg(F.min(F.struct("doc_id", "digest")).alias("first"), F.count_distinct("doc_id").alias("copies"))
    classes = classes.select("cls", "check", "size", F.col("first.doc_id").alias("rep"), F.col("first.digest").alias("digest"), "copies")

    lists = texts.where("doc_id is not null").select("text").mapInArrow(partial(_prefixes, width=width, percent=percent, hot=HOT, frequent=frequent), "shingle long, salt int, cls long, size int")
    paths = staged_path(spark), staged_path(spark)
    with small_batches(spark):
        families = components(_ties(lists, percent, paths))
    for path in paths:  # the ties are written by now
        drop_staged(spark, path)

    members = classes.join(families.select(F.col("node").alias("cls"), F.col("component").alias("family")), "cls")
    sketches = profile.where("times is null and size > 0 and doc_id is not null").select("doc_id", "digest", "cls", "check", "sketch")
    members = classes.join(_parted(members, sketches, percent), "cls")
    members = _blocks(members, percent)

    def product(placed: Callable[[DataFrame], DataFrame], chosen: DataFrame, few: bool = False) -> DataFrame:
        # By the text's digest too: an id with many texts has a class for each of them, and each asks for its own text alone.
        named = chosen.withColumn("doc_id", F.col("rep"))
        asked = digested.join(F.broadcast(named) if few else named, ["doc_id", "digest"]).drop("doc_id", "digest")
        kept = [f for f in asked.schema.fields if f.name not in ("text", "check")]
        sets = asked.mapInArrow(partial(_sets, width=width), StructType([*kept, StructField("hashes", BinaryType())]))
        tied = placed(sets).groupBy("family", "low", "step", "i", "j")
        return staged_texts(tied.applyInArrow(lambda key, table: _linked(key, table, percent), "rep long, root long, links long, cls long"))

    tied = lambda linked: linked.select(F.col("rep").alias("a"), F.col("root").alias("b")).distinct()
    columns = ["digest", "rep", "cls", "check", "family", "copies", "band", "blocks", "up", "down"]
    if count_links:
        linked = product(_block_pairs, members.select(*columns))
        joined = components(tied(linked))
    else:
        first = staged(_with_pivots(members).select(*columns, "size", "large", "pivot"))
        linked = product(_pivot_pairs, first)
        joined = components(tied(linked))
        rest = staged(_outside(first, joined))
        if n := rest.count():
            linked = linked.unionByName(product(_outside_pairs, rest, few=n <= SENT))  # few rows are sent to the texts
            joined = components(tied(linked))
    found = classes.join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left")
    if count_links:
        found = found.join(linked.groupBy("rep", "cls").agg(F.sum("links").alias("links")), ["rep", "cls"], "left")
    links = F.coalesce("links", F.lit(0)) + F.col("copies") - 1 if count_links else F.lit(None).cast("long")
    found = found.select("cls", "check", "size", F.coalesce("component", "rep").alias("component"), links.alias("n_links"))
    rows = rows.drop("digest")
    empty = rows.where("size = 0").select("*", F.lit(None).cast("long").alias("component"), F.lit(None).cast("long").alias("n_links"))  # one key, so not joined
    out = rows.where("size > 0").join(found, ["cls", "check", "size"], "left").select(*empty.columns).unionByName(empty)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("size").cast("long").alias("n_shingles"), component.alias("component_id"), F.when(F.lit(count_links), F.when(F.col("doc_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0)))).alias("n_links"))


def op6_jaccard_join(docs: DataFrame) -> DataFrame:
    return jaccard_components(docs)
