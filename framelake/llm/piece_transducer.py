"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Three machines are compiled from the model file: the normaliser (the leading blank if the model asks for one, blanks to
U+2581), the pieces (a trie whose final states emit them) and byte fallback for characters that no piece spells. Each
input is composed with them: the arcs of its lattice are found for all positions at once, one character deeper at a
time. Its states are (position, last piece), and the encoding is the shortest path in the tropical semiring: distances
are relaxed forward, position by position, each to the minimum over arcs of distance plus weight.

A merge model's pieces have no weights of their own that could say which segmentation it makes. The weights compiled
from its merges stand on pairs: an arc weighs one, plus APART where its piece and the last one would not both come out
of the merges of the two side by side (each pair is worked out once in a worker, when it is first met, and kept in a
table of two bits a pair). A segmentation is the model's own exactly when no pair of neighbours is like that, so at each
position the least distance belongs to one last piece, and only that state is kept.

Where no piece holds two characters side by side, no merge can cross between them, and the input is cut; what is
composed are the distinct atoms of a batch of texts, all in step. Workers keep what became of runs and atoms (at most
MEMORY of each, then they start anew). Atoms of more than LONG characters are composed alone.

Models with another normaliser than these (a character map, blanks removed or kept as they are, blanks as suffixes),
with user-defined pieces, without byte fallback or of another type than BPE are refused.

Null or empty text: no ids. U+2581 in a text decodes as a blank, as in the original; everything else comes back
exactly. Repeated rows each give a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import U64, id_text

MEMORY = 600_000
LONG = 64
APART = 1 << 20
BLANK = "▁"
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_compiled: dict[str, Transducer] = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of every field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, raw[at : at + n]
        at += n


@dataclass(frozen=True)
class Model:
    """What a model file says: pieces with scores and kinds, and whether a blank goes before each text."""

    names: list[str]
    scores: list[float]
    kinds: list[int]
    prefix: bool


def read_model(path: str) -> Model:
    with open(path, "rb") as f:
        raw = f.read()
    names, scores, kinds = [], [], []
    trainer: dict[int, int | bytes] = {}
    spec: dict[int, int | bytes] = {}
    for number, value in _fields(raw):
        if number == 1:
            piece = dict(_fields(value))
            names.append(piece.get(1, b"").decode())
            scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            kinds.append(piece.get(3, NORMAL))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            spec = dict(_fields(value))
    if trainer.get(3, 1) != 2 or not trainer.get(35, 0) or trainer.get(24, 0) or USER in kinds:
        raise ValueError("only BPE models with byte fallback, blanks before words and no user-defined pieces are compiled")
    if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1):
        raise ValueError("only normalisers that do no more than turn blanks into U+2581 are compiled")
    return Model(names, scores, kinds, bool(spec.get(3, 1)))


class Table:
    """Whole numbers by whole numbers, open addressing; looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = int(len(keys)).bit_length() + 2
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            self.keys[slot[free]] = keys[free]
            stands = self.keys[slot[left]] == keys[left]
            self.values[slot[left[stands]]] = values[left[stands]]
            left = left[~stands]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 for keys that are not there."""
        slot = self._slot(keys)
        left = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            at = self.keys[slot[left]]
            left = left[(at != keys[left]) & (at >= 0)]
        return np.where(self.keys[slot] == keys, self.values[slot], -1)


class Transducer:
    """The compiled machines of one model."""

    def __init__(self, path: str):
        model = read_model(path)
        n = len(model.names)
        if n > 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        self.names, self.prefix, self.start = model.names, model.prefix, n
        bytes_ = {int(x[3:5], 16): i for i, (x, k) in enumerate(zip(model.names, model.kinds, strict=True)) if k == BYTE}
        self.byte_ids = [np.array([bytes_[b]], "<u2").tobytes() for b in range(256)]
        spoken = {i: bytes((b,)) for b, i in bytes_.items()}
        self.spoken = [spoken.get(i, x.replace(BLANK, " ").encode() if k == NORMAL else b"") for i, (x, k) in enumerate(zip(model.names, model.kinds, strict=True))]

        self.id_of = {x: i for i, (x, k) in enumerate(zip(model.names, model.kinds, strict=True)) if k == NORMAL}
        self.rank = {x: -model.scores[i] for x, i in self.id_of.items()}
        alphabet = sorted({c for x in self.id_of for c in x})
        if any(c not in self.id_of for c in alphabet):
            raise ValueError("a character of a piece is no piece")
        if any(BLANK in x.lstrip(BLANK) for x in self.id_of):
            raise ValueError("a piece spans a blank; runs can't be composed apart")
        self.n_classes = len(alphabet) + 1
        self.classes = np.zeros(0x110000, np.int32)
        self.classes[[ord(c) for c in alphabet]] = np.arange(1, self.n_classes)

        nodes: dict[tuple[int, str], int] = {}
        final = [-1]
        for x, i in self.id_of.items():
            node = 0
            for c in x:
                node = nodes.setdefault((node, c), len(final))
                if node == len(final):
                    final.append(-1)
            final[node] = i
        self.final = np.array(final, np.int32)
        self.arcs = Table(np.array([a * self.n_classes + self.classes[ord(c)] for a, c in nodes], np.int64), np.array(list(nodes.values()), np.int32))
        self.depth = max(map(len, self.id_of))
        beside = sorted({(x[k], x[k + 1]) for x in self.id_of for k in range(len(x) - 1)})
        self.beside = Table(np.array([self.classes[ord(a)] * self.n_classes + self.classes[ord(b)] for a, b in beside], np.int64), np.zeros(len(beside), np.int32))
        #: Two bits a pair (last piece, piece): 0 not worked out, 1 they stand, 2 they don't. Untouched rows take no memory.
        self.pairs = np.zeros((n + 1, (n + 3) // 4), np.uint8)

        self.breaks = "\n" not in alphabet  # then no piece crosses a line's end either
        self.run = re.compile(r"\n[^ \n]*| +[^ \n]*" if self.breaks else r" +[^ ]*")
        self.runs: dict[str, bytes] = {}
        self.atoms: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """What the model's merges make of a short string: the best-ranked neighbours first, the leftmost of equals."""
        parts, get, none = list(text), self.rank.get, float("inf")
        ranks = [get(x + y, none) for x, y in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) < none:
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = get(parts[at - 1] + parts[at], none)
            if at < len(ranks):
                ranks[at] = get(parts[at] + parts[at + 1], none)
        return parts

    def stands(self, a: int, b: int) -> bool:
        """Whether piece b may follow piece a; a is self.start at the beginning."""
        if a == self.start:
            return self.merged(self.names[b]) == [self.names[b]]
        x, y = self.names[a], self.names[b]
        return self.merged(x + y) == [x, y]

    def weights(self, last: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """The weights of arcs by last piece and piece."""
        shift = ((piece & 3) << 1).astype(np.uint8)
        known = (self.pairs[last, piece >> 2] >> shift) & 3
        if not known.all():
            new = known == 0
            for key in np.unique(last[new].astype(np.int64) << 16 | piece[new]).tolist():
                a, b = key >> 16, key & 0xFFFF
                self.pairs[a, b >> 2] |= (1 if self.stands(a, b) else 2) << ((b & 3) << 1)
            known = (self.pairs[last, piece >> 2] >> shift) & 3
        return np.where(known == 1, 1, 1 + APART).astype(np.int64)

    def compose(self, atoms: list[str]) -> list[bytes]:
        """The shortest paths of atoms, all in step. Every character is spelt by some piece."""
        if not atoms:
            return []
        sizes = np.fromiter(map(len, atoms), np.int64, len(atoms))
        code = self.classes[np.frombuffer("".join(atoms).encode("utf-32-le", "surrogatepass"), "<u4")]
        ends = np.cumsum(sizes)
        of = np.repeat(np.arange(len(atoms)), sizes)
        stop = ends[of]
        starts: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        pieces: list[np.ndarray] = []
        at, node = np.arange(len(code)), np.zeros(len(code), np.int32)
        for d in range(self.depth):
            inside = at + d < stop[at]
            at, node = at[inside], node[inside]
            node = self.arcs.find(node.astype(np.int64) * self.n_classes + code[at + d])
            at, node = at[node >= 0], node[node >= 0]
            if not len(at):
                break
            hit = self.final[node] >= 0
            starts.append(at[hit])
            lengths.append(np.full(int(hit.sum()), d + 1))
            pieces.append(self.final[node[hit]])
        start, length, piece = map(np.concatenate, (starts, lengths, pieces))
        step = start - (ends - sizes)[of[start]]
        order = np.argsort(step, kind="stable")
        start, length, piece, step = start[order], length[order], piece[order], step[order]
        state = start + of[start]  # one more state than characters in every atom
        goal = state + length
        first = ends - sizes + np.arange(len(atoms))
        distance = np.full(len(code) + len(atoms), np.iinfo(np.int64).max >> 1)
        last = np.full(len(distance), self.start, np.int64)
        came = np.zeros(len(distance), np.int64)
        distance[first] = 0
        cuts = np.searchsorted(step, np.arange(int(sizes.max()) + 1))
        for lo, hi in zip(cuts, [*cuts[1:], len(step)], strict=True):
            s, g, p = state[lo:hi], goal[lo:hi], piece[lo:hi]
            far = distance[s] + self.weights(last[s], p)
            less = far < distance[g]  # arcs of one step and atom have different goals
            g = g[less]
            distance[g], last[g], came[g] = far[less], p[less], s[less]
        owner, taken = [], []
        here, who = ends + np.arange(len(atoms)), np.arange(len(atoms))
        while len(who):
            owner.append(who)
            taken.append(last[here])
            here = came[here]
            more = here != first[who]
            here, who = here[more], who[more]
        who, ids = np.concatenate(owner[::-1]), np.concatenate(taken[::-1])
        order = np.argsort(who, kind="stable")
        raw = ids[order].astype("<u2").tobytes()
        stops = np.cumsum(np.bincount(who, minlength=len(atoms))) * 2
        return [raw[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]

    def learn(self, runs: list[str]) -> None:
        """Work out what becomes of new runs; each holds its blanks or line's end but the first blank."""
        whole = [r if self.breaks and r[:1] == "\n" else BLANK + r.replace(" ", BLANK) for r in runs]
        text = "".join(whole)
        code = self.classes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].astype(np.int64)
        cut = np.ones(len(code) + 1, bool)
        cut[1:-1] = self.beside.find(code[:-1] * self.n_classes + code[1:]) < 0
        sizes = np.fromiter(map(len, whole), np.int64, len(whole))
        ends = np.cumsum(sizes)
        cut[ends] = True
        places = np.flatnonzero(cut)
        atoms = [text[a:b] for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True)]
        if len(self.atoms) > MEMORY:
            self.atoms.clear()
        new = [x for x in set(atoms).difference(self.atoms) if len(x) > 1 or x in self.id_of]
        short = sorted((x for x in new if len(x) <= LONG), key=len)
        for part in (short[i : i + 50_000] for i in range(0, len(short), 50_000)):
            self.atoms.update(zip(part, self.compose(part), strict=True))
        for x in new:
            if len(x) > LONG:
                self.atoms[x] = self.compose([x])[0]
        for x in set(atoms).difference(self.atoms):  # one character that no piece spells
            self.atoms[x] = b"".join(self.byte_ids[b] for b in x.encode("utf-8", "surrogatepass"))
        parts = np.searchsorted(places, ends).tolist()
        for r, a, b in zip(runs, [0, *parts[:-1]], parts, strict=True):
            self.runs[r] = b"".join(map(self.atoms.__getitem__, atoms[a:b])) if b - a > 1 else self.atoms[atoms[a]]
        for x in new:
            if len(x) > LONG:
                del self.atoms[x]

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian 16-bit integers."""
        split = []
        for t in texts:
            if not t:
                split.append([])
                continue
            t = t.replace(BLANK, " ")
            first = " " if self.prefix else ""
            spread = t.replace("\n", " \n") if self.breaks else t
            if "  " in spread or spread[0] == " " or spread[-1] == " " or not self.prefix:
                body = first + t
                head = "" if body[0] == " " or (self.breaks and body[0] == "\n") else re.match(r"[^ \n]+" if self.breaks else r"[^ ]+", body)[0]
                found = [r if r[0] == "\n" and self.breaks else r[1:] for r in self.run.findall(body, len(head))]
                split.append([None, head, *found] if head else found)
            else:
                split.append(spread.split(" "))
        heads = {i: s[1] for i, s in enumerate(split) if s and s[0] is None}
        for i in heads:
            split[i] = split[i][2:]
        if len(self.runs) > MEMORY:
            self.runs.clear()
        new = list(set().union(*split).difference(self.runs))
        if new:
            self.learn(new)
        out = [b"".join(map(self.runs.__getitem__, s)) for s in split]
        for i, head in heads.items():  # a beginning without a blank, in models without a leading one
            out[i] = self._bare(head) + out[i]
        for r in new:
            if len(r) > LONG:
                self.runs.pop(r, None)
        return out

    def _bare(self, head: str) -> bytes:
        code = self.classes[[ord(c) for c in head]].astype(np.int64)
        cut = np.flatnonzero(self.beside.find(code[:-1] * self.n_classes + code[1:]) < 0) + 1
        places = [0, *cut.tolist(), len(head)]
        parts = [head[a:b] for a, b in zip(places[:-1], places[1:], strict=True)]
        return b"".join(self.compose([x])[0] if len(x) > 1 or x in self.id_of else b"".join(self.byte_ids[b] for b in x.encode("utf-8", "surrogatepass")) for x in parts)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed([text])[0], "<u2").tolist()

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.spoken.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def transducer(path: str) -> Transducer:
    """Compiled once in each worker."""
    if path not in _compiled:
        _compiled[path] = Transducer(path)
    return _compiled[path]


def _lists(packed: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(x) // 2 for x in packed)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<u2").astype(np.int32)))


def encode_pieces(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every document."""
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(t.encode_packed(part.column(1).to_pylist()))], names=["doc_id", "ids"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of every row of ids; null ids: empty."""
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{ids_col}` ids").mapInArrow(run, "doc_id long, text string")


def op3_pieces(docs: DataFrame, path: str | None = None) -> DataFrame:
    """ids of every document, read back in the same pass: the digest of the decoded text and whether it is the text."""
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                texts = part.column(1).to_pylist()
                packed = t.encode_packed(texts)
                back = [t.decode(np.frombuffer(x, "<u2").tolist()) for x in packed]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) // 2 for x in packed], pa.int64()), _lists(packed), pa.array([hashlib.sha256(b.encode()).hexdigest() for b in back], pa.string()), pa.array([a == b for a, b in zip(texts, back, strict=True)], pa.bool_())],
                    names=["doc_id", "n_ids", "ids", "decoded_sha256", "round_trip"],
                )

    return id_text(docs).mapInArrow(run, "doc_id long, n_ids long, ids array<int>, decoded_sha256 string, round_trip boolean")
