"""SentencePiece encoding and decoding over an Aho-Corasick automaton.

The pieces of a model file make the automaton. One pass over a text follows its transitions; at each position the chain
of output links names every piece that ends there, and each relaxes the best score of its end (Viterbi). Characters that
no piece covers cost UNKNOWN below the worst score and become byte pieces where the model has them. Decoding turns ids
back into text; for texts without the white-space symbol itself, and with byte pieces, it gives the text back exactly.

Where the model has no piece that holds the white-space symbol after another character, no best path crosses into such a
boundary, so a text is cut there and the best paths of its (mostly repeated) parts are remembered, CACHE of them at most,
in two generations: when the newer one is full it becomes the older one, and parts that are met again move back.

The scores of a merge model are its ranks (later merges are lower), and the path is the one of the best total score: it
often has more pieces than the model's own merges would give.

Defined cases: a null text gives null ids; an empty one none. Ties go to the longest last piece. Repeated rows get equal
results. Whole texts are read, however long. An empty table gives an empty result. Other columns pass through; columns
named like `ids` and round_trip are replaced.
"""

from __future__ import annotations

import re
import sys
import types
from array import array
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
UNKNOWN = 10.0
CACHE = 200_000


class Pieces:
    """Pieces of a model: (text, score) of ordinary ones, byte pieces, and the id of the unknown piece."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        kinds = pb.ModelProto.SentencePiece
        self.text = [p.piece for p in proto.pieces]
        self.unknown = next((i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN), 0)
        self.ordinary = {p.piece: (i, p.score) for i, p in enumerate(proto.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.control = {i for i, p in enumerate(proto.pieces) if p.type == kinds.CONTROL}
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        self.worst = min((s for _, s in self.ordinary.values()), default=0.0) - UNKNOWN
        # A place before SPACE and after another character can be cut if no piece runs over it.
        self.cuts = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ordinary)


class Paths(dict):
    """Best paths of parts, as packed ids; a part that is not there is looked up in the older generation, or found."""

    def __init__(self, find: Callable[[str], list[int]]):
        super().__init__()
        self.find, self.older = find, {}

    def __missing__(self, part: str) -> bytes:
        got = self.older.get(part)
        if got is None:
            got = array("i", self.find(part)).tobytes()
        if len(part) < 64:
            if len(self) >= CACHE // 2:
                self.older = dict(self)
                self.clear()
            self[part] = got
        return got


class Automaton:
    """Aho-Corasick over the pieces: goto and failure links, and the chain of output links of each state, laid out."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.next: list[dict[str, int]] = [{}]
        #: (score, length, id) of the pieces that end in each state, the longest first; states without one of their own share a tuple.
        self.out: list[tuple[tuple[float, int, int], ...]] = [()]
        for text, (i, score) in pieces.ordinary.items():
            at = 0
            for c in text:
                to = self.next[at].get(c)
                if to is None:
                    to = len(self.next)
                    self.next[at][c] = to
                    self.next.append({})
                    self.out.append(())
                at = to
            self.out[at] = ((score, len(text), i),)
        self.fail = [0] * len(self.next)
        queue = deque(self.next[0].values())
        while queue:
            at = queue.popleft()
            f = self.fail[at]
            self.out[at] = self.out[at] + self.out[f] if self.out[at] else self.out[f]
            for c, to in self.next[at].items():
                g = f
                while g and c not in self.next[g]:
                    g = self.fail[g]
                self.fail[to] = self.next[g].get(c, 0) if to != self.next[g].get(c, 0) else 0
                queue.append(to)
        self.paths = Paths(self.viterbi)
        spelled = [t.encode("utf-8", "surrogatepass") for t in pieces.text]
        for i in pieces.control:
            spelled[i] = b""
        spelled[pieces.unknown] = " ⁇ ".encode()
        for b, i in pieces.bytes.items():
            spelled[i] = bytes([b])
        self.spelled = spelled

    def viterbi(self, text: str) -> list[int]:
        """Ids of the best path over text (spaces already turned into SPACE)."""
        nxt, fail, out = self.next, self.fail, self.out
        worst = self.pieces.worst
        best, last, sizes = [0.0], [-1], [1]  # of each end: score, its last piece and that one's length
        state = 0
        for e, c in enumerate(text, 1):
            to = nxt[state].get(c)
            while to is None and state:
                state = fail[state]
                to = nxt[state].get(c)
            state = to or 0
            top, by, size = best[-1] + worst, -1, 1  # below any piece of one character
            for score, length, i in out[state]:
                new = best[e - length] + score
                if new > top:
                    top, by, size = new, i, length
            best.append(top)
            last.append(by)
            sizes.append(size)
        n = len(text)
        ids: list[int] = []
        e = n
        while e:
            if (i := last[e]) >= 0:
                ids.append(i)
            else:
                got = [self.pieces.bytes.get(b) for b in text[e - 1].encode("utf-8", "surrogatepass")]
                ids.extend(reversed(got) if None not in got else [self.pieces.unknown])
            e -= sizes[e]
        return ids[::-1]

    def packed(self, text: str) -> bytes:
        """Ids of a text, four bytes each."""
        if not text:
            return b""
        text = text.replace(" ", SPACE)
        if self.pieces.prefix:
            text = SPACE + text
        if not self.pieces.cuts:
            return array("i", self.viterbi(text)).tobytes()
        return b"".join(map(self.paths.__getitem__, re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", text)))

    def encode(self, text: str) -> list[int]:
        return array("i", self.packed(text)).tolist()

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "surrogatepass").replace(SPACE, " ")
        return text[1:] if self.pieces.prefix and text.startswith(" ") else text


def automaton(model: bytes, key: str) -> Automaton:
    """One automaton per Python worker and model; it stays, with what it remembers, from task to task."""
    made = sys.modules.setdefault("_markflow_automata", types.ModuleType("_markflow_automata")).__dict__
    if key not in made:
        made[key] = Automaton(Pieces(model))
    return made[key]


def encode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with `ids` (array of int) and round_trip: whether decoding gives the text back."""
    import hashlib

    spark = docs.sparkSession
    with open(model_path, "rb") as f:
        model = f.read()  # half a megabyte; the driver reads it, executors need no such file
    key = hashlib.sha256(model).hexdigest()
    sent = spark.sparkContext.broadcast(model)
    docs = docs.drop(ids, "round_trip")
    names = docs.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(sent.value, key)
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                texts = part.column(at).to_pylist()
                got = [b"" if t is None else a.packed(t) for t in texts]
                ok = [None if t is None else a.decode(array("i", g).tolist()) == t for t, g in zip(texts, got)]
                ends = np.cumsum([0, *[len(g) // 4 for g in got]]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(got), np.int32)), mask=pa.array([t is None for t in texts], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(ok, pa.bool_())], names=[*names, ids, "round_trip"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, `{ids}` array<int>, round_trip boolean")


def decode(encoded: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """encoded with `text`: what its ids stand for."""
    import hashlib

    with open(model_path, "rb") as f:
        model = f.read()
    key = hashlib.sha256(model).hexdigest()
    sent = encoded.sparkSession.sparkContext.broadcast(model)
    encoded = encoded.drop(text)
    names = encoded.columns
    at = names.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(sent.value, key)
        for b in batches:
            got = [None if x is None else a.decode(x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], names=[*names, text])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{kinds}, `{text}` string")
