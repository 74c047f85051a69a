"""SentencePiece (BPE) encoding and decoding by vectorised merge rounds.

A text, blanks written as U+2581, is cut where a blank follows a non-blank: no piece of the
vocabulary crosses such a place, so the segments are independent.  All segments of a batch that
are not cached yet lie in one flat numpy array of symbols.  Each round looks up the rank of every
adjacent pair, takes the minimum per segment, merges it at its leftmost place (at all its
places, left to right, where no better pair can arise from it) and compacts the array, until no
pair remains.  Characters that are not in the vocabulary become byte pieces.  Decoding puts the
pieces' texts together again, reading runs of byte pieces as UTF-8.

Null and empty texts have no ids and decode to the empty text.  Repeated rows are encoded each;
columns of the input stay, and one of a result's name is replaced; an empty table gives an empty
result.  A very long text is encoded whole, its segments in rounds of ``FLAT`` symbols; its ids are
held once as text and once as 32-bit numbers.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
#: segments that a worker keeps at most, the longest of them, and symbols of one round at most
CACHE, LONGEST, FLAT = 300_000, 64, 1 << 20
#: texts that are encoded, and whose ids are held, at once
SLICE = 256
NONE = np.int32(1 << 30)


class PieceModel:
    """Pieces of a vocabulary as the library lists them: (text, score, kind) by id.

    kind: "n" normal, "u" unknown, "c" control, "b" byte.
    """

    def __init__(self, pieces: list[tuple[str, float, str]]):
        self.text = [p[0] for p in pieces]
        self.kind = [p[2] for p in pieces]
        normal = [(p[0], p[1], i) for i, p in enumerate(pieces) if p[2] == "n"]
        self.unknown = self.kind.index("u")
        self.byte_id = {int(p[0][3:5], 16): i for i, p in enumerate(pieces) if p[2] == "b"}
        if len(self.byte_id) != 256 or any(BLANK in t.lstrip(BLANK) for t, _, _ in normal):
            raise ValueError("a vocabulary with byte pieces, and blanks in front alone, is needed")
        ids = {t: i for t, _, i in normal}
        score = {i: s for _, s, i in normal}
        # Pairs that make a piece, with the piece's rank: the higher the score, the lower the
        # rank; equal scores share a rank, as then the leftmost pair goes first.
        levels = {s: r for r, s in enumerate(sorted({s for _, s, _ in normal}, reverse=True))}
        left, right, made = [], [], []
        at_ease = np.ones(len(pieces), bool)
        for t, s, i in normal:
            for k in range(1, len(t)):
                a, b = ids.get(t[:k]), ids.get(t[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(i)
                    # Merging to a (or b) may open a pair that ranks at least as high.
                    at_ease[a] &= score[a] > s
                    at_ease[b] &= score[b] > s
        self.size = np.int64(len(pieces))
        key = np.array(left, np.int64) * self.size + np.array(right, np.int64)
        order = np.argsort(key, kind="stable")
        self.pair = key[order]
        self.pair_made = np.array(made, np.int32)[order]
        self.pair_rank = np.array([levels[score[i]] for i in made], np.int32)[order]
        self.at_ease = at_ease
        #: code point -> id, or -1 - code point
        self.char = -1 - np.arange(0x110000, dtype=np.int32)
        for t, _, i in normal:
            if len(t) == 1:
                self.char[ord(t)] = i
        self.csv = [str(i).encode() for i in range(len(pieces))]
        self.plain = [t.replace(BLANK, " ") for t in self.text]

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE without) and merged piece of symbol pairs."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        hit = (self.pair[at] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self.pair_rank[at], NONE), self.pair_made[at]

    def merge(self, segments: list[str]) -> list[list[int]]:
        """Symbols of each (not empty) segment: ids, or -1 - code point for a character without a piece."""
        sym = self.char[np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)]
        seg = np.repeat(np.arange(len(segments), dtype=np.int32), [len(s) for s in segments])
        rank, made = np.full(len(sym), NONE, np.int32), np.zeros(len(sym), np.int32)
        inner = np.flatnonzero(seg[1:] == seg[:-1])
        rank[inner], made[inner] = self.pairs(sym[inner], sym[inner + 1])
        ready: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            first = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
            size = np.diff(np.append(first, len(sym)))
            best = np.repeat(np.minimum.reduceat(rank, first), size)
            live = best < NONE
            if not live.all():  # what has no pair left is ready
                ready.append((seg[~live], sym[~live]))
                sym, seg, rank, made, best = sym[live], seg[live], rank[live], made[live], best[live]
                if not len(sym):
                    break
            place = np.flatnonzero(rank == best)
            owner, piece = seg[place], made[place]
            lead = np.append(True, owner[1:] != owner[:-1])
            # Where a better pair may arise, or equal scores belong to different pieces, the
            # leftmost alone goes.
            number = np.arange(len(place))
            head = np.maximum.accumulate(np.where(lead, number, 0))
            alone = np.zeros(len(segments), bool)
            alone[owner[~self.at_ease[piece] | (piece != piece[head])]] = True
            # Of overlapping places (a run of equal symbols) every second goes, from the left.
            run = lead | np.append(True, place[1:] != place[:-1] + 1)
            start = np.maximum.accumulate(np.where(run, number, 0))
            go = np.where(alone[owner], lead, (number - start) % 2 == 0)
            place, piece = place[go], piece[go]
            sym[place] = piece
            keep = np.ones(len(sym), bool)
            keep[place + 1] = False
            # Ranks change only for the pairs that a merged symbol belongs to.
            stale = np.zeros(len(sym), bool)
            stale[place] = True
            stale[np.maximum(place, 1) - 1] = True
            before = place - 2
            stale[before[(before >= 0) & ~keep[place - 1]]] = True
            sym, seg, rank, made, stale = sym[keep], seg[keep], rank[keep], made[keep], np.flatnonzero(stale[keep])
            rank[stale] = NONE
            stale = stale[stale < len(sym) - 1]
            stale = stale[seg[stale] == seg[stale + 1]]
            rank[stale], made[stale] = self.pairs(sym[stale], sym[stale + 1])
        out: list[list[int]] = [[]] * len(segments)
        if ready:
            seg, sym = (np.concatenate(x) for x in zip(*ready))
            first = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
            ends, flat = np.append(first[1:], len(sym)).tolist(), sym.tolist()
            for k, i, j in zip(seg[first].tolist(), first.tolist(), ends):
                out[k] = flat[i:j]
        return out

    def ids(self, symbols: list[int]) -> list[int]:
        """Final ids: characters without a piece as the bytes of their UTF-8."""
        out: list[int] = []
        for s in symbols:
            if s >= 0:
                out.append(s)
            else:
                out += [self.byte_id[b] for b in chr(-1 - s).encode("utf-8")]
        return out

    def decode_run(self, ids: list[int]) -> str:
        """Text of ids, without the treatment of a leading blank."""
        out: list[str] = []
        run = bytearray()
        for i in ids:
            kind = self.kind[i]
            if kind == "b":
                run.append(int(self.text[i][3:5], 16))
                continue
            if run:
                out.append(read_bytes(bytes(run)))
                run.clear()
            if kind == "n":
                out.append(self.plain[i])
            elif kind == "u":
                out.append(" ⁇ ")
        if run:
            out.append(read_bytes(bytes(run)))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.decode_run(ids)
        first = next((i for i in ids if self.kind[i] != "c"), None)
        return text[1:] if first is not None and self.kind[first] == "n" and text.startswith(" ") else text


def read_bytes(raw: bytes) -> str:
    """UTF-8, each byte that begins no valid character as U+FFFD."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[i:i + n].decode("utf-8"))
                    break
                except UnicodeDecodeError:
                    pass
            else:
                out.append("�")
                n = 1
            i += n
        return "".join(out)


SEGMENT = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


class Codec:
    """Encodes and decodes texts; keeps the segments met before, in two generations."""

    def __init__(self, model: PieceModel):
        self.model = model
        #: segment -> (ids as decimal numbers joined by commas, decoded text)
        self.young: dict[str, tuple[bytes, str]] = {}
        self.old: dict[str, tuple[bytes, str]] = {}

    def entry(self, symbols: list[int]) -> tuple[bytes, str]:
        model = self.model
        if min(symbols) >= 0:
            return b",".join([model.csv[i] for i in symbols]), "".join([model.plain[i] for i in symbols])
        ids = model.ids(symbols)
        return b",".join([model.csv[i] for i in ids]), model.decode_run(ids)

    def learn(self, new: list[str]) -> None:
        """Enter new segments, in rounds over at most FLAT symbols at once (a longer segment alone)."""
        group: list[str] = []
        size = 0
        for s in [*new, None]:
            if s is None or size + len(s) > FLAT:
                if group:
                    self.young.update(zip(group, map(self.entry, self.model.merge(group))))
                group, size = [], 0
            if s is not None:
                group.append(s)
                size += len(s)

    def encode(self, texts: list[str | None]) -> Iterator[tuple[int, bytes, bytes]]:
        """Per text the number of ids, the ids joined by commas and the decoded text in UTF-8."""
        for at in range(0, len(texts), SLICE):
            cut = [SEGMENT.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts[at:at + SLICE]]
            need = set().union(*cut)
            if len(self.young) + len(need) > CACHE // 2:
                self.old, self.young = self.young, {}
            missing = need - self.young.keys()
            for s in missing & self.old.keys():
                self.young[s] = self.old[s]
            self.learn(list(missing - self.old.keys()))
            table = self.young
            for x in cut:
                ids, said = zip(*map(table.__getitem__, x)) if x else ((), ())
                joined, plain = b",".join(ids), "".join(said)
                # The blank put in front of the text goes again.
                yield (joined.count(b",") + 1 if x else 0, joined,
                       (plain[1:] if plain.startswith(" ") else plain).encode("utf-8"))
            for s in [s for s in need if len(s) > LONGEST]:
                del table[s]


def load_model(path: str) -> list[tuple[str, float, str]]:
    """The vocabulary of a .model file, as the library reads it."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: "u" if sp.is_unknown(i) else "c" if sp.is_control(i) else "b" if sp.is_byte(i) else "n"
    return [(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.get_piece_size())]


#: the codec that a Python worker keeps from task to task, with its vocabulary
_KEPT: list = []


def _codec(pieces: list[tuple[str, float, str]]) -> Codec:
    if not _KEPT or _KEPT[0] != pieces:
        _KEPT[:] = [pieces, Codec(PieceModel(pieces))]
    return _KEPT[1]


_RESULT = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.list_(pa.int32()))])


def _encoded(codec: Codec, texts: list[str | None], with_ids: bool) -> pa.Array:
    """Results of a few texts; their ids are one flat array of numbers."""
    counts, ids_digests, digests, flat = [], [], [], [np.zeros(0, np.int32)]
    for n, ids, plain in codec.encode(texts):
        counts.append(n)
        ids_digests.append(hashlib.sha256(ids).hexdigest())
        digests.append(hashlib.sha256(plain).hexdigest())
        if with_ids and n:
            flat.append(np.fromstring(ids.decode(), np.int32, sep=","))
    if with_ids:
        offsets = pa.array(np.cumsum([0, *counts]).astype(np.int32))
        lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(flat)))
    else:
        lists = pa.nulls(len(counts), pa.list_(pa.int32()))
    return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(ids_digests, pa.string()), pa.array(digests, pa.string()), lists],
                                      fields=list(_RESULT))


def encode_texts(df: DataFrame, model_path: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """``df`` with n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids themselves.

    Encodes each text where it is read (no shuffle) and decodes the ids again.  The model file
    (under a MB, whatever the data) is read on the driver and broadcast.
    """
    pieces = df.sparkSession.sparkContext.broadcast(load_model(model_path))
    @F.arrow_udf("struct<n_tokens:long,ids_sha256:string,decoded_sha256:string,ids:array<int>>")
    def encoded(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(pieces.value)
        for batch in texts:
            for at in range(0, len(batch), SLICE):
                yield _encoded(codec, batch.slice(at, SLICE).to_pylist(), with_ids)

    got = df.withColumn("__piece", encoded(F.col(text)))
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    return got.withColumns({n: F.col(f"__piece.{n}") for n in names}).drop("__piece")


def decode_ids(df: DataFrame, model_path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``df`` with the text of an id array; null ids give the empty text."""
    pieces = df.sparkSession.sparkContext.broadcast(load_model(model_path))

    @F.arrow_udf("string")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = PieceModel(pieces.value)
        for batch in batches:
            yield pa.array([model.decode(x or []) for x in batch.to_pylist()], pa.string())

    return df.withColumn(to, decoded(F.col(ids)))
