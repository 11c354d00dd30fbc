"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with their scores.

The model file gives pieces and scores; nothing is trained. Text gets the whitespace marker for each space and one in
front, and is cut before every marker that follows another character: where no piece crosses such a cut (checked when
the model is loaded), the best path of a text is that of its parts. Parts are encoded in batches, all positions of a batch at a
time, and kept in a bounded cache. Characters without a piece become byte pieces.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Default model: a parameter of every function here.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_MARK = MARK.encode()
_CACHE = 600_000
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6
#: What an unknown character costs beyond the least score.
_PENALTY = 10.0


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        c = b[i]
        i += 1
        value |= (c & 127) << shift
        shift += 7
        if c < 128:
            return value, i


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        if key & 7 == 0:
            value, i = _varint(b, i)
        else:
            if key & 7 == 2:
                n, i = _varint(b, i)
            else:
                n = 8 if key & 7 == 1 else 4
            value, i = b[i : i + n], i + n
        yield key >> 3, value


def read_pieces(model: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, kind) in order of ids, from a model file's bytes."""
    out = []
    for number, value in _fields(model):
        if number == 1:
            own = dict(_fields(value))
            out.append((own[1].decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, _NORMAL)))
    return out


class DoubleArray:
    """A trie in two arrays: the child of state s by byte c is t = base[s] + c if check[t] == s."""

    def __init__(self, keys: list[bytes]):
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for i, key in enumerate(keys):
            s = 0
            for c in key:
                t = children[s].get(c)
                if t is None:
                    t = len(children)
                    children[s][c] = t
                    children.append({})
                s = t
            ends[s] = i
        # Each state's children take the next free run of places: no search, so that building stays linear.
        base_of, place, top, order = {}, {0: 0}, 1, [0]
        for s in order:
            if kids := children[s]:
                low = min(kids)
                base_of[s] = top - low
                for c, t in kids.items():
                    place[t] = top - low + c
                    order.append(t)
                top += max(kids) - low + 1
        base, check, value = np.zeros(top + 512, np.int32), np.full(top + 512, -1, np.int32), np.full(top + 512, -1, np.int32)
        for s, b in base_of.items():
            base[place[s]] = b
            for c, t in children[s].items():
                check[b + c] = place[s]
                value[b + c] = ends.get(t, -1)
        self.base, self.check, self.value = base, check, value


@dataclass
class Model:
    pieces: list[tuple[str, float, int]]
    trie: DoubleArray = field(init=False)

    def __post_init__(self):
        self.ids = np.array([i for i, (_, _, kind) in enumerate(self.pieces) if kind in (_NORMAL, _USER)], dtype=np.int32)
        keys = [self.pieces[i][0].encode() for i in self.ids]
        self.scores = np.array([self.pieces[i][1] for i in self.ids], dtype=np.float64)
        self.trie = DoubleArray(keys)
        self.longest = max(map(len, keys), default=1)
        self.unknown = float(self.scores.min(initial=0.0)) - _PENALTY
        self.byte_id = np.full(256, -1, dtype=np.int32)
        for i, (piece, _, kind) in enumerate(self.pieces):
            if kind == _BYTE:
                self.byte_id[int(piece[3:5], 16)] = i
        self.unk_id = next((i for i, x in enumerate(self.pieces) if x[2] == _UNKNOWN), 0)
        self.crossing = any(MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind in (_NORMAL, _USER))
        self.bytes_of = [bytes([int(p[3:5], 16)]) if kind == _BYTE else b"" if kind == _CONTROL else " ⁇ ".encode() if kind == _UNKNOWN else p.replace(MARK, " ").encode() for p, _, kind in self.pieces]

    def encode_parts(self, parts: list[bytes]) -> list[list[int]]:
        """Best path of each part. At equal scores the earlier start (the longer piece) wins."""
        out: list[list[int]] = [[] for _ in parts]
        by_size: dict[int, list[int]] = {}
        for i, p in enumerate(parts):
            by_size.setdefault(len(p) if len(p) <= 8 else -(-len(p) // 8) * 8, []).append(i)
        for size, own in by_size.items():
            step = max(1, 4_000_000 // (size + 1))
            for k in range(0, len(own), step):
                self._encode_block([parts[i] for i in own[k : k + step]], own[k : k + step], size, out)
        return out

    def _encode_block(self, parts: list[bytes], at: list[int], size: int, out: list[list[int]]) -> None:
        n = len(parts)
        text = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in parts), dtype=np.uint8).reshape(n, size).T.astype(np.int32)
        lengths = np.array([len(p) for p in parts])
        best = np.full((size + 1, n), -np.inf)
        best[0] = 0.0
        came, piece = np.zeros((size + 1, n), np.int32), np.full((size + 1, n), -1, np.int32)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for i in range(size):
            rows = np.flatnonzero((best[i] > -np.inf) & (lengths > i))
            if not len(rows):
                continue
            lead = text[i, rows]
            width = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
            single = np.zeros(n, dtype=bool)
            width_of = np.zeros(n, dtype=np.int32)
            width_of[rows] = width
            live, state = rows, np.zeros(len(rows), np.int32)
            for j in range(i, min(size, i + self.longest)):
                ok = lengths[live] > j
                live, state = live[ok], state[ok]
                to = np.maximum(base[state] + text[j, live], 0)
                ok = check[to] == state
                live, state = live[ok], to[ok]
                if not len(live):
                    break
                v = value[state]
                hit = v >= 0
                who, v = live[hit], v[hit]
                single[who[j - i + 1 == width_of[who]]] = True
                score = best[i, who] + self.scores[v]
                win = score > best[j + 1, who]
                who, v = who[win], v[win]
                best[j + 1, who], came[j + 1, who], piece[j + 1, who] = score[win], i, v
            lone = rows[~single[rows]]
            if len(lone):
                to = np.minimum(i + width_of[lone], lengths[lone])
                score = best[i, lone] + self.unknown
                win = score > best[to, lone]
                lone, to = lone[win], to[win]
                best[to, lone], came[to, lone], piece[to, lone] = score[win], i, -2
        came, piece = came.T, piece.T
        for r, p in enumerate(parts):
            ids, j, back, of = [], len(p), came[r].tolist(), piece[r].tolist()
            while j > 0:
                i = back[j]
                if of[j] >= 0:
                    ids.append(int(self.ids[of[j]]))
                else:
                    ids += [int(self.byte_id[c]) if self.byte_id[c] >= 0 else self.unk_id for c in reversed(p[i:j])]
                j = i
            out[at[r]] = ids[::-1]

    def parts(self, text: str) -> list[bytes]:
        if not text:
            return []
        if self.crossing:
            return [(MARK + text.replace(" ", MARK)).encode()]
        out, run = [], 0
        for x in text.replace(MARK, " ").encode().split(b" "):
            run += 1
            if x:
                out.append(_MARK * run + x)
                run = 0
        if run:
            out.append(_MARK * run)
        return out

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, markers as spaces, the one in front dropped; bytes that are no UTF-8 become U+FFFD."""
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


class Encoder:
    """Encodes texts, keeping the pieces of up to limit parts; a full cache starts anew."""

    def __init__(self, model: Model, limit: int = _CACHE):
        self.model, self.limit, self.known = model, limit, {}

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and bounds of each text's."""
        known = self.known
        cut = [self.model.parts(t) for t in texts]
        new = [p for p in {p for parts in cut for p in parts} if p not in known]
        if len(known) + len(new) > self.limit:
            known.clear()
            new = list({p for parts in cut for p in parts})
        known.update(zip(new, (np.array(x, np.int32).tobytes() for x in self.model.encode_parts(new)), strict=True))
        found = [known[p] for parts in cut for p in parts]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        total = np.concatenate([[0], np.cumsum(sizes)])
        bounds = total[np.cumsum([0, *map(len, cut)])]
        return np.frombuffer(b"".join(found), dtype=np.int32), bounds


def _encode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Model(shared.value))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j]) <= 1 << 20):
                    size += len(texts[j])
                    j += 1
                ids, bounds = encoder.encode(texts[i:j])
                listed = ids.tolist()
                decoded = [encoder.model.decode(listed[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                pieces = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pieces, pa.array(decoded, pa.string())], names=["doc_id", "piece_ids", "decoded"])
                i = j

    return run


def encode_decode(documents: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, piece_ids, decoded) per row of documents: the ids of the whole text, and the text that they decode to.

    Null and empty texts have no ids and decode to the empty text. A whitespace marker in a text is taken for a space;
    any other text decodes to itself. Repeated rows give repeated results; other columns are ignored.
    model is a path that the driver reads; the pieces (bounded by the file) are broadcast.
    """
    with open(model, "rb") as f:
        pieces = read_pieces(f.read())
    shared = documents.sparkSession.sparkContext.broadcast(pieces)
    return documents.select("doc_id", "text").mapInArrow(_encode(shared), "doc_id long, piece_ids array<int>, decoded string")


def encoded(documents: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_pieces, piece_ids, decoded_chars, decoded_sha256 of every row of documents, in the cases that encode_decode
    defines: null and empty texts have no pieces and the digest of the empty text; an empty table gives an empty result."""
    return encode_decode(documents, model).select(
        "doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids", F.length("decoded").cast("long").alias("decoded_chars"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
