"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding by retained offsets.

Pre-tokenisation finds the boundaries of ``PATTERN`` (contractions, an optional space with letters, digits or other
signs, white space that leaves its last character to what follows) without a regular expression:

* each code point gets a class from a table over all of Unicode; the few places where the pattern looks ahead (the last
  character of a white-space run, the letters after an apostrophe) are told apart by comparing shifted arrays;
* the classes drive an automaton of eight states. The characters are laid out in lanes; every lane composes its
  transition functions from all eight start states at once, an associative scan over the lanes gives each lane's true
  start state, and a second pass marks where a piece begins.

The pieces are slices of the text. Each distinct piece is merged once (lowest rank first) and cached; the cache is
emptied when it reaches ``CACHE`` pieces, so memory is bounded. ``encode`` returns for every document the ids and the
byte offset at which each id ends; ``decode`` copies the vocabulary's bytes to these offsets.

Defined results: a null text counts as empty; an empty text has no ids and decodes to no bytes; other columns of the
input are kept, except that ``ids`` and ``token_ends`` (``decoded``) are replaced. A document is one row, so ties and
repeated rows are encoded like any other; a null row in ``ids`` decodes to no bytes.
"""

from __future__ import annotations

import base64
import functools
import heapq
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from chatlake.llm.common import ship

CACHE = 200_000
SHORT_PIECE = 48
CHUNK = 1 << 20  # code points scanned at once
LANE = 256

# classes; OTHER includes an apostrophe that starts no contraction
LETTER, DIGIT, OTHER, SPACE_LAST, WHITE_LAST, WHITE, SHORT, LONG, END = range(9)
# states: what the open piece is; CLOSED: the next character begins a piece
IN_LETTERS, IN_DIGITS, IN_OTHER, AFTER_SPACE, IN_WHITE, ONE_LEFT, TWO_LEFT, CLOSED = range(8)
STATES = 8
#: White_Space of Unicode, by code point ranges (fixed values)
WHITE_SPACE = ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
               (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, does a piece begin) by class * STATES + state."""
    nxt, begins = np.empty((9, STATES), np.uint8), np.ones((9, STATES), np.uint8)
    for cls, state in ((LETTER, IN_LETTERS), (DIGIT, IN_DIGITS), (OTHER, IN_OTHER)):
        nxt[cls] = state
        begins[cls, [state, AFTER_SPACE]] = 0
    nxt[LETTER, ONE_LEFT], begins[LETTER, ONE_LEFT] = CLOSED, 0
    nxt[LETTER, TWO_LEFT], begins[LETTER, TWO_LEFT] = ONE_LEFT, 0
    for cls, state in ((SHORT, ONE_LEFT), (LONG, TWO_LEFT)):  # a contraction only where a piece would begin
        nxt[cls] = state
        nxt[cls, [IN_OTHER, AFTER_SPACE]] = IN_OTHER
        begins[cls, [IN_OTHER, AFTER_SPACE]] = 0
    nxt[SPACE_LAST], nxt[WHITE_LAST], nxt[WHITE] = AFTER_SPACE, CLOSED, IN_WHITE
    begins[WHITE, IN_WHITE] = 0
    nxt[END], begins[END] = CLOSED, 0
    return nxt.ravel(), begins.ravel()


_NEXT, _BEGINS = _automaton()


@functools.cache
def class_table() -> np.ndarray:
    """LETTER, DIGIT, WHITE or OTHER of every code point."""
    kind = {"L": LETTER, "N": DIGIT}
    out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    for a, b in WHITE_SPACE:
        out[a:b + 1] = WHITE
    return out


def classes(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Classes of the code points of texts that stand behind one another, each with one END place behind it."""
    cls = class_table()[points]
    cls[ends] = END
    last = (cls == WHITE) & np.append((cls[1:] != WHITE) & (cls[1:] != END), False)
    cls[last] = np.where(points[last] == 0x20, SPACE_LAST, WHITE_LAST)
    at = np.flatnonzero(points[:-1] == 0x27)  # apostrophes; an END place is never one
    if len(at):
        pad = np.append(points, [0, 0])
        pad[ends] = 0
        a, b = pad[at + 1], pad[at + 2]
        cls[at[np.isin(a, [ord(c) for c in "stmd"])]] = SHORT
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        cls[at[two]] = LONG
    return cls


def starts(cls: np.ndarray) -> np.ndarray:
    """Places where a piece begins, by a scan of transition functions over lanes of ``LANE`` characters."""
    n = len(cls)
    lanes = -(-n // LANE)
    steps = np.full(lanes * LANE, END, np.uint8)
    steps[:n] = cls
    steps = np.ascontiguousarray(steps.reshape(lanes, LANE).T) * np.uint8(STATES)
    fn = np.tile(np.arange(STATES, dtype=np.uint8), (lanes, 1))
    for row in steps:  # every lane's function from all start states
        fn = _NEXT[row[:, None] + fn]
    shift = 1
    while shift < lanes:  # composition is associative: a doubling scan gives each lane the function of all before it
        fn[shift:] = np.take_along_axis(fn[shift:], fn[:-shift].astype(np.intp), 1)
        shift *= 2
    state = np.append(np.uint8(CLOSED), fn[:-1, CLOSED])
    marks = np.empty((LANE, lanes), np.uint8)
    for j, row in enumerate(steps):
        at = row + state
        marks[j] = _BEGINS[at]
        state = _NEXT[at]
    return np.flatnonzero(marks.T.ravel()[:n])


def pieces(texts: list[str]) -> list[list[str]]:
    """The pieces of every text."""
    joined = "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    at = starts(classes(points, ends))
    cut = np.searchsorted(at, ends)
    out, low = [], 0
    for high, end in zip(cut.tolist(), ends.tolist()):
        b = at[low:high].tolist()
        out.append([joined[i:j] for i, j in zip(b, [*b[1:], end])])
        low = high
    return out


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Merge adjacent parts, lowest rank first and leftmost among equals, until no pair has a rank."""
    if (whole := ranks.get(piece)) is not None:
        return (whole,)
    n = len(piece)
    if n <= SHORT_PIECE:
        return _merge_short(piece, ranks)
    end, before = [*range(1, n + 1)], [*range(-1, n - 1)]  # end[i]: where the part that begins at i ends; 0: merged away
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        mid = end[i]
        if not mid or mid >= e or end[mid] != e:
            continue
        end[i], end[mid] = e, 0
        if e < n:
            before[e] = i
            if (r := ranks.get(piece[i:end[e]])) is not None:
                heapq.heappush(heap, (r, i, end[e]))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:e])) is not None:
            heapq.heappush(heap, (r, p, e))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return tuple(out)


def _merge_short(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The same by rescanning a short list of pairs, which beats the heap for ordinary words."""
    get, none = ranks.get, 1 << 62
    cuts = [*range(len(piece) + 1)]
    pairs = [get(piece[i:i + 2], none) for i in range(len(piece) - 1)]
    while pairs and (best := min(pairs)) < none:
        i = pairs.index(best)
        del cuts[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = get(piece[cuts[i]:cuts[i + 2]], none)
        if i:
            pairs[i - 1] = get(piece[cuts[i - 1]:cuts[i + 1]], none)
    return tuple(ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:]))


class Merged(dict):
    """Piece -> ids, merged when first met; emptied when full."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= CACHE:
            self.clear()
        self[piece] = ids = merge(piece.encode(), self.ranks)
        return ids


class Vocabulary:
    """Ranks of a ``base64 rank`` file, their bytes in one buffer, and the cache of merged pieces."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.length = np.array([len(t) for t in tokens], np.int32)
        self.start = np.cumsum(self.length, dtype=np.int64) - self.length
        self.merged = Merged(self.ranks)


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *parts])))


def encode_texts(texts: list[str], vocab: Vocabulary) -> list[np.ndarray]:
    get, out, low = vocab.merged.__getitem__, [], 0
    while low < len(texts):  # texts of about CHUNK code points at a time
        high, size = low, 0
        while high < len(texts) and (high == low or size + len(texts[high]) < CHUNK):
            size += len(texts[high]) + 1
            high += 1
        out += [np.fromiter(chain.from_iterable(map(get, p)), np.int32) for p in pieces(texts[low:high])]
        low = high
    return out


def decode_ids(ids: np.ndarray, ends: np.ndarray, vocab: Vocabulary) -> bytes:
    """The ids' bytes: each output byte is fetched from its id's place in the vocabulary."""
    if not len(ids):
        return b""
    length = vocab.length[ids]
    place = np.repeat(vocab.start[ids] - (ends - length), length) + np.arange(ends[-1])
    return vocab.bytes[place].tobytes()


def _with(batch: pa.RecordBatch, schema: pa.Schema, cols: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([cols[n] if n in cols else batch.column(n) for n in schema.names], names=schema.names)


def _parts(batch: pa.RecordBatch, text_col: str, most: int = CHUNK):
    """Slices of a batch of about ``most`` bytes of text, one row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + most, "right")))
        yield batch.slice(low, high - low)
        low = high


def encode(docs: DataFrame, path: str, text_col: str = "text", keep_text: bool = False, check: bool = False, decoded: bool = False) -> DataFrame:
    """``docs`` without its text (unless ``keep_text``) with ``ids`` and ``token_ends`` (array<int>).

    With ``check`` or ``decoded`` each document is decoded again in the same pass: ``round_trip`` says whether its ids give its bytes,
    ``decoded`` holds what they give.
    """
    extra = {"round_trip": T.BooleanType()} if check else {}
    extra |= {"decoded": T.BinaryType()} if decoded else {}
    added = ("ids", "token_ends", *extra)
    keep = [f for f in docs.schema.fields if f.name not in added and (keep_text or f.name != text_col)]
    schema = T.StructType([*keep, *(T.StructField(n, T.ArrayType(T.IntegerType(), False), False) for n in added[:2]),
                           *(T.StructField(n, t, False) for n, t in extra.items())])

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            for part in _parts(batch, text_col):
                texts = [t or "" for t in part.column(text_col).to_pylist()]
                ids = encode_texts(texts, vocab)
                ends = [np.cumsum(vocab.length[i], dtype=np.int32) for i in ids]
                cols = {"ids": _lists(ids), "token_ends": _lists(ends)}
                back = [decode_ids(i, e, vocab) for i, e in zip(ids, ends)] if extra else []
                if check:
                    cols["round_trip"] = pa.array([b == t.encode() for b, t in zip(back, texts)], pa.bool_())
                if decoded:
                    cols["decoded"] = pa.array(back, pa.binary())
                yield _with(part, names, cols)

    names = pa.schema([(f.name, pa.null()) for f in schema.fields])
    return ship(docs).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (ids, token_ends) with the bytes its ids stand for, as ``decoded`` binary."""
    schema = T.StructType([*(f for f in encoded.schema.fields if f.name != "decoded"),
                           T.StructField("decoded", T.BinaryType(), False)])

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                out = []
                for ids, ends in zip(part.column("ids"), part.column("token_ends")):
                    if ids.values is None:
                        out.append(b"")
                        continue
                    i = ids.values.to_numpy(zero_copy_only=False)
                    e = np.cumsum(vocab.length[i], dtype=np.int32) if ends.values is None else ends.values.to_numpy(zero_copy_only=False)
                    out.append(decode_ids(i, e, vocab))
                yield _with(part, names, {"decoded": pa.array(out, pa.binary())})

    names = pa.schema([(f.name, pa.null()) for f in schema.fields])
    return ship(encoded).mapInArrow(run, schema)
