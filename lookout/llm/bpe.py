"""Byte-level BPE of whole texts as a streaming transducer with bounded lookahead.

A text goes through in chunks. The pre-tokenizer is a state machine over character classes that hands on a piece as soon
as no later character can change it. Inside a piece, merges can only change tokens near the open end: how near follows
from the merge list (:func:`sufficient_lookahead`), so every token that ends that many bytes before the end of what is
read is stable and leaves at once. Memory is a chunk plus the lookahead, however long a text or a run of one class is.

Why the lookahead suffices: let two texts agree up to a point and apply the merges in rank order to both. Their token
sequences agree up to a boundary that starts at that point. It only moves left when a merge (x, y) takes place in one
text and not in the other, x being the last token they agree on and y the first after the boundary; it then moves by the
length of x. For y to differ, an earlier (lower-ranked) merge must have moved the boundary to where y starts, and y must
begin with what that merge left there: its left part is on y's left spine. The longest chain of merges of rising rank
linked that way, weighed by the lengths of their left parts, bounds how far the boundary can ever move.
"""

from __future__ import annotations

import base64
import codecs
import heapq
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lookout.session import spread

#: The default vocabulary; its folder is a parameter everywhere.
FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
#: Fixed value: the pre-tokenizer's pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK = 1 << 14
#: Pieces whose tokens a worker remembers, and the longest piece (bytes) that it remembers.
REMEMBERED, REMEMBERED_BYTES = 1 << 17, 64


def load_ranks(folder: str = FOLDER, name: str = VOCABULARY) -> dict[bytes, int]:
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_parts(ranks: dict[bytes, int]) -> dict[bytes, tuple[bytes, bytes]]:
    """The two tokens that each token of more than one byte is merged from, in rank order."""
    return {t: tuple(parts) for t, r in sorted(ranks.items(), key=lambda x: x[1]) if len(t) > 1 and len(parts := _merged(t, ranks, r)) == 2}


def sufficient_lookahead(ranks: dict[bytes, int]) -> int:
    """Bytes after which no continuation can change a token; see the module's text."""
    parts = merge_parts(ranks)
    reach: dict[bytes, int] = {}  # left part of a merge -> how far the boundary has moved when it was cause of a difference
    most = 0
    for left, right in parts.values():
        before, spine = 0, right
        while True:
            before = max(before, reach.get(spine, 0))
            if spine not in parts:
                break
            spine = parts[spine][0]
        far = len(left) + before
        reach[left] = max(reach.get(left, 0), far)
        most = max(most, far)
    return most + max(map(len, ranks))


def _merged(piece: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[bytes]:
    """``piece`` after all merges (those of a rank under ``below``), lowest rank first, leftmost first."""
    if len(piece) > 48 and below is None:
        return _merged_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = below, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def _merged_long(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The same in n log n: a heap of pairs over a linked list of parts."""
    n = len(piece)
    ends, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    gone = bytearray(n)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i]
        if gone[i] or j >= n or ends[j] != end:
            continue
        ends[i], gone[j], after[i] = end, 1, after[j]
        if after[i] < n:
            before[after[i]] = i
            r = ranks.get(piece[i : ends[after[i]]])
            if r is not None:
                heapq.heappush(heap, (r, i, ends[after[i]]))
        if (h := before[i]) >= 0:
            r = ranks.get(piece[h:end])
            if r is not None:
                heapq.heappush(heap, (r, h, end))
    return [piece[i : ends[i]] for i in range(n) if not gone[i]]


class Encoder:
    """ids of texts; one per process and vocabulary (see :func:`encoder`)."""

    def __init__(self, ranks: dict[bytes, int], lookahead: int | None = None):
        self.ranks = ranks
        self.lookahead = lookahead or sufficient_lookahead(ranks)
        self.window = 2 * self.lookahead
        self._pieces = regex.compile(PATTERN)
        self._known: dict[str, tuple[int, ...]] = {}

    # One piece -----------------------------------------------------------------------------------------------------

    def _bytes_ids(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else [self.ranks[p] for p in _merged(piece, self.ranks)]

    def piece_ids(self, piece: str) -> tuple[int, ...]:
        """The ids of a whole piece, through the byte transducer; those of short pieces are remembered."""
        found = self._known.get(piece)
        if found is None:
            raw, open_ = piece.encode("utf-8"), _OpenPiece(self)
            found = (*open_.feed(raw), *open_.close())
            if len(raw) <= REMEMBERED_BYTES:
                if len(self._known) >= REMEMBERED:
                    self._known.clear()
                self._known[piece] = found
        return found

    def pieces_ids(self, pieces: Iterable[str]) -> list[int]:
        known, out = self._known, []
        for p in pieces:
            out += known.get(p) or self.piece_ids(p)
        return out

    # Whole texts ---------------------------------------------------------------------------------------------------

    def pieces(self, text: str) -> list[str]:
        return self._pieces.findall(text)

    def stream(self, chunks: Iterable[str]) -> Iterator[int]:
        """ids of a text that comes in chunks, each as soon as it is stable."""
        t = Transducer(self)
        for chunk in chunks:
            yield from t.feed(chunk)
        yield from t.close()

    def ids(self, text: str | None) -> list[int]:
        """Null and empty texts have no ids: an empty list."""
        return list(self.stream(text[i : i + CHUNK] for i in range(0, len(text), CHUNK))) if text else []


class Transducer:
    """The text transducer: takes chunks of a text as they come, gives the ids that no further character can change.

    It holds the open end of what was read, or, of a run of one class that is longer than the window, the state of the
    byte transducer.
    """

    def __init__(self, owner: Encoder):
        self.owner, self._open, self._held = owner, _OpenPiece(owner), ""
        self._mid = ""  # the class of the open piece that was handed on in part

    def feed(self, chunk: str) -> list[int]:
        o, out, buffer = self.owner, [], self._held + chunk
        self._held = ""
        if self._mid:
            at = _run(buffer, 0, self._mid)
            over = at == len(buffer)
            if self._mid == "s":  # its last character begins the next piece if anything but white space follows
                at -= 1
            out += self._open.feed(buffer[:at].encode("utf-8"))
            buffer = buffer[at:]
            if over:
                self._held = buffer
                return out
            out += self._open.close()
            self._mid = ""
        # A piece may still change if it ends in the last two characters or could grow with the next chunk.
        pieces, tail = o.pieces(buffer), 0
        while pieces and tail < 2:
            tail += len(pieces.pop())
        out += o.pieces_ids(pieces)
        held = buffer[len(buffer) - tail :]
        if len(held) > 2 + o.window:
            # A run longer than the window: hand its start on as an open piece. White space keeps its last character.
            kind = _kind(held[1] if held[0] == " " else held[0])
            if _run(held, int(kind != "s" and held[0] == " "), kind) == len(held):
                keep = int(kind == "s")
                out += self._open.feed(held[: len(held) - keep].encode("utf-8"))
                self._mid, held = kind, held[len(held) - keep :]
        self._held = held
        return out

    def close(self) -> list[int]:
        out = []
        if self._mid == "s":
            out += self._open.feed(self._held.encode("utf-8"))
            self._held = ""
        # Where a run was handed on, what is held of it ends it: the run's ids come first.
        if self._mid:
            out += self._open.close()
            self._mid = ""
        out += self.owner.pieces_ids(self.owner.pieces(self._held))
        self._held = ""
        return out


class _OpenPiece:
    """The byte transducer: takes a piece's bytes as they come, emits tokens that no further byte can change."""

    def __init__(self, owner: Encoder):
        self.owner, self.held = owner, bytearray()

    def feed(self, data: bytes) -> Iterator[int]:
        o = self.owner
        for i in range(0, len(data), o.window):
            self.held += data[i : i + o.window]
            if len(self.held) < 2 * o.window:
                continue
            tokens, end = _merged(bytes(self.held), o.ranks), 0
            stable = len(self.held) - o.lookahead
            for t in tokens:
                if end + len(t) > stable:
                    break
                end += len(t)
                yield o.ranks[t]
            del self.held[:end]

    def close(self) -> Iterator[int]:
        if self.held:
            yield from self.owner._bytes_ids(bytes(self.held))
            self.held.clear()


_LETTER, _NUMBER, _SPACE = (regex.compile(p) for p in (r"\p{L}", r"\p{N}", r"\s"))
_RUNS = {"l": regex.compile(r"\p{L}*"), "n": regex.compile(r"\p{N}*"), "o": regex.compile(r"[^\s\p{L}\p{N}]*"), "s": regex.compile(r"\s*")}


def _kind(c: str) -> str:
    return "l" if _LETTER.match(c) else "n" if _NUMBER.match(c) else "s" if _SPACE.match(c) else "o"


def _run(text: str, at: int, kind: str) -> int:
    return _RUNS[kind].match(text, at).end()


class Decoder:
    """Bytes to text as ids come: an incremental UTF-8 state machine that holds at most three bytes of an open character."""

    def __init__(self, ranks: dict[bytes, int]):
        self._bytes = {i: b for b, i in ranks.items()}
        self._state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self._state.decode(b"".join(self._bytes[i] for i in ids))

    def close(self) -> str:
        rest = self._state.decode(b"", True)
        self._state.reset()
        return rest


@cache
def encoder(folder: str = FOLDER, name: str = VOCABULARY) -> Encoder:
    """One per Python worker."""
    return Encoder(load_ranks(folder, name))


def with_ids(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), folder: str = FOLDER, name: str = VOCABULARY) -> DataFrame:
    """``keep`` and ``ids`` (array of int), row by row; null and empty texts get an empty list. Whole texts, any length."""
    return _mapped(docs, text, keep, "ids array<int>", lambda e, t: e.ids(t), folder, name)


def with_counts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), folder: str = FOLDER, name: str = VOCABULARY) -> DataFrame:
    """``keep`` and ``n_tokens`` (long): the number of ids of the whole text, 0 for null and empty texts."""
    return _mapped(docs, text, keep, "n_tokens bigint", lambda e, t: len(e.ids(t)), folder, name)


def round_trips(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), folder: str = FOLDER, name: str = VOCABULARY) -> DataFrame:
    """``keep``, ``n_bytes`` that the decoder gives from ids fed in small portions, and whether they are the text's (``same``)."""

    def check(e: Encoder, text_: str | None) -> dict:
        ids, decoder = e.ids(text_), Decoder(e.ranks)
        back = "".join(decoder.feed(ids[i : i + 7]) for i in range(0, len(ids), 7)) + decoder.close()
        return {"n_bytes": len(back.encode("utf-8")), "same": back == (text_ or "")}

    flat = _mapped(docs, text, keep, "trip struct<n_bytes:bigint,same:boolean>", check, folder, name)
    return flat.select(*keep, "trip.n_bytes", "trip.same")


def _mapped(docs: DataFrame, text: str, keep: tuple[str, ...], out: str, f, folder: str, name: str) -> DataFrame:
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_type

    kept = spread(docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text")))
    field = _parse_datatype_string(out).fields[0]
    kind = to_arrow_type(field.dataType)

    def batches(it):
        e = encoder(folder, name)
        for b in it:
            made = pa.array([f(e, t) for t in b.column("_text").to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], made], names=[*keep, field.name])

    from pyspark.sql.types import StructType

    schema = StructType([*[x for x in kept.schema.fields if x.name != "_text"], field])
    return kept.mapInArrow(batches, schema)
