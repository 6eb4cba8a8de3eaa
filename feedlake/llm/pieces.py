"""SentencePiece encoding and decoding by a streaming Viterbi search.

The vocabulary of a SentencePiece model is read on the driver (tens of thousands of pieces) and sent to the tasks. Text
gets a leading space and is read left to right. State ``i`` is the best way to cut the text up to ``i``; it needs only
the states of the last ``longest piece`` characters, so that is all that is kept. Whenever the backpointer paths of all
states in that window meet at one boundary, the ids up to it are final and are handed out.

For a unigram model the best way has the largest sum of scores. For a BPE model a piece may follow another only if the
model's merges, applied to both together, give back just these two; under that rule one way is left for each state, and
it is the one that the merges give for the whole text. Characters without a piece become bytes.

No piece crosses the start of a run of spaces, so all paths meet there; so it is between a letter and those marks that no
piece of the model has behind a letter. Results for the stretches between are remembered for stretches met again; the short
new ones of a call are searched side by side (``lockstep``), longer ones one after the other. Null text is encoded as the empty text (no ids). A U+2581 in a text is read as a space, which
the model cannot tell apart. Repeated rows are encoded one by one; only doc_id and text are read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm.lockstep import Lockstep

SPACE = "▁"
STRETCH = re.compile(r" +[^ ]*")
MARKS = ".,;:!?#*$%&|<>()"
#: Stretches a worker remembers; a limit on memory, nothing depends on it.
REMEMBERED = 600_000
#: Characters of a stretch that is searched side by side with others, or remembered.
SHORT = 48
_FOUND: dict[int, tuple] = {}


class Model:
    """Pieces with ids and scores. ``merges``: it is a BPE model; else unigram."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int] | None, unknown: int, merges: bool):
        self.pieces, self.byte_ids, self.unknown, self.merges = pieces, byte_ids, unknown, merges
        self.longest = max(map(len, pieces), default=1)
        self.least = min((s for _, s in pieces.values()), default=0.0) - 10.0
        self.bytes_of = {i: p.encode() for p, (i, _) in pieces.items()} | {i: bytes((b,)) for b, i in enumerate(byte_ids or [])}
        #: Of BPE pieces: the parts joined last. A piece that its own merges do not give can never occur.
        self.parts: dict[str, tuple[str, str]] = {}
        if merges:
            made = {p: self.merged(p, 2) for p in pieces if len(p) > 1}
            self.parts = {p: tuple(x) for p, x in made.items() if len(x) == 2 and "".join(x) == p}
            self.usable = {p for p in pieces if len(p) == 1 or p in self.parts}
        else:
            self.usable = set(pieces)
        scores = sorted(s for _, s in pieces.values())
        self.tied = {a for a, b in zip(scores, scores[1:]) if a == b}
        self.begins = {p[:k] for p in self.usable for k in range(2, len(p) + 1)}
        # No piece crosses from a letter to one of these marks: what is before and behind can be encoded alone.
        crossed = {b for p in pieces for a, b in zip(p, p[1:]) if a.isalpha()}
        marks = "".join(c for c in MARKS + "\n" if c not in crossed)
        self.borders = re.compile(rf"(?<=[^\W\d_])(?=[{re.escape(marks)}])") if marks else None
        self.name = zlib.crc32(repr((sorted(pieces.items()), merges)).encode())
        self._remember()

    def _remember(self) -> None:
        """What a worker has found out about this model serves its later tasks too."""
        self._follows, self._known, self._edges, self._changed, self._lockstep = _FOUND.setdefault(self.name, ({}, {}, {}, set(), []))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._remember()

    @classmethod
    def load(cls, path: str) -> "Model":
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, byte_ids = {}, {}
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                byte_ids[int(sp.id_to_piece(i)[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                pieces[sp.id_to_piece(i).replace(SPACE, " ")] = (i, sp.get_score(i))
        # A BPE model scores its pieces by rank: 0, -1, -2, ...
        merges = all(s == int(s) for _, s in pieces.values())
        return cls(pieces, [byte_ids[b] for b in range(256)] if len(byte_ids) == 256 else None, sp.unk_id(), merges)

    def merged(self, text: str, stop: int = 1) -> list[str]:
        """Pieces of a short text by merging the best neighbours first, the leftmost of equals, until ``stop`` are left."""
        parts = list(text)
        while len(parts) > stop:
            best, at = None, -1
            for k in range(len(parts) - 1):
                p = self.pieces.get(parts[k] + parts[k + 1])
                if p is not None and (best is None or p[1] > best):
                    best, at = p[1], k
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edge(self, piece: str, side: int) -> list[tuple[str, float, float]]:
        """Sub-pieces at one end of a piece, with the scores of the merges that make and that use up each."""
        found = self._edges.get((piece, side))
        if found is None:
            found, inner, used = [], piece, float("-inf")
            while inner is not None:
                parts = self.parts.get(inner)
                made = self.pieces[inner][1] if parts else float("inf")
                found.append((inner, made, used))
                inner, used = (parts[side] if parts else None), made
            self._edges[piece, side] = found
        return found

    def follows(self, a: str, b: str) -> bool:
        """Whether b may stand behind a: in a BPE model, whether no merge across their border comes before the merges
        that make the two. Merges go by falling score; of two equal ones the left is first."""
        if not self.merges:
            return True
        for x, made_x, used_x in self._edge(a, 1):
            for y, made_y, used_y in self._edge(b, 0):
                joined = self.pieces.get(x + y)
                if joined is None:
                    continue
                score = joined[1]
                if score in self.tied:
                    return self.merged(a + b) == [a, b]
                if score <= min(made_x, made_y) and score > used_x and score >= used_y:
                    return False
        return True

    def stream(self, text: str):
        """Ids of ``text`` as lists, each handed out as soon as it is final."""
        usable, begins, longest, merges, size = self.usable, self.begins, self.longest, self.merges, len(text)
        committed = 0
        #: The last piece of the best way to each boundary, and the way's score; boundaries before a commit are dropped.
        states, scores = {0: ""}, {0: 0.0}
        for start in range(size):
            before = states[start]
            known = self._follows.get(before)
            if known is None:
                if len(self._follows) >= REMEMBERED // 20:
                    self._follows.clear()
                known = self._follows[before] = {}
            for end in range(start + 1, min(size, start + longest) + 1):
                piece = text[start:end]
                if end - start > 1:
                    if piece not in begins:
                        break
                    if piece not in usable:
                        continue
                if merges:
                    if end in states:
                        continue
                    fits = known.get(piece)
                    if fits is None:
                        fits = known[piece] = not before or self.follows(before, piece)
                    if fits:
                        states[end] = piece
                else:
                    entry = self.pieces.get(piece)
                    score = scores[start] + (self.least if entry is None else entry[1])
                    if end not in states or score > scores[end]:
                        states[end], scores[end] = piece, score
            if start - committed >= 2 * longest:
                boundary = self._meet(states, start + 1)
                if boundary > committed:
                    yield self._path(states, boundary, committed)
                    committed = boundary
                    states = {k: v for k, v in states.items() if k >= boundary}
                    scores = {k: v for k, v in scores.items() if k >= boundary}
        if size > committed:
            yield self._path(states, size, committed)

    def _meet(self, states, begin: int) -> int:
        """The boundary where the paths of all states from ``begin`` on meet."""
        front = {k for k in range(begin, begin + self.longest) if k in states}
        while len(front) > 1:
            latest = max(front)
            front.remove(latest)
            front.add(latest - len(states[latest]))
        return front.pop()

    def _path(self, states, end: int, begin: int) -> list[int]:
        back = []
        while end > begin:
            back.append(states[end])
            end -= len(states[end])
        pieces, out = self.pieces, []
        for piece in reversed(back):
            found = pieces.get(piece)
            if found is not None:
                out.append(found[0])
            else:
                out += self.alone(piece)
        return out

    def alone(self, character: str) -> list[int]:
        """Ids of a character without a piece."""
        return [self.byte_ids[b] for b in character.encode()] if self.byte_ids else [self.unknown]

    def _search(self, parts: set[str]) -> dict[str, bytes]:
        """Ids, as bytes, of each part; notes those whose ids do not decode to them."""
        if not parts:
            return {}
        short = [p for p in parts if len(p) <= SHORT] if self.merges else []
        if short and not self._lockstep:
            self._lockstep.append(Lockstep(self))
        found = self._lockstep[0].encode(short) if short else {}
        for part in parts - found.keys():
            found[part] = np.array([i for some in self.stream(part) for i in some], np.int32)
        out = {part: ids.tobytes() for part, ids in found.items()}
        # All at once where that can be: the same bytes in all, and as many in each.
        texts, pieces = [p.encode() for p in found], list(map(self.bytes_of.get, np.concatenate(list(found.values())).tolist()))
        if None in pieces or b"".join(pieces) != b"".join(texts) or not self._same_ends(texts, pieces, [len(x) for x in found.values()]):
            self._changed.update([p for p, ids in found.items() if self._bytes(ids.tolist()) != p.encode()])
        return out

    @staticmethod
    def _same_ends(texts: list[bytes], pieces: list[bytes], n_ids: list[int]) -> bool:
        ends = np.cumsum([0, *map(len, pieces)])[np.cumsum(n_ids)]
        return np.array_equal(ends, np.cumsum([len(t) for t in texts]))

    def _learn(self, stretches: set[str]) -> dict[str, bytes]:
        """Ids, as bytes, of stretches that are not remembered."""
        known, changed = self._known, self._changed
        split = {s: self.borders.split(s) if self.borders else [s] for s in stretches}
        out = self._search(set().union(*split.values()) - known.keys())
        for stretch, parts in split.items():
            if len(parts) > 1:
                out[stretch] = b"".join([out[p] if p in out else known[p] for p in parts])
                if not changed.isdisjoint(parts):
                    changed.add(stretch)
        return out

    def encode_all(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        """Ids of each text, as bytes, and whether they decode to it (a U+2581 read as a space).

        Pieces decode one by one, so ids that give back each stretch give back the text.
        """
        split = [STRETCH.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        met = set().union(*split)
        # Texts are put together from the stretches of this call: a small table stays in the processor's cache.
        known = self._known
        own = {s: known[s] for s in met if s in known}
        fresh = self._learn(met - own.keys())
        own.update(fresh)
        out = [(b"".join(map(own.__getitem__, parts)), not self._changed or self._changed.isdisjoint(parts)) for parts in split]
        # What comes first is what comes often.
        if len(known) < REMEMBERED:
            known.update((s, ids) for s, ids in fresh.items() if len(s) <= SHORT)
        self._changed.difference_update([s for s in self._changed if s not in known])
        return out

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_all([text or ""])[0][0], np.int32).tolist()

    def _bytes(self, ids) -> bytes:
        unknown = " ⁇ ".encode()
        return b"".join([self.bytes_of.get(i, unknown) for i in ids])

    def decode(self, ids) -> str:
        text = self._bytes(ids).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


DDL = "doc_id long, ids array<int>, n_ids long, n_chars long, round_trip boolean"


def encode(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, ids, n_ids, n_chars of every whole text, and whether decoding the ids gives it back (U+2581 as a space)."""
    def run(batches):
        for batch in batches:
            for part in (batch.slice(k, 500) for k in range(0, batch.num_rows, 500)):
                texts = [t or "" for t in part.column("text").to_pylist()]
                found = model.encode_all(texts)
                offsets = np.cumsum([0, *(len(ids) // 4 for ids, _ in found)])
                chars, same = [len(t) for t in texts], [ok for _, ok in found]
                values = pa.array(np.frombuffer(b"".join([ids for ids, _ in found]), np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values),
                     pa.array(np.diff(offsets), pa.int64()), pa.array(chars, pa.int64()), pa.array(same)],
                    ["doc_id", "ids", "n_ids", "n_chars", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, DDL)
