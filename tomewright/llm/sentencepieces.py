"""SentencePiece encoding and decoding of whole texts (operator 1).

Merge-type vocabularies are applied as their definition says: a score-ordered agenda of
adjacent symbol pairs. The highest-scored pair that forms a piece is merged first, the
leftmost of equals first, until none is left; what is no piece becomes byte pieces.
Short segments share an agenda that works on all of a batch's distinct segments at once
(numpy); long ones get a heap. Every batch's distinct segments, and every whole text that
needed careful cutting, are checked against the sentencepiece library; a difference raises.

Defined results: null text counts as empty; empty text has only the begin and end ids;
repeated rows are encoded each; other columns are ignored; an empty table gives no rows."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomewright.llm.textbatches import by_distinct, either_way, listed, map_batches, slices

SPACE = "▁"
#: Symbols of a segment up to which it goes into the shared agenda.
SHARED_AGENDA = 48
OUTPUTS = {
    "n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string",
}


class MergeEncoder:
    """Encoder of one merge-type SentencePiece model."""

    def __init__(self, path: str, check: bool = True) -> None:
        import sentencepiece

        self.library, self.check = sentencepiece.SentencePieceProcessor(model_file=path), check
        lib, n = self.library, self.library.vocab_size()
        normal = {lib.id_to_piece(i): i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))}
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("pieces with inner spaces: segments would depend on each other")
        self.size, self.unknown = n, lib.unk_id()
        self.score = np.array([lib.get_score(i) for i in range(n)])
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if any(lib.is_byte(i) for i in range(n)) else None
        symbols = {c for p in normal for c in p}
        #: Ids of single characters; characters that are no piece get ids from the vocabulary's size on.
        self.chars = {c: normal.get(c, n + k) for k, c in enumerate(sorted(symbols))}
        self.first_free = n + len(symbols)
        self.place = dict(normal) | {c: i for c, i in self.chars.items()}
        pairs = {}
        for piece, i in normal.items():
            for k in range(1, len(piece)):
                a, b = self.place.get(piece[:k]), self.place.get(piece[k:])
                if a is not None and b is not None:
                    pairs[a, b] = i
        self.merged = pairs
        self.width = self.first_free + 0x110000
        keys = np.array([a * self.width + b for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self._keys, self._values = keys[order], np.array(list(pairs.values()), dtype=np.int64)[order]
        self._char_table = np.arange(0x110000, dtype=np.int64) + self.first_free
        for c, i in self.chars.items():
            self._char_table[ord(c)] = i

    # --- the agenda ---

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols forms, or -1."""
        keys = left * self.width + right
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[at] == keys, self._values[at], -1)

    def _shared_agenda(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge all segments (rows of equal ``owner``, in order) until no pair is left."""
        done_s, done_o = [], []
        pair = np.full(len(symbols), -1, np.int64)
        pair[:-1] = np.where(owner[:-1] == owner[1:], self._pair(symbols[:-1], symbols[1:]), -1)
        while len(symbols):
            heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            score = np.where(pair >= 0, self.score[pair], -np.inf)
            best = np.maximum.reduceat(score, heads)
            open_ = best > -np.inf
            sizes = np.diff(np.r_[heads, len(symbols)])
            if not open_.all():  # segments with no pair left are done
                out = np.repeat(~open_, sizes)
                done_s.append(symbols[out])
                done_o.append(owner[out])
                symbols, owner, pair, score = symbols[~out], owner[~out], pair[~out], score[~out]
                best, sizes = best[open_], sizes[open_]
                if not len(symbols):
                    break
            tops = np.flatnonzero(score == np.repeat(best, sizes))
            left = tops[np.r_[True, owner[tops[1:]] != owner[tops[:-1]]]]
            symbols[left] = pair[left]
            keep = np.ones(len(symbols), bool)
            keep[left + 1] = False
            spot = left - np.arange(len(left))  # after the removal; one removal before each
            symbols, owner, pair = symbols[keep], owner[keep], pair[keep]
            n = len(symbols)
            for at in (spot - 1, spot):
                at = at[(at >= 0) & (at < n)]
                nxt = np.minimum(at + 1, n - 1)
                same = (owner[at] == owner[nxt]) & (nxt > at)
                pair[at] = np.where(same, self._pair(symbols[at], symbols[nxt]), -1)
        s, o = np.concatenate([*done_s, symbols]), np.concatenate([*done_o, owner])
        order = np.argsort(o, kind="stable")
        return s[order], o[order]

    def _heap_agenda(self, symbols: list[int]) -> list[int]:
        """The same for one long segment: a heap of pairs, with links between live symbols."""
        n = len(symbols)
        before, after, live = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        agenda: list[tuple[float, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (piece := self.merged.get((symbols[i], symbols[j]))) is not None:
                heapq.heappush(agenda, (-float(self.score[piece]), i, symbols[i], symbols[j], piece))

        for i in range(n):
            offer(i)
        while agenda:
            _, i, a, b, piece = heapq.heappop(agenda)
            j = after[i] if live[i] else n
            if j >= n or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], live[j], after[i] = piece, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [s for s, x in zip(symbols, live, strict=True) if x]

    def _spell(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids for symbols: characters that are no piece become byte pieces, or the unknown id."""
        odd = np.flatnonzero(symbols >= self.size)
        if not len(odd):
            return symbols, owner
        back = {i: c for c, i in self.chars.items()}
        counts, spelled = np.ones(len(symbols), np.int64), {}
        for k in odd.tolist():
            s = int(symbols[k])
            c = back[s] if s < self.first_free else chr(s - self.first_free)
            spelled[k] = [self.bytes[b] for b in c.encode()] if self.bytes else [self.unknown]
            counts[k] = len(spelled[k])
        ends = np.cumsum(counts)
        ids = np.repeat(symbols, counts)
        for k, x in spelled.items():
            ids[ends[k] - counts[k] : ends[k]] = x
        return ids, np.repeat(owner, counts)

    def encode_distinct(self, segments: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, lengths = self.encode_segments(segments.to_pylist())
        return ids, np.cumsum(lengths) - lengths, lengths

    def encode_segments(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and lengths of segments; each stands for a space and the string."""
        if not segments:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        sizes = np.array([len(x) + 1 for x in segments])
        points = np.frombuffer((SPACE + SPACE.join(segments)).encode("utf-32-le"), dtype="<u4")
        symbols, owner = self._char_table[points], np.repeat(np.arange(len(segments)), sizes)
        short = sizes[owner] <= SHARED_AGENDA
        s, o = self._shared_agenda(symbols[short], owner[short])
        if not short.all():
            ends = np.cumsum(sizes)
            for k in np.flatnonzero(sizes > SHARED_AGENDA).tolist():
                one = np.array(self._heap_agenda(symbols[ends[k] - sizes[k] : ends[k]].tolist()))
                s, o = np.concatenate([s, one]), np.concatenate([o, np.full(len(one), k)])
            order = np.argsort(o, kind="stable")
            s, o = s[order], o[order]
        ids, owner = self._spell(s, o)
        lengths = np.bincount(owner, minlength=len(segments))
        if self.check:
            ends = np.cumsum(lengths)
            named = [k for k, x in enumerate(segments) if x]  # the library takes an empty string for an empty text
            for at in range(0, len(named), 8192):
                some = named[at : at + 8192]
                for k, want in zip(some, self.library.encode([segments[k].replace(SPACE, " ") for k in some], num_threads=1), strict=True):
                    if len(want) != lengths[k] or want != ids[ends[k] - lengths[k] : ends[k]].tolist():
                        raise ValueError("a segment encodes otherwise than by the sentencepiece library")
        return ids.astype(np.uint32), lengths

    # --- whole texts ---

    @staticmethod
    def _plain(texts: pa.Array) -> pa.ListArray:
        return pc.split_pattern(texts, " ")

    @staticmethod
    def _careful(text: str) -> list[str]:
        """Segments of a text with runs of spaces, or spaces at its ends, each without its first space."""
        return [x[1:] for x in re.findall(f"{SPACE}+[^{SPACE}]+|{SPACE}+$", SPACE + text.replace(" ", SPACE))] if text else []

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all whole texts, without begin and end ids, and len(texts)+1 offsets."""
        odd = pc.or_(pc.match_substring_regex(texts, f"  |^ | \\z|{SPACE}"), pc.equal(pc.binary_length(texts), 0)).to_numpy(zero_copy_only=False)
        careful = lambda some: pa.array([self._careful(x) for x in some.to_pylist()], pa.large_list(pa.large_string()))
        flat, offsets = either_way(
            texts, odd, lambda x: by_distinct(*listed(self._plain(x)), self.encode_distinct), lambda x: by_distinct(*listed(careful(x)), self.encode_distinct)
        )
        if self.check:
            for k in np.flatnonzero(odd).tolist():
                if self.library.encode(texts[k].as_py()) != flat[offsets[k] : offsets[k + 1]].tolist():
                    raise ValueError("a text encodes otherwise than by the sentencepiece library")
        return flat, offsets

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


class LibraryEncoder(MergeEncoder):
    """The same, with every distinct segment's ids by the library itself, so that nothing is merged twice: for who asks
    for ids, not for the agenda."""

    def encode_segments(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not segments:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        named = [x.replace(SPACE, " ") for x in segments if x]
        found = iter(self.library.encode(named, num_threads=1) if named else [])
        # the library takes an empty string for an empty text, where a segment is a space at least
        space = super().encode_segments([""])[0].tolist() if len(named) < len(segments) else []
        ids = [next(found) if x else space for x in segments]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(lengths.sum())), lengths


def encode_documents(
    docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", ends: bool = True,
    outputs: Iterable[str] = ("n_tokens", "ids", "decoded"), check: bool = True,
) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, then ``outputs`` (see OUTPUTS): ids with begin
    and end ids if ``ends``, the text decoded from them, their number, and SHA-256 digests of the
    ids as little-endian 32-bit integers and of the decoded text. The work is row by row: no shuffle."""
    outputs = list(outputs)
    kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
    picked = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    schema = f"`{id_col}` {picked.schema[0].dataType.simpleString()}, " + ", ".join(f"{x} {OUTPUTS[x]}" for x in outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = MergeEncoder(model, check)
        begin, end = ([encoder.library.bos_id()], [encoder.library.eos_id()]) if ends else ([], [])
        for batch in batches:
            for part in slices(batch):
                flat, offsets = encoder.encode(part.column(1))
                made: dict[str, list] = {x: [] for x in outputs}
                for k in range(part.num_rows):
                    ids = np.concatenate([begin, flat[offsets[k] : offsets[k + 1]], end]).astype("<u4")
                    text = encoder.decode(ids.tolist()) if "decoded" in made or "decoded_sha256" in made else ""
                    for x, value in (("n_tokens", len(ids)), ("ids", ids.astype(np.int32)), ("decoded", text)):
                        if x in made:
                            made[x].append(value)
                    if "ids_sha256" in made:
                        made["ids_sha256"].append(hashlib.sha256(ids.tobytes()).hexdigest())
                    if "decoded_sha256" in made:
                        made["decoded_sha256"].append(hashlib.sha256(text.encode()).hexdigest())
                arrays = [pa.array(made[x], type=kinds.get(x, pa.string())) for x in outputs]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=[id_col, *outputs])

    return map_batches(picked, run, schema)
