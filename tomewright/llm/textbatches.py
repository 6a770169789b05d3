"""Arrow batches of whole texts: slicing by bytes, and encoding by distinct words.

Token encoders work on pieces of a text that can't influence each other. A batch
is cut into such pieces by Arrow, each distinct piece is encoded once, and the
ids of a text are gathered by index. The result is what encoding the whole text
gives; the tests hold it against the libraries on whole texts."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text that are encoded together (a longer text is a slice of its own).
SLICE_BYTES = 8 << 20
#: Bytes of an Arrow batch between Spark and Python.
BATCH_BYTES = 15 << 19
#: A Python worker keeps the ids of so many pieces, over batches and tasks (and a batch's more, once).
CACHED_WORDS = 100_000
#: Pieces that go to the library as one text.
JOINED = 64
#: White space of any dialect of regular expressions that the tokenizers use.
_RE2_SPACE = r"[\s\v\x{1c}-\x{1f}\x{85}\p{Z}]"
#: Letters that every dialect and version of Unicode has as letters, with simple case; and marks that are no letter,
#: number or space in any.
_LETTERS = "".join(map(chr, (*range(65, 91), *range(97, 123), *(x for x in range(0xC0, 0x100) if x not in (0xD7, 0xF7)))))
_MARKS = "".join(chr(x) for x in range(33, 127) if not chr(x).isalnum())


def map_batches(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` whose batches hold BATCH_BYTES at most, or one row: rows of long texts would else
    make batches of any size. Sets a session setting, which holds for whatever runs afterwards too."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``limit`` bytes of text, or one row. Null texts become empty."""
    at = batch.schema.get_field_index(column)
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes.astype(np.int64)), 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        part = batch.slice(start, stop - start)
        # a copy of the part alone, whose offsets begin at 0: kernels that keep offsets need that
        text = part.column(at).take(pa.array(np.arange(part.num_rows)))
        text = pc.fill_null(text.cast(pa.large_string()), "")
        yield pa.RecordBatch.from_arrays([text if i == at else c for i, c in enumerate(part.columns)], names=batch.schema.names)
        start = stop


def gather(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the runs ``ids[starts[p]:starts[p]+lengths[p]]`` for p in picks; also their ends."""
    n = lengths[picks]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    out = np.arange(total, dtype=np.int64)
    out += np.repeat(starts[picks] - (ends - n), n)
    return ids[out], ends


def by_distinct(
    words: pa.Array, picks: np.ndarray, offsets: np.ndarray, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]
) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, flat, and each text's offsets. A text's pieces are the distinct ``words`` at ``picks``,
    between two of ``offsets``; ``encode`` returns ids of the words, and their starts and lengths there."""
    ids, starts, lengths = encode(words)
    flat, ends = gather(ids, starts, lengths, picks)
    return flat, np.r_[0, ends][offsets]


def _matches(texts: pa.Array, form: str) -> np.ndarray:
    return pc.match_substring_regex(texts, form).to_numpy(zero_copy_only=False)


def listed(pieces: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct pieces of lists, which of them the lists hold, and the lists' offsets."""
    coded, offsets = pieces.flatten().dictionary_encode(), pieces.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), offsets - offsets[0]


def either_way(texts: pa.Array, odd: np.ndarray, plain: Callable, careful: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids and offsets of all texts: ``careful`` encodes those marked as odd, ``plain`` the others."""
    if not odd.any():
        return plain(texts)
    even, rest = np.flatnonzero(~odd), np.flatnonzero(odd)
    (a, to_a), (b, to_b) = plain(texts.take(pa.array(even))), careful(texts.take(pa.array(rest)))
    starts, lengths = np.r_[to_a[:-1], len(a) + to_b[:-1]], np.r_[np.diff(to_a), np.diff(to_b)]
    order = np.empty(len(odd), np.int64)
    order[np.r_[even, rest]] = np.arange(len(odd))
    flat, ends = gather(np.concatenate([a, b]), starts, lengths, order)
    return flat, np.r_[0, ends]


class Pool:
    """Ids of pieces that were encoded before: grown in place, looked up by their strings."""

    def __init__(self) -> None:
        self.ids, self.starts, self.lengths = np.empty(1 << 16, np.uint32), np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int64)
        self.n_ids = self.n = 0
        self.known = pa.array([], pa.large_string())

    def find(self, words: pa.Array) -> np.ndarray:
        """The place of each word, or -1."""
        return pc.index_in(words, value_set=self.known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

    def add(self, words: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The places of new words, whose ids lie one after another. Beyond CACHED_WORDS they are lent
        for this slice only: ``trim`` forgets them."""
        self.ids = _room(self.ids, self.n_ids, len(ids))
        self.starts, self.lengths = (_room(x, self.n, len(lengths)) for x in (self.starts, self.lengths))
        at = np.arange(self.n, self.n + len(lengths))
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.starts[at], self.lengths[at] = self.n_ids + np.cumsum(lengths) - lengths, lengths
        if len(self.known) == self.n and self.n < CACHED_WORDS:
            self.known = pa.concat_arrays([self.known, words])
        self.n, self.n_ids = self.n + len(lengths), self.n_ids + len(ids)
        return at

    def trim(self) -> None:
        """Keep the words that are known by their strings."""
        self.n = len(self.known)
        self.n_ids = int(self.starts[self.n - 1] + self.lengths[self.n - 1]) if self.n else 0


def _room(x: np.ndarray, used: int, more: int) -> np.ndarray:
    if used + more <= len(x):
        return x
    grown = np.empty(max(2 * len(x), used + more), x.dtype)
    grown[:used] = x[:used]
    return grown


_POOLS: dict[tuple, Pool] = {}


class DistinctWordTokenizer:
    """A `tokenizers` BPE file applied to whole texts by way of their distinct pieces.

    ``spaces='kept'`` is for byte-level BPE, whose words start with their space: a text
    is cut before every space that doesn't stand between white space. ``spaces='dropped'``
    is for vocabularies that drop white space before the merges and mark the ends of words: a text is
    cut at ASCII white space. A new piece of letters and marks is cut between them, as both kinds of
    vocabulary do, and pieces of letters go to the library many at a time.

    The added tokens' strings in a text are those tokens, as the library has it; with
    ``special_as_text`` they are ordinary text (the library's ``encode_special_tokens``)."""

    def __init__(self, path: str, spaces: str, *, special_as_text: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.keeps_spaces = {"kept": True, "dropped": False}[spaces]
        self.pool = _POOLS.setdefault((path, spaces, special_as_text), Pool())
        added = [] if special_as_text else [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = "|".join(map(re.escape, sorted(added, key=len, reverse=True)))
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        # what of a joined text an id stands for: bytes (a byte-level token has a character for each), or ends of words
        self.spans = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.spans[i] = len(token) if self.keeps_spaces else token.endswith("</w>")
        self._cut = re.compile(r"(?<=\S) (?=\S)")

    def _special(self, texts: pa.Array) -> np.ndarray:
        """Which texts have an added token's string."""
        return _matches(texts, self.special) if self.special else np.zeros(len(texts), bool)

    def _library(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths of pieces, from the library."""
        parts, lengths = [np.empty(0, np.uint32)], np.empty(len(words), np.int64)
        for at in range(0, len(words), 8192):  # the library's result objects are large
            some = [x.ids for x in self.tokenizer.encode_batch_fast(words[at : at + 8192], add_special_tokens=False)]
            lengths[at : at + len(some)] = [len(x) for x in some]
            parts.append(np.fromiter(chain.from_iterable(some), np.uint32))
        return np.concatenate(parts), lengths

    def _library_joined(self, words: pa.Array, between: str) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces that end where the vocabulary ends a word: many are encoded as one
        text, and each one's ids are told by the bytes or the ends of words that they stand for.
        A line feed ``between`` them is a token of its own and goes again."""
        strings, feed = words.to_pylist(), between == "\n"
        end = between if feed else ""
        flat, _ = self._library([between.join(strings[at : at + JOINED]) + end for at in range(0, len(strings), JOINED)])
        done = np.cumsum(self.spans[flat])
        sizes = pc.binary_length(words).to_numpy(zero_copy_only=False) + feed if self.keeps_spaces else np.ones(len(words), np.int64)
        want = np.cumsum(sizes)
        if len(want) and (not len(done) or done[-1] != want[-1]):
            raise AssertionError("joined pieces weren't encoded one by one")
        cuts = np.searchsorted(done, want, side="left") + 1
        return (np.delete(flat, cuts - 1), np.diff(np.r_[0, cuts]) - 1) if feed else (flat, np.diff(np.r_[0, cuts]))

    def _atoms(self, words: pa.Array) -> np.ndarray:
        """Places in the pool of pieces that aren't cut further."""
        at = self.pool.find(words)
        missing = np.flatnonzero(at < 0)
        fresh, left = words.take(pa.array(missing)), np.ones(len(missing), bool)
        plain = ~self._special(fresh)
        ways = [(rf"\A [^{_RE2_SPACE[1:]}+\z", ""), (rf"\A[^{_RE2_SPACE[1:]}+\z", "\n")] if self.keeps_spaces else [(rf"\A[{_LETTERS}]+\z", " ")]
        for form, between in ways:
            some = np.flatnonzero(left & plain & _matches(fresh, form))
            part, left[some] = fresh.take(pa.array(some)), False
            at[missing[some]] = self.pool.add(part, *self._library_joined(part, between))
        rest = fresh.filter(pa.array(left))
        at[missing[left]] = self.pool.add(rest, *self._library(rest.to_pylist()))
        return at

    def _encode_distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and where in it each of the words' ids start and how many they are.

        New words are cut at line feeds between other characters, and between letters and the marks after them."""
        words, pool = words.cast(pa.large_string()), self.pool
        pool.trim()
        at = pool.find(words)
        missing = np.flatnonzero(at < 0)
        fresh = words.take(pa.array(missing))
        plain = ~self._special(fresh)
        lines, first = fresh, np.ones(len(fresh), bool)
        if self.keeps_spaces:
            fed = plain & _matches(fresh, rf"\A ?[^{_RE2_SPACE[1:]}+(?:\n[^{_RE2_SPACE[1:]}+)+\z")
            cut = pc.split_pattern(fresh.filter(pa.array(fed)), "\n")
            counts = np.ones(len(fresh), np.int64)
            counts[fed] = pc.list_value_length(cut).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(fresh)), counts)
            order = np.empty(len(owner), np.int64)
            order[fed[owner]], order[~fed[owner]] = np.arange(counts[fed].sum()), counts[fed].sum() + np.arange((~fed).sum())
            lines = pa.concat_arrays([cut.flatten(), fresh.filter(pa.array(~fed))]).take(pa.array(order))
            first, plain = np.r_[True, owner[1:] != owner[:-1]][: len(owner)], plain[owner]
        stem = pc.utf8_rtrim(lines, _MARKS)
        lead = " ?" if self.keeps_spaces else ""
        two = plain & _matches(stem, rf"\A{lead}[{_LETTERS}]+\z")
        two &= pc.less(pc.binary_length(stem), pc.binary_length(lines)).to_numpy(zero_copy_only=False)
        tail = pc.utf8_ltrim(lines.filter(pa.array(two)), " " + _LETTERS)
        parts = pa.concat_arrays([pc.if_else(pa.array(two), stem, lines), tail, pa.array(["\n"], pa.large_string())]).dictionary_encode()
        # the parts of each word in order: of each line its feed, but for the first, its stem or whole, and its tail
        sizes = 1 + two + ~first
        begins = np.cumsum(sizes) - sizes
        order = np.empty(int(sizes.sum()), np.int64)
        order[begins[~first]] = len(parts) - 1
        order[begins + ~first] = np.arange(len(lines))
        order[(begins + ~first + 1)[two]] = len(lines) + np.arange(len(tail))
        places = self._atoms(parts.dictionary)[parts.indices.to_numpy(zero_copy_only=False)][order]
        ids, ends = gather(pool.ids, pool.starts, pool.lengths, places)
        of_words = np.r_[0, ends][np.r_[begins[first], len(order)]]
        simple = np.diff(np.r_[np.flatnonzero(first), len(lines)]) == 1
        simple[simple] &= ~two[first][simple]  # these are atoms, and in the pool already
        at[missing[simple]] = places[begins[first][simple]]
        other = np.repeat(~simple, np.diff(of_words))
        at[missing[~simple]] = pool.add(fresh.filter(pa.array(~simple)), ids[other], np.diff(of_words)[~simple])
        return pool.ids, pool.starts[at], pool.lengths[at]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and len(texts)+1 offsets."""
        if not self.keeps_spaces:
            return by_distinct(*listed(pc.ascii_split_whitespace(texts)), self._encode_distinct)
        marks = _matches(texts, rf"{_RE2_SPACE} (?:{_RE2_SPACE}|\z)") | self._special(texts)
        careful = lambda some: pa.array([self._split_carefully(x) for x in some.to_pylist()], pa.large_list(pa.large_string()))
        return either_way(
            texts, marks, lambda x: by_distinct(*self._split_plain(x), self._encode_distinct), lambda x: by_distinct(*listed(careful(x)), self._encode_distinct)
        )

    def _split_plain(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Pieces at every space, as ``listed``; all but the first of a text get their space back."""
        words, picks, offsets = listed(pc.split_pattern(texts, " "))
        empty, space = (pa.scalar(x, type=words.type) for x in ("", " "))
        both = pa.concat_arrays([pc.binary_join_element_wise(empty, words, space), words])
        picks = picks.astype(np.int64)
        picks[offsets[:-1]] += len(words)  # no text has no piece
        used = np.bincount(picks, minlength=len(both)) > 0
        return both.filter(pa.array(used)), (np.cumsum(used) - 1)[picks], offsets

    def _split_carefully(self, text: str) -> list[str]:
        """The same where white space meets white space, or an added token stands: what is between such tokens is a text."""
        pieces = []
        for part in re.split(f"({self.special})", text) if self.special else [text]:
            first, *rest = self._cut.split(part)
            pieces += [first, *(f" {x}" for x in rest)]
        return [x for x in pieces if x]
