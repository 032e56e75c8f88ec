"""Byte-pair encoding of whole texts, exactly as the tokenizers library does it, and decoding.

A text is cut before every space or line feed that follows another character. The merges never cross such a place, so each
piece is encoded once per task and looked up afterwards. New pieces are first looked up in a lexicon: a minimal acyclic
transducer compiled from the frequent pieces of the corpus, memory-mapped by every worker, whose paths give the ids. Pieces
it does not hold are merged in batches with numpy: in each round every word merges all places of its lowest-ranked pair.

Texts that the cuts do not suit (white space that is no single space or line feed) are cut by a pattern, or handed to the
tokenizers library where only Unicode tables decide. Special tokens in a text are found first, as the library does.

Null texts count as empty; an empty text has no ids.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import re
import tempfile
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from levyscope.llm.common import release_memory, rows, texts
from levyscope.scale import stage

#: Fixed value: the word pattern of byte-level vocabularies.
WORD = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Pieces for texts with runs of spaces and line feeds.
PIECE = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
OTHER_SPACE = re.compile(r"[^\S \n]|[\x1c-\x1f]")
#: Letters and digits up to here have not changed between versions of Unicode; later ones are left to the library.
PLAIN_END = "ɏ"
LONG_PIECE = 4096
#: Most pieces an encoder keeps (under 300 MB), and most a count of pieces holds before it is handed on.
MEMO = 800_000
#: Most pieces that the encoding of columns keeps (about 50 MB).
KEPT = 250_000
#: A line feed or a space at most, letters up to ``PLAIN_END``, marks.
PLAIN = r"^(?P<feed>\n?)(?P<word> ?[A-Za-zÀ-ÖØ-öø-ɏ]+)(?P<marks>[!-/:-@\[-`{-~]*)$"
NO_RANK = np.int64(1 << 40)


def byte_values() -> dict[str, int]:
    """Character that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens and merges of a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        values = byte_values()
        model = data["model"]
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.tokens: list[bytes] = [b""] * (1 + max([*ids.values(), *self.special.values()]))
        for token, i in ids.items():
            self.tokens[i] = bytes(values[c] for c in token)
        for token, i in self.special.items():
            self.tokens[i] = token.encode()
        first = np.zeros(256, np.int32)
        for c, b in values.items():
            first[b] = ids[c]
        self.byte_ids = first
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([ids[a] << 20 | ids[b] for a, b in pairs], np.int64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], NO_RANK)

    @cached_property
    def byte_ranks(self) -> np.ndarray:
        """Ranks of all pairs of bytes, by the first times 256 and the second."""
        return self.ranks(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256))

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each word has."""
        return self.merge_bytes(np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words)))

    def merge_bytes(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, which lie one after the other in ``data``, and how many each word has."""
        token = self.byte_ids[data]
        word = np.repeat(np.arange(len(lengths)), lengths)
        rank = np.full(len(token), NO_RANK)
        inside = np.flatnonzero(word[1:] == word[:-1])
        rank[inside] = self.byte_ranks[data[inside].astype(np.int64) << 8 | data[inside + 1]]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(token):
            start = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            size = np.diff(np.append(start, len(word)))
            least = np.minimum.reduceat(rank, start)
            ready = np.repeat(least == NO_RANK, size)
            if ready.any():
                done.append((word[ready], token[ready]))
                token, word, rank = token[~ready], word[~ready], rank[~ready]
                least, size = least[least != NO_RANK], size[least != NO_RANK]
                if not len(token):
                    break
            hit = rank == np.repeat(least, size)
            at = np.flatnonzero(hit)
            # of overlapping places (aaa) every second is merged, from the left
            fresh = np.concatenate(([True], np.diff(at) > 1))
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            token[at] = self.merged[rank[at]]
            keep = np.ones(len(token), bool)
            keep[at + 1] = False
            spot = np.cumsum(keep)[at] - 1
            # a merged token takes over what lay between its right part and the next token: nothing is known of it yet
            token, word, rank = token[keep], word[keep], rank[keep]
            for k in (spot - 1, spot):
                k = k[(k >= 0) & (k + 1 < len(token))]
                same = word[k] == word[k + 1]
                rank[k] = np.where(same, self.ranks(token[k], token[k + 1]), NO_RANK)
            last = spot[spot + 1 == len(token)]
            rank[last] = NO_RANK
        if not done:
            return np.empty(0, np.int32), np.zeros(len(lengths), np.int64)
        word, token = (np.concatenate(c) for c in zip(*done))
        order = np.argsort(word, kind="stable")
        return token[order], np.bincount(word, minlength=len(lengths))

    def split(self, piece: str) -> list[bytes]:
        """The words of a piece."""
        if piece and (max(piece) > PLAIN_END or OTHER_SPACE.search(piece)):
            values = self.values
            return [bytes(values[c] for c in w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(piece)]
        return [w.encode() for w in WORD.findall(piece)]

    @cached_property
    def values(self) -> dict[str, int]:
        return byte_values()

    def merge_packed(self, words: list[bytes]) -> list[bytes]:
        """Packed ids (unsigned 32 bits, little-endian) of each word."""
        token, n = self.merge(words)
        ends = (4 * np.cumsum(n)).tolist()
        packed = token.astype("<u4").tobytes()
        return [packed[a:b] for a, b in zip([0, *ends], ends)]

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of each piece; equal words are merged once."""
        place: dict[bytes, int] = {}
        made = [[place.setdefault(w, len(place)) for w in self.split(p)] for p in pieces]
        words = self.merge_packed(list(place))
        return [words[m[0]] if len(m) == 1 else b"".join(map(words.__getitem__, m)) for m in made]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of the ids; special tokens are kept, and bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


# -- lexicon


class Lexicon:
    """Minimal acyclic transducer from pieces (as UTF-8) to ids, over arrays that can be memory-mapped.

    States are merged when their transitions, finality and everything below are equal, so common endings are stored once.
    A path adds up the pieces that sort before it, and this number gives the place of the ids.
    """

    def __init__(self, data):
        view, at, parts = memoryview(data), 32, []
        for n in np.frombuffer(data, np.int64, 4).tolist():
            parts.append(view[at : at + 4 * n].cast("I"))
            at += 4 * n
        self.first, self.edges, self.offset, self.ids = parts  # edges: target and pieces skipped, in turn
        self.label, self.label_at = data, at
        self.seen: dict[int, dict[int, tuple[int, int]]] = {}  # transitions of the states visited so far

    @staticmethod
    def compile(entries: list[tuple[bytes, bytes]]) -> bytes:
        """Bytes of the automaton of sorted distinct (piece, packed ids)."""
        register: dict[tuple, int] = {}
        states: list[tuple] = []  # (final, ((label, state), ...))
        below: list[int] = []

        def settle(node) -> int:
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(states)
                states.append(key)
                below.append(key[0] + sum(below[s] for _, s in key[1]))
            return register[key]

        path, before = [[False, []]], b""
        for piece, _ in entries:
            same = 0
            while same < min(len(piece), len(before)) and piece[same] == before[same]:
                same += 1
            for depth in range(len(before), same, -1):
                path[depth - 1][1].append((before[depth - 1], settle(path[depth])))
            del path[same + 1 :]
            path += [[False, []] for _ in piece[same:]]
            path[-1][0], before = True, piece
        for depth in range(len(before), 0, -1):
            path[depth - 1][1].append((before[depth - 1], settle(path[depth])))
        root = settle(path[0])
        first, edges, labels = np.zeros(len(states) + 2, np.uint32), [], bytearray()
        for i, (final, out) in enumerate(states):
            first[i] = len(labels) << 1 | final
            skipped = int(final)
            for label, to in out:
                labels.append(label)
                edges += [to, skipped]
                skipped += below[to]
        first[-2], first[-1] = len(labels) << 1, root
        ids = np.frombuffer(b"".join(e for _, e in entries), np.uint32)
        offset = np.cumsum([0, *(len(e) // 4 for _, e in entries)]).astype(np.uint32)
        parts = [first, np.array(edges, np.uint32), offset, ids]
        return np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(p.tobytes() for p in parts) + bytes(labels)

    @classmethod
    def mapped(cls, data: bytes) -> Lexicon:
        """The automaton in a file without a name, mapped into memory."""
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def transitions(self, state: int) -> dict[int, tuple[int, int]]:
        """Target and skipped pieces by label."""
        a, z = self.first[state] >> 1, self.first[state + 1] >> 1
        labels = self.label[self.label_at + a : self.label_at + z]
        return {b: (self.edges[2 * k], self.edges[2 * k + 1]) for k, b in zip(range(a, z), labels)}

    def get(self, piece: bytes) -> bytes | None:
        first, seen = self.first, self.seen
        state, place = first[-1], 0
        for b in piece:
            out = seen.get(state)
            if out is None:
                out = seen[state] = self.transitions(state)
            step = out.get(b)
            if step is None:
                return None
            state = step[0]
            place += step[1]
        return self.ids[self.offset[place] : self.offset[place + 1]].tobytes() if first[state] & 1 else None


# -- whole texts


def spelled(piece: str) -> str:
    """A piece with its white space."""
    return piece[1:] if piece[0] == "\0" else piece if piece[0] == "\n" else " " + piece


def string_bytes(column: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column's strings, one after the other, and where each ends, from 0."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.empty(0, np.uint8), ends - ends[0]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


class Runs:
    """Runs of ids in one array, taken by number."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray):
        self.ids, self.sizes = ids.astype(np.uint32), sizes
        self.starts = np.cumsum(sizes) - sizes

    @classmethod
    def packed(cls, runs: list[bytes]) -> Runs:
        return cls(np.frombuffer(b"".join(runs), "<u4"), np.fromiter((len(r) // 4 for r in runs), np.int64, len(runs)))

    def __add__(self, other: Runs) -> Runs:
        return Runs(np.concatenate([self.ids, other.ids]), np.concatenate([self.sizes, other.sizes]))

    def take(self, which: np.ndarray) -> Runs:
        sizes = self.sizes[which]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[which] - ends + sizes, sizes)
        at += np.arange(len(at))
        return Runs(self.ids[at], sizes)

    def joined(self, counts: np.ndarray) -> Runs:
        """Runs of the ids of the first ``counts[0]`` runs, of the next ``counts[1]`` and so on."""
        ends = np.concatenate([[0], np.cumsum(self.sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        return Runs(self.ids, np.diff(ends))


class Encoder:
    """Encodes texts; keeps what it has seen, up to ``MEMO`` pieces, as packed ids. Beyond that only the pieces of the last batch
    stay, which hold nearly all common words."""

    def __init__(self, path: str, lexicon: Lexicon | None = None):
        self.vocabulary, self.lexicon = Vocabulary(path), lexicon
        self.memo: dict[str, bytes | None] = {}
        self.held: dict[str, bytes] = {}  # what the lexicon has given, never forgotten and no more than it holds
        self.last: set[str] = set()
        self.numbers: dict[str, int] = {}  # pieces met in columns, with their white space, by their place in ``runs``
        self.runs = Runs.packed([])
        special = sorted(self.vocabulary.special, key=len, reverse=True)
        self.special = re.compile("|".join(f"({re.escape(s)})" for s in special)) if special else None

    @staticmethod
    def cut(text: str) -> list[str]:
        """Pieces of a text, each with the white space before it.

        A piece is written without its leading space, which the first piece of a text does not have: that one is marked.
        """
        if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[-1:] in (" ", "\n"):
            found = PIECE.findall(text)
            # a piece that starts with exactly one space goes by the short form
            return [p[1:] if p[0] == " " and p[1:2] not in ("", " ", "\n") else "\0" + p for p in found]
        pieces = text.replace("\n", " \n").split(" ")
        if text[0] == "\n":
            del pieces[0]
        elif text[0] == " ":
            del pieces[0]
        else:
            pieces[0] = "\0" + pieces[0]
        return pieces

    def learn(self, pieces: set[str]) -> None:
        """Ids of new pieces: from the lexicon, else by merging. Pieces of letters, with or without marks at the end, are the
        common form; they need no pattern, and equal words are merged once."""
        if self.lexicon is not None:
            get = self.lexicon.get
            known = {p: ids for p in pieces if (ids := get(spelled(p).encode())) is not None}
            self.held.update(known)
            self.memo.update(known)
            pieces = {p for p in pieces if p not in known}
        place: dict[str, int] = {}
        plain, others = [], []
        for p in pieces:
            core = p.rstrip(".,")
            if core.isalpha() and (core.isascii() or max(core) <= PLAIN_END) and len(core) <= LONG_PIECE:
                plain.append((p, place.setdefault(core, len(place)), len(core)))
            else:
                others.append(p)
        words = self.vocabulary.merge_packed([(" " + w).encode() for w in place])
        tails = list({p[n:] for p, _, n in plain})
        marks = dict(zip(tails, self.vocabulary.encode_pieces(tails)))
        self.memo.update((p, words[k] + marks[p[n:]]) for p, k, n in plain)
        unseen = []
        for p in others:
            whole = spelled(p)
            if self.goes_on(whole):
                self.memo[p] = None
            elif len(whole) > LONG_PIECE:
                self.memo[p] = self.by_library(whole)
            else:
                unseen.append((p, whole))
        self.memo.update(zip((p for p, _ in unseen), self.vocabulary.encode_pieces([w for _, w in unseen])))

    def by_library(self, text: str) -> bytes:
        return np.array(self.vocabulary.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts_: list[str]) -> list[bytes]:
        """Packed ids (unsigned 32 bits, little-endian) of each text."""
        parts: list[list[bytes | tuple[str, list[str]]]] = []
        needed: set[str] = set()
        for text in texts_:
            mine: list[bytes | tuple[str, list[str]]] = []
            for part in self.special.split(text) if self.special and self.special.search(text) else (text,):
                if not part:
                    continue
                if part in self.vocabulary.special:
                    mine.append(np.array([self.vocabulary.special[part]], "<u4").tobytes())
                    continue
                if "\0" in part:  # it marks a first piece
                    mine.append(self.by_library(part))
                    continue
                pieces = self.cut(part)
                mine.append((part, pieces))
                needed.update(pieces)
            parts.append(mine)
        self.last = needed
        unknown = {p for p in needed if p not in self.memo}
        if unknown:
            if len(self.memo) + len(unknown) > MEMO:
                self.trim()
            self.learn(unknown)
        return [b"".join(x if isinstance(x, bytes) else self.joined(*x) for x in mine) for mine in parts]

    def trim(self) -> None:
        """Keep what the lexicon gave and the pieces of the last batch."""
        memo = self.memo
        self.memo = self.held | {p: memo[p] for p in self.last if p in memo}

    def encode_column(self, column: pa.StringArray) -> list[bytes]:
        """``encode`` of the texts (no nulls) of a column, without a Python object per piece: the bytes are cut with numpy, Arrow
        numbers the distinct pieces, and only these are looked up. Keeps up to ``KEPT`` pieces."""
        odd = pc.match_substring(column, "\0")
        for s in self.vocabulary.special:
            odd = pc.or_(odd, pc.match_substring(column, s))
        data, ends = string_bytes(column)
        white = (data == 32) | (data == 10)
        cut = white.copy()
        cut[1:] &= ~white[:-1]
        cut[ends[:-1][ends[:-1] < len(data)]] = True
        starts = np.flatnonzero(cut).astype(np.int32)
        counts = np.diff(np.searchsorted(starts, ends))
        offsets = pa.py_buffer(np.append(starts, np.int32(len(data))))
        pieces = pa.StringArray.from_buffers(len(starts), offsets, pa.py_buffer(data)).dictionary_encode()
        which, lone = self.numbered(pieces.dictionary)
        which = which[pieces.indices.to_numpy()]
        texts_ = self.runs.take(which).joined(counts)
        ids, upto = texts_.ids.astype("<u4").tobytes(), (4 * np.cumsum(texts_.sizes)).tolist()
        out = [ids[a:z] for a, z in zip([0, *upto], upto)]
        odd = odd.to_numpy(zero_copy_only=False)
        if lone.size:  # a piece has no ids of its own
            met = np.concatenate([[0], np.cumsum(np.isin(which, lone))])[np.concatenate([[0], np.cumsum(counts)])]
            for i in np.flatnonzero((np.diff(met) > 0) & ~odd).tolist():
                out[i] = self.by_library(column[i].as_py())
        at = np.flatnonzero(odd).tolist()
        for i, packed in zip(at, self.encode([column[i].as_py() for i in at])):
            out[i] = packed
        if len(self.memo) > KEPT:
            self.trim()
        return out

    def numbered(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``runs`` of distinct pieces, and the places of those that have no ids of their own."""
        names, numbers = pieces.to_numpy(zero_copy_only=False).tolist(), self.numbers
        which = np.fromiter(map(numbers.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(which < 0)
        if len(numbers) + len(new) > KEPT:  # only the pieces of this batch stay
            old = np.flatnonzero(which >= 0)
            self.runs = self.runs.take(which[old])
            which[old] = np.arange(len(old))
            self.numbers = numbers = {names[i]: k for k, i in enumerate(old.tolist())}
        which[new] = len(numbers) + np.arange(len(new))
        if len(new):
            self.runs += self.learned(pieces.take(pa.array(new)))
            numbers.update(zip(map(names.__getitem__, new.tolist()), which[new].tolist()))
        return which, which[self.runs.sizes[which] == 0]

    def learned(self, pieces: pa.StringArray) -> Runs:
        """Ids of distinct pieces with their white space; none for one after which white space goes on."""
        vocabulary = self.vocabulary
        parts = pc.extract_regex(pieces, PLAIN)
        plain = parts.is_valid().to_numpy(zero_copy_only=False) & (pc.binary_length(pieces).to_numpy() <= LONG_PIECE)
        feed, word, marks = (f.filter(pa.array(plain)) for f in parts.flatten())
        word, marks = word.dictionary_encode(), marks.dictionary_encode()
        data, ends = string_bytes(word.dictionary)
        tails = ["", "\n", *marks.dictionary.to_pylist()]
        known = Runs.packed(vocabulary.encode_pieces(tails)) + Runs(*vocabulary.merge_bytes(data, np.diff(ends)))
        three = np.empty((int(plain.sum()), 3), np.int64)
        three[:, 0] = pc.binary_length(feed).to_numpy()
        three[:, 1] = word.indices.to_numpy() + len(tails)
        three[:, 2] = marks.indices.to_numpy() + 2
        runs = known.take(three.ravel()).joined(np.full(len(three), 3))
        if plain.all():
            return runs
        others = pieces.filter(pa.array(~plain)).to_pylist()
        packed: list[bytes] = [b""] * len(others)
        for i, p in enumerate(others):
            if len(p) > LONG_PIECE and not self.goes_on(p):
                packed[i] = self.by_library(p)
        short = [i for i, p in enumerate(others) if len(p) <= LONG_PIECE and not self.goes_on(p)]
        for i, ids in zip(short, vocabulary.encode_pieces([others[i] for i in short])):
            packed[i] = ids
        place = np.where(plain, np.cumsum(plain) - 1, len(three) + np.cumsum(~plain) - 1)
        return (runs + Runs.packed(packed)).take(place)

    @staticmethod
    def goes_on(piece: str) -> bool:
        """White space goes on after the cut."""
        return piece[-1].isspace() and piece[-1] not in " \n"

    def joined(self, text: str, pieces: list[str]) -> bytes:
        try:
            return b"".join(map(self.memo.__getitem__, pieces))
        except TypeError:  # a piece has no ids of its own
            return self.by_library(text)


_encoders: dict[tuple[str, int], Encoder] = {}


def shared_encoder(path: str, lexicon: bytes | None = None) -> Encoder:
    """The encoder of this process, which so keeps what earlier tasks have learnt; one at a time."""
    key = (path, hash(lexicon))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(path, None if lexicon is None else Lexicon.mapped(lexicon))
    return _encoders[key]


def forget_encoders() -> None:
    """For tasks that come after all encoding: they run in the same processes."""
    _encoders.clear()
    release_memory()


def frequent_pieces(docs: DataFrame, size: int) -> list[str]:
    """The most frequent pieces of all texts, counted over all of them: whole classes of counts, ``size`` pieces at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["piece", "n"])

        for batch in rows(batches):
            for text in batch.column("text").to_pylist():
                if text and "\0" not in text:
                    counts.update(Encoder.cut(text))
            if len(counts) > MEMO:
                yield out()
                counts.clear()
        if counts:
            yield out()

    counted = texts(docs).select("text").mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    # eight steps for each doubling of the count: at most a few hundred classes, of which the upper ones fit
    kind = F.floor(F.log2("n") * 8).cast("int")
    fit = (F.length("piece") > 0) & (F.length("piece") <= 64) & (F.col("n") > 1)
    counted = stage(counted.where(fit).withColumn("kind", kind), "piece-counts").df
    classes = counted.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("kind")).collect()
    least, total = None, 0
    for r in classes:
        total += r["n"]
        if total > size:
            break
        least = r["kind"]
    return [] if least is None else [r["piece"] for r in counted.where(F.col("kind") >= least).select("piece").collect()]


def build_lexicon(docs: DataFrame, path: str, size: int) -> bytes:
    """Automaton of the most frequent pieces; at most ``size`` of up to 64 characters, so it has a bounded size."""
    vocabulary = Vocabulary(path)
    pieces = sorted({spelled(p) for p in frequent_pieces(docs, size)}, key=str.encode)
    return Lexicon.compile([(p.encode(), ids) for p, ids in zip(pieces, vocabulary.encode_pieces(pieces))])


def encode_decode(docs: DataFrame, path: str, lexicon_size: int = 50_000, with_ids: bool = False) -> DataFrame:
    """Per row of ``docs`` the number of ids and digests of the ids and of the decoded text; with ``with_ids`` also the packed
    ids and the text itself."""
    lexicon = docs.sparkSession.sparkContext.broadcast(build_lexicon(docs, path, lexicon_size))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(path, lexicon.value)
        tokens = encoder.vocabulary.tokens
        shown = [f"{i}," for i in range(len(tokens))]
        for batch in rows(batches):
            out = []
            for packed in encoder.encode(batch.column("text").to_pylist()):
                ids = np.frombuffer(packed, "<u4").tolist()
                decimal = "".join(map(shown.__getitem__, ids))[:-1].encode()
                text = b"".join(map(tokens.__getitem__, ids)).decode("utf-8", "replace")
                digests = hashlib.sha256(decimal).hexdigest(), hashlib.sha256(text.encode()).hexdigest()
                out.append((len(ids), *digests, *((packed, text) if with_ids else ())))
            columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names[: 1 + len(columns)])

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]
    more = ", ids binary, decoded string" if with_ids else ""
    return texts(docs).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
