"""Token counts by a compiled finite-state tokenizer.

A byte-level BPE tokenizer is turned into two deterministic transducers.

* The first reads character classes and marks where a pre-token begins. Its memory is four
  classes back and two ahead, so that it runs as array operations over whole batches.
* The second reads the bytes of a pre-token. The tokens of a prefix of a pre-token are fixed by the
  last token at each place from which a vocabulary entry may still reach on; that, as far as the
  longest suffix that begins some entry, is its state. Each transition carries how many tokens more
  (or fewer) the longer prefix has. A pre-token's count is the sum over its transitions. States and
  transitions are compiled when first met and kept in a dense table.

Texts are cut into chunks that are run side by side. A chunk's state map is constant behind its first
pre-token boundary; before it the map has a row for each state that may enter: the state at the end and the tokens.
Few do, since the transducer soon forgets. The maps are composed by a parallel prefix scan over the chunks, so a
pre-token of any length takes few rounds. The counts are exactly the library's.

Nulls count as empty (no tokens). Special strings inside texts are one token each, as by the library's
default. Repeated rows each get their count; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh
from .words import buffers, pieces

LETTER, NUMBER, OTHER, BLANK, SPACE, EDGE, UNKNOWN = range(7)
_WHITE = np.isin(np.arange(7), (BLANK, SPACE))
CHUNK = 192
#: A place's history is kept as the entries that may still come, if these are so few.
FEW = 24
#: Compiled states kept at most between batches; beyond that the table is compiled anew.
MOST_STATES = 250_000
#: Rows of a chunk's state map that are made ahead; states that surely enter are added beyond that.
MOST_ENTERING = 48


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Byte pair encoding of single pre-tokens, by the merge list."""

    def __init__(self, model: dict):
        letters = _byte_letters()
        spell = {t: bytes(letters[c] for c in t) for t in model["vocab"] if all(c in letters for c in t)}
        self.vocab = set(spell.values())
        self.longer: dict[bytes, list[bytes]] = {}  # the entries that begin with these bytes, and are longer
        for t in sorted(self.vocab, key=len):
            for n in range(1, len(t)):
                self.longer.setdefault(t[:n], []).append(t)
        self.rank = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[spell[a], spell[b]] = r
        self.edges: dict[bytes, tuple | None] = {}
        self.reaches: dict[tuple[bytes | None, bytes], bytes | tuple | None] = {}

    def merged(self, word: bytes) -> tuple[list[bytes], list[tuple[bytes, bytes, int]]]:
        """The tokens of a pre-token, and the merges that made them."""
        parts, made = [word[i : i + 1] for i in range(len(word))], []
        while len(parts) > 1:
            rank, at = min((self.rank.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            made.append((parts[at], parts[at + 1], rank))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, made

    def edge(self, token: bytes) -> tuple | None:
        """What stands at a token's left and right end while it is put together, each with the rank of the merge
        that takes it up; None if its bytes aren't encoded as this token."""
        if token not in self.edges:
            parts, made = self.merged(token)
            found = None
            if parts == [token]:
                last = 1 << 60
                left, right = [(token, last)], [(token, last)]
                for a, b, rank in reversed(made):
                    if a + b == left[-1][0]:
                        left.append((a, rank))
                    if a + b == right[-1][0]:
                        right.append((b, rank))
                found = (left, right)
            self.edges[token] = found
        return self.edges[token]

    def follows(self, a: bytes | None, b: bytes) -> bool:
        """Whether b is a token that may stand right behind a (None: at the beginning).

        It may, unless a merge over the border between them comes before the merges that take up its
        two parts; of equal ranks the left one comes first.
        """
        if (edge := self.edge(b)) is None or a is None:
            return edge is not None
        right, left, rank = self.edge(a)[1], edge[0], self.rank
        for x, i in right:
            for y, j in left:
                if (r := rank.get((x, y))) is not None and r < i and r <= j:
                    return False
        return True

    def reach(self, a: bytes | tuple | None, begun: bytes) -> bytes | tuple | None:
        """What may stand right behind a and reaches beyond these bytes, which begin it.

        As far as there may be any: the entries themselves if they are few, else a. Given entries are narrowed.
        """
        if isinstance(a, tuple):
            return tuple(t for t in a if t.startswith(begun) and len(t) > len(begun))
        if (known := self.reaches.get((a, begun), 0)) == 0:
            longer = self.longer.get(begun, ())
            if len(longer) <= FEW:
                known = tuple(t for t in longer if self.follows(a, t))
            else:
                known = a if any(self.follows(a, t) for t in longer) else ()
            self.reaches[a, begun] = known
        return known


class Transducer:
    """The second transducer, compiled on demand. State 0 stands at the beginning of a pre-token."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.reset()

    def reset(self) -> None:
        self.symbol = np.full(256, -1, np.int32)
        self.width, self.used = 128, 0
        self.table = np.full((4096, self.width), -1, np.int32)  # 16 * the next state + 8 + the tokens emitted
        start = (b"", ((0, None, 0),))
        self.states, self.ids = [start], {start: 0}
        self.letters: list[int] = []

    def symbols(self, data: np.ndarray) -> np.ndarray:
        """The bytes as columns of the table; new ones get a column."""
        for b in np.flatnonzero(np.bincount(data, minlength=256) * (self.symbol < 0)):
            self.symbol[b] = self.used
            self.letters.append(int(b))
            self.used += 1
        if self.used > self.width:
            self.table = np.pad(self.table, ((0, 0), (0, self.width)), constant_values=-1)
            self.width *= 2
        return self.symbol[data]

    def compile(self, key: int) -> None:
        state, symbol = divmod(key, self.width)
        byte = bytes([self.letters[symbol]])
        suffix, history = self.states[state]
        last, emitted = None, 0
        ahead = []
        for length, token, behind in history:  # history goes from the longest suffix to the empty one
            grown = suffix[len(suffix) - length :] + byte
            if last is None and (grown in token if isinstance(token, tuple) else grown in self.merges.vocab and self.merges.follows(token, grown)):
                last, emitted = grown, behind + 1
            if (token := self.merges.reach(token, grown)) != ():
                ahead.append((length + 1, token, behind))
        if last is None:
            raise ValueError(f"the vocabulary has no token for byte {byte!r}")
        history = (*((n, token, behind - emitted) for n, token, behind in ahead), (0, last, 0))
        reach = history[0][0]
        grown = (suffix + byte)[len(suffix) + 1 - reach :]
        new = (grown, history)
        if (i := self.ids.get(new)) is None:
            i = self.ids[new] = len(self.states)
            self.states.append(new)
            if i >= len(self.table):
                self.table = np.concatenate([self.table, np.full((len(self.table) // 2, self.width), -1, np.int32)])
        if not -8 <= emitted < 8:
            raise ValueError("a transition emits more tokens than the table can hold")
        self.table[state, symbol] = 16 * i + 8 + emitted

    def run(self, symbols: np.ndarray, starts: np.ndarray, stops: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Run all spans side by side from their states: states at the ends, tokens emitted. symbols: ~symbol where a pre-token begins."""
        order = np.argsort(starts - stops, kind="stable")  # the longest first, so that those still running are a prefix
        at, lengths, state = starts[order], (stops - starts)[order], state[order].astype(np.int32)
        total = np.zeros(len(at), np.int32)
        running = len(at) - np.searchsorted(lengths[::-1], np.arange(lengths[0] if len(lengths) else 0), "right")
        shift, flat = self.width.bit_length() - 1, self.table.reshape(-1)
        for step, n in enumerate(running):
            symbol = symbols[at[:n] + step]
            key = np.where(symbol < 0, ~symbol, (state[:n] << shift) + symbol)
            new = flat[key]
            if new.min() < 0:
                for k in np.unique(key[new < 0]):
                    self.compile(int(k))
                flat = self.table.reshape(-1)
                new = flat[key]
            total[:n] += (new & 15) - 8
            state[:n] = new >> 4
        end, out = np.empty_like(state), np.empty_like(total)
        end[order], out[order] = state, total
        return end, out


class Tokenizer:
    """Counts of one tokenizer file (byte-level BPE with the usual contractions pattern)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Library

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec.get("normalizer"):
            raise ValueError("only plain byte-level BPE files can be compiled")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.transducer = Transducer(Merges(spec["model"]))
        self.split = Library.from_file(path).pre_tokenizer.pre_tokenize_str
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)
        self.classes[0x20] = BLANK

    def _classes(self, code: np.ndarray) -> np.ndarray:
        """Character classes; a character not met before is put to the library's own pattern."""
        got = self.classes[code]
        if (got == UNKNOWN).any():
            for c in np.unique(code[got == UNKNOWN]):
                joins = [k for k, before in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(self.split(before + chr(c))) == 1]
                self.classes[c] = joins[0] if joins else SPACE
            got = self.classes[code]
        return got

    def boundaries(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether a pre-token begins at each byte."""
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        kind, n = self._classes(code), len(code)
        opens = np.zeros(n + 1, bool)
        opens[np.searchsorted(lead, offsets)] = True
        opens[n] = True
        before = np.concatenate([[EDGE], kind[:-1]]).astype(np.uint8)
        before[opens[:n]] = EDGE
        after = np.concatenate([kind[1:], [EDGE]]).astype(np.uint8)
        after[opens[1:]] = EDGE
        blank, was_blank = _WHITE[kind], _WHITE[before]
        # Of a run of white space the last character stands alone or goes to the word behind it.
        ends_run = after < BLANK
        begins = (blank & (~was_blank | ends_run)) | (~blank & (before != kind) & (before != BLANK))
        tick = np.flatnonzero((code == 0x27) & begins)
        if len(tick):
            padded = np.concatenate([code, [0, 0, 0]])
            one = np.where(opens[tick + 1], 0, padded[tick + 1])
            two = np.where((one == 0) | opens[np.minimum(tick + 2, n)], 0, padded[tick + 2])
            # The contractions 's 't 'm 'd and 're 've 'll.
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            short = np.isin(one, [ord(c) for c in "stmd"])
            for found, length in ((tick[short], 2), (tick[long], 3)):
                begins[found + 1] = False
                behind = found + length
                begins[behind[behind < n]] = True
        begins |= opens[:n]
        fresh = np.zeros(len(data), bool)
        fresh[lead[begins]] = True
        return fresh

    def _heads(self, symbols: np.ndarray, starts: np.ndarray, head: np.ndarray, stops: np.ndarray, state: np.ndarray) -> np.ndarray:
        """Tokens of each chunk's head, the part before its first boundary. state: at the chunk's end if it has a boundary.

        The map of a head is a row for each state that may enter it: the state at its end and the tokens. Maps of chunks
        without a boundary are made side by side, first from the state that the chunk before ends in when begun afresh; a
        state that a map may hand on and the next map lacks is added to that one, until a path leads through every
        head. A chain of maps is then composed by doubling.
        """
        out = np.zeros(len(starts), np.int64)
        wait = np.flatnonzero(head > starts)
        if not len(wait):
            return out
        known, open_ = head < stops, head == stops  # open: the state at the end depends on the one that enters
        chunk, enters = wait, state[wait - 1].astype(np.int64)
        guess = np.flatnonzero(~known[wait - 1])
        if len(guess):
            before = wait[guess] - 1
            enters[guess] = self.transducer.run(symbols, starts[before], head[before], np.zeros(len(guess), np.int64))[0]
        width = np.int64(1) << 32
        keys = leaves = counts = np.empty(0, np.int64)  # rows of all maps, by chunk and entering state
        new = np.unique(chunk * width + enters)
        while True:
            at, enters = new // width, new % width
            end, more = self.transducer.run(symbols, starts[at], head[at], enters)
            keys, leaves, counts = np.concatenate([keys, new]), np.concatenate([leaves, end.astype(np.int64)]), np.concatenate([counts, more.astype(np.int64)])
            order = np.argsort(keys)
            keys, leaves, counts = keys[order], leaves[order], counts[order]
            owner = keys // width
            follows = open_[owner] & (owner + 1 < len(starts)) & (head[np.minimum(owner + 1, len(starts) - 1)] > starts[np.minimum(owner + 1, len(starts) - 1)])
            handed = np.where(follows, (owner + 1) * width + leaves, -1)
            place = np.minimum(np.searchsorted(keys, handed), len(keys) - 1)
            found = follows & (keys[place] == handed)
            reached = self._reached(keys, np.where(found, place, -1), state, known)
            if reached.sum() == len(wait):  # one row of each map
                np.add.at(out, owner[reached], counts[reached])
                return out
            missing = follows & ~found
            per = np.bincount(owner, minlength=len(starts))
            missing &= reached | (per[np.minimum(owner + 1, len(starts) - 1)] < MOST_ENTERING)  # a state that surely enters is always added
            new = np.unique(handed[missing])

    @staticmethod
    def _reached(keys: np.ndarray, onward: np.ndarray, state: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Which rows lie on the paths from known states: onward has each row's next row (-1: none), and paths are followed by doubling."""
        width = np.int64(1) << 32
        owner = keys // width
        reached = known[owner - 1] & (state[owner - 1] == keys % width)
        jump = onward.copy()
        while (live := jump >= 0).any():
            reached[jump[live & reached]] = True
            jump = np.where(live, jump[np.maximum(jump, 0)], -1)
        return reached

    def _count(self, texts: pa.Array) -> np.ndarray:
        data, offsets = buffers(texts)
        if not len(data):
            return np.zeros(len(texts), np.int64)
        fst = self.transducer
        if len(fst.states) > MOST_STATES:
            fst.reset()
        symbols, fresh = fst.symbols(data), self.boundaries(data, offsets)
        np.invert(symbols, out=symbols, where=fresh)
        sizes = np.diff(offsets)
        chunks = -(-sizes // CHUNK)
        doc = np.repeat(np.arange(len(sizes)), chunks)
        starts = offsets[doc] + CHUNK * (np.arange(len(doc)) - np.repeat(np.cumsum(chunks) - chunks, chunks))
        stops = np.minimum(starts + CHUNK, offsets[doc + 1])
        edges = np.concatenate([np.flatnonzero(fresh), [len(data)]])
        head = np.minimum(edges[np.searchsorted(edges, starts)], stops)  # from here on a chunk's map is constant
        state, count = fst.run(symbols, head, stops, np.zeros(len(starts), np.int64))
        count += self._heads(symbols, starts, head, stops, state)
        return np.bincount(doc, count, len(sizes)).astype(np.int64)

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        for a, b in pieces(texts):
            part = texts.slice(a, b - a)
            rows = np.arange(a, b)
            for mark in self.special:
                if pc.any(pc.match_substring(part, mark)).as_py():
                    split = [(r, s) for r, t in zip(rows, part.to_pylist(), strict=True) for s in (t or "").split(mark)]
                    rows = np.array([r for r, _ in split])
                    part = pa.array([s for _, s in split], pa.large_string())
                    np.add.at(out, rows[1:], rows[1:] == rows[:-1])  # the marks between parts of one row
            np.add.at(out, rows, self._count(part))
        return out


_TOKENIZERS: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """The worker's tokenizer of that file; compiled states stay between tasks."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Tokenizer(path)
    return _TOKENIZERS[path]


def count_tokens(df: DataFrame, path: str, text: str = "text", into: str = "n_tokens", keep: list[str] | None = None) -> DataFrame:
    """df (or its columns keep, which need not hold the text) with the number of tokens of each text.

    path: the tokenizer file's place, the same on every machine. A column that is already called as
    the result raises ValueError.
    """
    keep = df.columns if keep is None else keep
    fresh(keep, into)
    inner = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)), F.col(f"`{text}`").cast("string").alias("t"))
    names = [f"c{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = tokenizer(path)
        for batch in batches:
            got = pa.array(counter.count(batch.column("t")), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), got], [*names, "n"])

    schema = inner.select(*names).schema.add("n", "long")
    return inner.mapInArrow(run, schema).toDF(*keep, into)
