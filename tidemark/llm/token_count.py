"""Operator 8: token counts by a compiled finite-state tokenizer.

Byte-level BPE of one pre-token is a finite-state function: the encoding of a prefix ends
in one token, that token and the encoding of what precedes it determine the whole, and
which token it is depends on the last tokens at the few positions from where the text so
far could still grow into a vocabulary entry.  These positions, the tokens that end at
them and their counts relative to the present one are a state.  A transition on a byte
carries the change of the token count; the count of a string is the sum along its path.

States and transitions are compiled when text first needs them, and as many are kept as
a bound allows.  Pre-tokens reset the transducer, so each is a chunk with a constant map:
a count, which is remembered by the chunk's bytes (again up to a bound), and the counts of
a text compose by a running (prefix) sum over the batch.  A longer pre-token is cut into
chunks, whose maps from entry states to exit states and counts are composed pair by pair,
as a parallel prefix scan does.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import LONG_SPAN, kept, release, slices, span_hashes, span_lanes, texts

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
MAX_STATES = 100_000
MAX_KNOWN = 500_000
CHUNK_BYTES = 1024
WARM_BYTES = 256
_START = 0


# The letters that byte-level vocabulary files write bytes with.
def _byte_letters() -> dict[str, int]:
    """The printable letters that byte-level vocabularies write bytes with: bytes that
    print stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """The automaton of a byte-level BPE vocabulary (a tokenizers file without dropout,
    prefixes, suffixes or byte fallback)."""

    def __init__(self, path: str, max_states: int = MAX_STATES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec["pre_tokenizer"].get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("not a plain byte-level BPE tokenizer")
        # Strings of added tokens are cut out of texts by the library, each one token.
        self.added = [t["content"].encode() for t in spec.get("added_tokens", [])]
        letters = _byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.ids = {as_bytes(s): i for s, i in model["vocab"].items() if all(c in letters for c in s)}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {(as_bytes(a), as_bytes(b)): r for r, (a, b) in enumerate(pairs)}
        self.children: list[dict[int, int]] = [{}]
        self.token: list[bytes | None] = [None]
        for entry in self.ids:
            node = 0
            for byte in entry:
                nxt = self.children[node].get(byte)
                if nxt is None:
                    nxt = self.children[node][byte] = len(self.children)
                    self.children.append({})
                    self.token.append(None)
                node = nxt
            self.token[node] = entry
        self.follows: dict[tuple, bool] = {}
        self.max_states = max_states
        self.known: dict[bytes, int] = {}
        self.clear()

    def clear(self) -> None:
        self.states: list[tuple] = [((0, None, 0),)]
        self.numbers: dict[tuple, int] = {self.states[0]: _START}
        self.moves: dict[int, int] = {}

    def encode(self, text: bytes) -> list[bytes]:
        """Merges by rank, leftmost first; for short strings only."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _may_follow(self, last: bytes | None, token: bytes) -> bool:
        key = (last, token)
        known = self.follows.get(key)
        if known is None:
            if len(self.follows) > 1_000_000:
                self.follows.clear()
            whole = [token] if last is None else [last, token]
            known = self.follows[key] = self.encode(b"".join(whole)) == whole
        return known

    def step(self, state: tuple, byte: int) -> tuple[tuple, int]:
        """The state after ``byte`` and by how much the token count grows.

        A state lists (trie node of the open suffix, token that ends before it, token count
        there less the count here)."""
        ahead, last, gain = [], None, 0
        for node, before, count in state:
            child = self.children[node].get(byte)
            if child is None:
                continue
            token = self.token[child]
            if token is not None and last is None and self._may_follow(before, token):
                last, gain = token, count + 1
            if self.children[child]:
                ahead.append((child, before, count))
        if last is None:
            raise ValueError("the vocabulary lacks a byte")
        return tuple((n, b, c - gain) for n, b, c in ahead) + ((0, last, 0),), gain

    def _compile(self, place: int) -> int:
        """The transition at ``place`` (state and byte in one number), as next state and
        gain in one number."""
        state, gain = self.step(self.states[place >> 8], place & 255)
        number = self.numbers.get(state)
        if number is None:
            number = self.numbers[state] = len(self.states)
            self.states.append(state)
        self.moves[place] = move = number << 16 | gain + 32768
        return move

    def run(self, text: bytes, state: int = _START) -> tuple[int, int]:
        """The map of a chunk at one state: the state it ends in, the tokens gained."""
        moves, total = self.moves, 0
        for byte in text:
            place = state << 8 | byte
            move = moves.get(place)
            if move is None:
                move = self._compile(place)
            state = move >> 16
            total += (move & 65535) - 32768
        return state, total

    def count_long(self, text: bytes) -> int:
        """Tokens of one long pre-token: the maps of its chunks, composed pair by pair.

        A chunk's map is a partial function from entry states to (exit state, tokens
        gained).  It is known at first at the state that the bytes before the chunk lead
        to from the start; where a composition meets another state, the map is taken there
        as well.  Composition is associative, so the levels of the tree are those of a
        parallel prefix scan."""
        chunks = [text[i : i + CHUNK_BYTES] for i in range(0, len(text), CHUNK_BYTES)]
        entry = [_START] + [self.run(c[-WARM_BYTES:])[0] for c in chunks[:-1]]
        level = [_Map(self, c, e) for c, e in zip(chunks, entry, strict=True)]
        while len(level) > 1:
            pairs = [_Composed(x, y) for x, y in zip(level[::2], level[1::2], strict=False)]
            level = pairs + level[2 * len(pairs) :]
        return level[0].at(_START)[1]

    def _count(self, text: bytes) -> int:
        n = self.count_long(text) if len(text) > 2 * CHUNK_BYTES else self.run(text)[1]
        if len(self.states) > self.max_states:
            self.clear()
        return n

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token.  One of LONG_SPAN bytes or less whose count is
        remembered, by its bytes, is not run again; longer ones always are.

        Equal short pre-tokens are brought together by hash, and only where all their bytes
        agree."""
        sizes = ends - starts
        out = np.zeros(len(starts), dtype=np.int64)
        raw = data.tobytes()
        alone = sizes > LONG_SPAN
        short = np.flatnonzero(~alone)
        if len(short):
            begin, size = starts[short], sizes[short]
            distinct, first, each = np.unique(span_hashes(data, begin, ends[short], fold=False), return_index=True, return_inverse=True)
            padded = np.concatenate([data, np.zeros(LONG_SPAN, np.uint8)])
            same = size == size[first][each]
            for lane in range(LONG_SPAN // 8):
                have = np.flatnonzero(same & (size > 8 * lane))
                if not len(have):
                    break
                model = first[each[have]]
                same[have] = span_lanes(padded, begin[have], size[have], lane) == span_lanes(padded, begin[model], size[model], lane)
            alone[short[~same]] = True
            found = np.zeros(len(distinct), dtype=np.int64)
            known = self.known
            for i, (a, n) in enumerate(zip(begin[first].tolist(), size[first].tolist(), strict=True)):
                text = raw[a : a + n]
                count = known.get(text)
                if count is None:
                    if len(known) >= MAX_KNOWN:
                        known.clear()
                    count = known[text] = self._count(text)
                found[i] = count
            out[short] = found[each]
        for i in np.flatnonzero(alone).tolist():
            out[i] = self._count(raw[int(starts[i]) : int(ends[i])])
        return out


class _Map:
    """The map of one chunk, taken at the states where it is asked for."""

    def __init__(self, machine: Transducer, chunk: bytes, entry: int):
        self.machine, self.chunk, self.known = machine, chunk, {}
        self.at(entry)

    def at(self, state: int) -> tuple[int, int]:
        if state not in self.known:
            self.known[state] = self.machine.run(self.chunk, state)
        return self.known[state]


class _Composed:
    """First the left map, then the right one."""

    def __init__(self, left: _Map | _Composed, right: _Map | _Composed):
        self.left, self.right = left, right
        self.known = {}
        for state in left.known:
            self.at(state)

    def at(self, state: int) -> tuple[int, int]:
        if state not in self.known:
            middle, gained = self.left.at(state)
            end, more = self.right.at(middle)
            self.known[state] = (end, gained + more)
        return self.known[state]


# --- pre-tokens ----------------------------------------------------------------------
_LETTER, _DIGIT, _BLANK = 1, 2, 3
_CLASSES: list[np.ndarray] = []
# White space, and the endings that the pattern keeps with their apostrophe.
_WHITE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def _classes() -> np.ndarray:
    """Class of each code point: letter, digit, white space or 0."""
    if not _CLASSES:
        table = np.zeros(0x110000, dtype=np.uint8)
        major = {"L": _LETTER, "N": _DIGIT}
        table[:] = [major.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)]
        table[list(_WHITE)] = _BLANK
        _CLASSES.append(table)
    return _CLASSES[0]


def pre_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts (bytes) of the matches of the byte-level pattern in all texts, and how many
    each text has.

    The pattern is a finite-state rule over character classes: runs of letters, of digits
    and of other characters, each with one space before it; white space apart from its
    last character where something follows; an apostrophe with a common ending.
    """
    points = np.frombuffer(data.tobytes().decode("utf-8", errors="replace").encode("utf-32-le", errors="surrogatepass"), dtype=np.uint32)
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    where = np.cumsum(width) - width
    kind = _classes()[points]
    n = len(points)
    first = np.zeros(n + 1, dtype=bool)
    text_at = np.searchsorted(where, offsets)  # each text's first character
    first[text_at] = True
    first[n] = True
    first = first[: n + 1]
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    before = np.concatenate([[0], kind[:-1]])
    point_before = np.concatenate([[0], points[:-1]])
    after = np.concatenate([kind[1:], [0]])
    last = first[1:]
    blank, blank_before = kind == _BLANK, before == _BLANK
    start = np.where(
        blank, np.where(blank_before, ~last & (after != _BLANK), True), np.where(blank_before, point_before != 32, kind != before)
    )
    start |= first[:n]
    mark = np.flatnonzero(points == 39)
    if len(mark):
        open_ = first[mark] | (before[mark] == _LETTER) | (before[mark] == _DIGIT) | ((before[mark] == _BLANK) & (point_before[mark] != 32))
        mark = mark[open_]
        padded = np.concatenate([points, np.zeros(3, np.uint32)])
        ends_text = np.concatenate([first, np.ones(3, dtype=bool)])
        for ending in _ENDINGS:
            k = len(ending)
            fits = np.ones(len(mark), dtype=bool)
            for j, c in enumerate(ending, 1):
                fits &= (padded[mark + j] == ord(c)) & ~ends_text[mark + j]
            hit = mark[fits]
            start[hit + 1] = False
            beyond = hit + k + 1
            beyond = beyond[(beyond < n)]
            start[beyond[(kind[beyond] == _LETTER)]] = True
    at = np.flatnonzero(start)
    return where[at], np.diff(np.searchsorted(at, text_at))


_MACHINES: dict[str, Transducer] = kept()


def count_batch(machine: Transducer, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Tokens of each text of a run (see ``common.slices``)."""
    added = np.zeros(len(offsets) - 1, dtype=np.int64)
    for mark in machine.added:
        if mark and mark in data.tobytes():
            return np.array([_count_with_added(machine, data[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], dtype=np.int64)
    starts, per_text = pre_tokens(data, offsets)
    total = np.concatenate([[0], np.cumsum(machine.counts(data, starts, np.append(starts[1:], len(data))))]) if len(starts) else np.zeros(1, np.int64)
    stops = np.cumsum(per_text)
    return total[stops] - total[stops - per_text] + added


def _count_with_added(machine: Transducer, text: bytes) -> int:
    """Strings of added tokens (longest first where several begin) are a token each."""
    for mark in sorted(machine.added, key=len, reverse=True):
        if mark in text:
            parts = text.split(mark)
            return sum(_count_with_added(machine, p) for p in parts) + len(parts) - 1
    if not text:
        return 0
    return int(count_batch(machine, np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0])


def _counter(path: str, limit: int):
    def run(batches):
        machine = _MACHINES.get(path)
        if machine is None:
            machine = _MACHINES[path] = Transducer(path)
        for ids, nulls, offsets, data in slices(batches):
            n = count_batch(machine, data, offsets)
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=nulls), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])
        release()

    return run


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit of every whole text, as the tokenizers
    library counts them with the byte-level BPE file at ``path`` (a path on every
    executor), without begin and end tokens; strings of added tokens inside a text are
    single tokens, the library's default.

    One pass without a shuffle.  A text is counted whole, however long.  Null or empty text: no bytes, no tokens.  Null or
    repeated doc_id: the row is counted like any other.  Empty table: no rows.  Other
    columns are not read.
    """
    return texts(docs, id_col, text_col).mapInArrow(_counter(path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(TOKENIZER)).select("doc_id", "n_bytes", "n_tokens", F.coalesce("over_limit", F.lit(False)).alias("over_limit"))
