"""Token counts from a compiled tokenizer: a deterministic transducer over bytes.

*Compilation.* Byte-pair merges have one encoding of a word in which every two neighbours are
also the encoding of their own two strings. So a machine may guess where tokens end and drop
guesses whose neighbours do not fit: it is unambiguous. Its subsets, each guess with the
difference of its count, are the states of a deterministic transducer whose transitions carry
the number of tokens emitted (sometimes below 0, where a longer token takes up earlier ones).
The pattern that splits text into words (runs of letters, single numbers, runs of other
signs, contractions) is part of the same machine. It is built lazily, as texts need it, and
forgotten when it holds ``MOST_STATES``: that changes the time, never a count.

*Scan.* The texts of a batch are one row of bytes, cut into chunks. White space leads every
state to the start state, so the state map of a chunk with white space in it is constant after
that place: what follows is counted at once, for all chunks in step. The maps are then
composed from left to right: a chunk's entry state is the exit state of the one before, and
the chunk's head is counted from there, for all chunks whose entry is known at the same time.
Only a word longer than whole chunks hands its state on chunk by chunk. The emitted
counts are summed per text.

Defined results: null text is empty text with no token; an empty table gives an empty result;
repeated ids and rows are counted each for itself; further columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioline.session import ship_package, spread

#: Bytes of text that are counted in step; one longer text is a piece of its own.
PIECE_BYTES = 1 << 21
CHUNK = 1024
#: States that a task's machine may hold before it starts anew.
MOST_STATES = 200_000

# The pattern of words that the machine stands for, and its contractions.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")

#: Classes of characters; and bytes that UTF-8 never has: an added token, the end of a text.
_LETTER, _NUMBER, _SIGN, _SPACE = range(4)
_ADDED, _END = 0xFF, 0xFE
#: What the machine is in: white space, letters, signs, a word that ended, an apostrophe that began
#: a word. A letter instead of a mode: that letter after the apostrophe, maybe a contraction.
_START, _LETTERS, _SIGNS, _DONE, _APOSTROPHE = range(5)
_FINAL = 256


def _byte_letters() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Byte-pair merges over bytes; the last byte of a word is a symbol of its own (256 + byte)."""

    def __init__(self, model: dict):
        suffix, byte_of = model["end_of_word_suffix"], _byte_letters()
        vocabulary = model["vocab"]
        self.symbols: dict[int, tuple[int, ...]] = {}
        self.single: dict[int, int] = {}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        made = {a + b for a, b in model["merges"]}
        for text, token in vocabulary.items():
            if text not in made:
                final = len(text) > 1 and text.endswith(suffix)
                symbol = byte_of[text.removesuffix(suffix) if final else text] + _FINAL * final
                self.symbols[token], self.single[symbol] = (symbol,), token
        for rank, (a, b) in enumerate(model["merges"]):
            left, right, token = vocabulary[a], vocabulary[b], vocabulary[a + b]
            self.symbols[token] = self.symbols[left] + self.symbols[right]
            self.rank.setdefault((left, right), (rank, token))
        if len(self.single) != 2 * _FINAL:
            raise ValueError("the vocabulary lacks single bytes")
        # Where a token's symbols lead: child[node * 512 + symbol], and the token that ends there.
        self.child: dict[int, int] = {}
        self.token_at: dict[int, int] = {}
        self.inner: set[int] = set()
        for token, symbols in self.symbols.items():
            node = 0
            for symbol in symbols:
                self.inner.add(node)
                node = self.child.setdefault(node * 2 * _FINAL + symbol, len(self.child) + 1)
            self.token_at[node] = token
        self.fitting: dict[tuple[int | None, int], bool] = {}

    def encode(self, symbols: tuple[int, ...]) -> list[int]:
        """Merge the pair of lowest rank, the leftmost first, until none is left."""
        tokens = [self.single[s] for s in symbols]
        while len(tokens) > 1:
            found = [(self.rank[p], i) for i, p in enumerate(zip(tokens, tokens[1:], strict=False)) if p in self.rank]
            if not found:
                break
            (_, token), i = min(found)
            tokens[i : i + 2] = [token]
        return tokens

    def fits(self, before: int | None, token: int) -> bool:
        """Whether ``token`` can follow ``before`` (or begin a word) in an encoding."""
        known = self.fitting.get((before, token))
        if known is None:
            if len(self.fitting) > 1_000_000:
                self.fitting.clear()
            if before is None:
                known = self.encode(self.symbols[token]) == [token]
            else:
                known = self.encode(self.symbols[before] + self.symbols[token]) == [before, token]
            self.fitting[before, token] = known
        return known

    def count(self, word: str) -> int:
        data = word.encode()
        return len(self.encode((*data[:-1], data[-1] + _FINAL)))


class Machine:
    """The transducer: ``step`` adds one transition, ``counts`` runs texts through it.

    A state is (mode, guesses, end): a guess is (node of the token begun, token before it, its
    count less the count so far); ``end`` is what the count changes by if the word ends here.
    """

    def __init__(self, merges: Merges, most_states: int = MOST_STATES, chunk: int = CHUNK):
        self.merges, self.most, self.chunk = merges, most_states, chunk
        self.short = {w: merges.count(w) for w in CONTRACTIONS}
        self.after = {w[1] for w in CONTRACTIONS if len(w) == 3}
        self._forget()

    def _forget(self) -> None:
        self.states: list[tuple] = [(_START, (), 0)]
        self.number = {self.states[0]: 0}
        self.keys: list[int] = []
        self.column = np.full(6 * 256, -1, dtype=np.int32)
        self.width = 64
        self.next = np.full((1024, self.width), -1, dtype=np.int32)
        self.out = np.zeros((1024, self.width), dtype=np.int16)
        self.same: dict[tuple, tuple] = {}

    def _grown(self, byte: int, guesses: tuple) -> tuple[int, tuple, int]:
        """(change of the count, guesses, end) of a word that goes on with a byte."""
        child, token_at, inner, fits = self.merges.child, self.merges.token_at, self.merges.inner, self.merges.fits
        going, last, change, end = [], None, 0, None
        for node, before, less in guesses:
            follower = child.get(node * 512 + byte)
            if follower is not None:
                token = token_at.get(follower)
                if token is not None and last is None and fits(before, token):
                    last, change = token, less + 1
                if follower in inner:
                    going.append((follower, before, less))
            if end is None:
                token = token_at.get(child.get(node * 512 + 256 + byte))
                if token is not None and fits(before, token):
                    end = less + 1
        if last is None or end is None:
            raise RuntimeError("no encoding: the merges are not those of a byte-pair vocabulary")
        # Equal guesses of many states are kept once.
        same = self.same.setdefault
        guesses = [same(g, g) for g in ((n, b, less - change) for n, b, less in (*going, (0, last, change)))]
        return change, tuple(guesses), end - change

    def step(self, state: tuple, key: int) -> tuple[tuple, int]:
        """The state after a byte (of a class), and the tokens emitted."""
        mode, guesses, end = state
        kind, byte = divmod(key, 256)
        if byte >= _END or kind == _SPACE:
            return self.states[0], end + (byte == _ADDED)
        goes_on = byte & 0xC0 == 0x80
        letter = chr(byte) if byte < 128 else ""
        if isinstance(mode, str):
            whole = f"'{mode}{letter}"
            if whole in self.short:
                # Two tokens are out so far: the apostrophe, and the letter as a word begun.
                return (_DONE, (), 0), self.short[whole] - 2
            goes_on = goes_on or kind == _LETTER
            follow = _LETTERS
        elif mode == _APOSTROPHE:
            if f"'{letter}" in self.short:
                return (_DONE, (), 0), self.short[f"'{letter}"] - 1
            goes_on = goes_on or kind == _SIGN
            follow = _SIGNS
            if letter in self.after and letter:
                change, guesses, last = self._grown(byte, ((0, None, 0),))
                return (letter, guesses, last), end + change
        else:
            follow = mode
            goes_on = goes_on or (mode == _LETTERS and kind == _LETTER) or (mode == _SIGNS and kind == _SIGN)
        if goes_on:
            change, guesses, end = self._grown(byte, guesses)
            return (follow, guesses, end), change
        change, guesses, last = self._grown(byte, ((0, None, 0),))
        follow = _APOSTROPHE if letter == "'" else (_LETTERS, _DONE, _SIGNS)[kind]
        return (follow, guesses, last), end + change

    def _add(self, state: int, column: int) -> None:
        found, emitted = self.step(self.states[state], self.keys[column])
        number = self.number.get(found)
        if number is None:
            number = self.number[found] = len(self.states)
            self.states.append(found)
            if number == self.next.shape[0]:
                more = number // 4
                self.next = np.concatenate([self.next, np.full_like(self.next[:more], -1)])
                self.out = np.concatenate([self.out, np.zeros_like(self.out[:more])])
        self.next[state, column], self.out[state, column] = number, emitted

    def _columns(self, keys: np.ndarray) -> np.ndarray:
        found = self.column[keys]
        if (found < 0).any():
            for key in np.unique(keys[found < 0]).tolist():
                self.column[key] = len(self.keys)
                self.keys.append(key)
            while len(self.keys) > self.width:
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)], axis=1)
                self.out = np.concatenate([self.out, np.zeros_like(self.out)], axis=1)
                self.width *= 2
            found = self.column[keys]
        return found

    def _walk(self, columns: np.ndarray, state: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Run lanes (a column each) in step; the exit states. Emitted counts are added to ``out``."""
        for j in range(columns.shape[0]):
            column = columns[j]
            follow = self.next[state, column]
            missing = np.flatnonzero(follow < 0)
            if missing.size:
                for pair in {(int(state[i]), int(column[i])) for i in missing}:
                    self._add(*pair)
                follow = self.next[state, column]
            out[j] += self.out[state, column]
            state = follow
        return state

    def emitted(self, keys: np.ndarray) -> np.ndarray:
        """Tokens emitted at each of the bytes, which begin a word and end with white space."""
        if len(self.states) > self.most:
            self._forget()
        space = self._columns(np.array([_SPACE * 256 + 32]))[0]
        lanes = -(-keys.size // self.chunk)
        padded = np.full(lanes * self.chunk, _SPACE * 256 + 32, dtype=np.int16)
        padded[: keys.size] = keys
        columns = np.ascontiguousarray(self._columns(padded).reshape(lanes, self.chunk).T)
        # From its first white space on, a chunk's state map is constant.
        resets = (padded >= _SPACE * 256).reshape(lanes, self.chunk)
        settled = np.where(resets.any(axis=1), resets.argmax(axis=1), self.chunk)
        place = np.arange(self.chunk)[:, None]
        out = np.zeros(columns.shape, dtype=np.int32)
        exits = self._walk(np.where(place <= settled, space, columns), np.zeros(lanes, dtype=np.int32), out)
        # Composed: the head of each chunk, from the state in which the one before ends.
        heads = np.where(place <= settled, columns, space)
        entry = np.concatenate([[0], exits[:-1]]).astype(np.int32)
        ready = np.concatenate([[True], settled[:-1] < self.chunk])
        wave = np.flatnonzero(ready)
        while wave.size:
            most = int(min(settled[wave].max() + 1, self.chunk))
            part = np.zeros((most, wave.size), dtype=np.int32)
            exits[wave] = np.where(
                settled[wave] < self.chunk, exits[wave], self._walk(heads[:most, wave], entry[wave], part)
            )
            out[:most, wave] += part
            # A chunk without white space passes its state on to the next.
            open_ends = wave[(settled[wave] == self.chunk) & (wave + 1 < lanes)]
            entry[open_ends + 1] = exits[open_ends]
            wave = open_ends + 1
        return out.T.reshape(-1)[: keys.size]


class Tokenizer:
    """A tokenizer file compiled to a ``Machine``. The library's own parts normalise non-ASCII text
    and tell the classes of characters, so that both are those of its Unicode version."""

    def __init__(self, path: str, most_states: int = MOST_STATES, chunk: int = CHUNK):
        from tokenizers import Tokenizer as Library

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        split, by_bytes = spec["pre_tokenizer"]["pretokenizers"]
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        added = spec["added_tokens"]
        if (
            split["pattern"] != {"Regex": PATTERN}
            or (by_bytes["type"], by_bytes["use_regex"], by_bytes["add_prefix_space"]) != ("ByteLevel", False, False)
            or steps != ["NFC", "Replace", "Lowercase"]
            or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        ):
            raise ValueError(f"{path}: no word-end byte-pair tokenizer of the kind that is compiled here")
        library = Library.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        contents = sorted((regex.escape(t["content"]) for t in added), key=len, reverse=True)
        self.added = regex.compile("|".join(contents) or r"(?!)")
        self.machine = Machine(Merges(spec["model"]), most_states, chunk)
        self.kind = np.full(0x110000, 255, dtype=np.uint8)
        self._learn_kinds(np.arange(128))

    def _learn_kinds(self, points: np.ndarray) -> None:
        """Ask the library's splitter: with "a" before and "!" after it, a letter joins the "a", a
        sign the "!", a number neither, and white space is left out."""
        text = "".join(f"a{chr(p)}! " for p in points.tolist())
        owner = np.full(len(text), -1, dtype=np.int64)
        for i, (_, (start, end)) in enumerate(self.splitter.pre_tokenize_str(text)):
            owner[start:end] = i
        before, own, after = owner[0::4], owner[1::4], owner[2::4]
        self.kind[points] = np.select([own < 0, own == before, own == after], [_SPACE, _LETTER, _SIGN], _NUMBER)

    def _normal(self, text: str) -> bytes:
        if text.isascii():
            return text.lower().encode()
        return self.normalizer.normalize_str(text).encode("utf-8")

    def _bytes(self, text: str) -> bytes:
        if "<" not in text:
            return self._normal(text) + b"\xfe"
        return b"\xff".join(map(self._normal, self.added.split(text))) + b"\xfe"

    def _keys(self, data: np.ndarray) -> np.ndarray:
        """Class * 256 + byte, the class that of the character which the byte belongs to."""
        kinds = self.kind[data].astype(np.int16)
        wide = np.flatnonzero((data & 0xC0) == 0xC0)
        wide = wide[data[wide] < _END]
        if wide.size:
            lead = data[wide].astype(np.int64)
            size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
            point = lead & (0x7F >> size)
            for i in range(1, 4):
                has = size > i
                point[has] = (point[has] << 6) | (data[wide[has] + i] & 0x3F)
            unknown = np.unique(point[self.kind[point] == 255])
            if unknown.size:
                self._learn_kinds(unknown)
            kind = self.kind[point]
            for i in range(4):
                has = size > i
                kinds[wide[has] + i] = kind[has]
        kinds[data >= _END] = _SPACE + 1
        return kinds * 256 + data

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """The number of tokens of each text."""
        found, row = np.zeros(len(texts), dtype=np.int64), 0
        while row < len(texts):
            parts, held, first = [], 0, row
            while row < len(texts) and (not parts or held + len(texts[row] or "") < PIECE_BYTES):
                parts.append(self._bytes(texts[row] or ""))
                held += len(parts[-1])
                row += 1
            keys = self._keys(np.frombuffer(b"".join(parts), dtype=np.uint8))
            starts = np.cumsum([0, *(len(p) for p in parts[:-1])])
            found[first:row] = np.add.reduceat(self.machine.emitted(keys).astype(np.int64), starts)
        return found


@lru_cache(maxsize=2)
def compiled(path: str) -> Tokenizer:
    """One machine for all tasks of a Python worker."""
    return Tokenizer(path)


def count_tokens(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of each row of (doc_id, text).

    ``tokenizer_path`` names the tokenizer file, which every executor has.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(tokenizer_path)
        for batch in batches:
            counts = machine.counts(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts)],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return spread(rows).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
