"""BPE encoding by a bounded-lookahead streaming transducer, decoding by an incremental state machine.

A merge list whose every merge uses only symbols made by earlier merges ("proper") is applied in rank order.
What follows a stretch of text can change the tokens in it only by a chain of merges of rising rank, each
taking one more symbol to the left: the right part of a merge begins with the left part of the one before.
The longest such chain, in symbols, is the list's sufficient lookahead: tokens that end that many symbols
before the end of what has been read are stable and are emitted, so a word of any length takes constant memory. (A
word shorter than that has no stable token before its end.) A text's tokens are emitted and decoded piece by piece.

Nulls count as empty texts (no tokens); repeated rows give repeated rows; an empty table gives an empty table;
columns other than doc_id and text are left behind.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import struct
import unicodedata
import uuid
from collections.abc import Iterable, Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import id_text, lean, texts_of

#: Fixed value: Unicode white space as the tokenizer's pattern has it.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Words of a generation that each worker remembers with their tokens (and of the one before), and characters of the longest.
REMEMBERED, LONG = 250_000, 64
#: Characters of text, and tokens of one word, that are worked on at once.
CHUNK = 1 << 14
_space = re.compile(r"\s")
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_chars() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where printable, else from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


def load_spec(path: str) -> dict:
    """What the encoder needs of a tokenizer file in the tokenizers library's format."""
    with open(path, encoding="utf-8") as f:
        x = json.load(f)
    split = next(p for p in x["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
    return {
        "vocab": x["model"]["vocab"],
        "merges": [tuple(m.split(" ") if isinstance(m, str) else m) for m in x["model"]["merges"]],
        "suffix": x["model"]["end_of_word_suffix"] or "",
        "special": {t["content"]: t["id"] for t in x["added_tokens"]},
        "pattern": split.replace(r"[^\s\p{L}\p{N}]", rf"[^{SPACE}\p{{L}}\p{{N}}]"),
    }


def lookahead(merges: list[tuple[str, str]], suffix: str) -> int | None:
    """The merge list's sufficient lookahead in base symbols; None if the list is not proper."""
    made: dict[str, int] = {}
    for r, (a, b) in enumerate(merges):
        made.setdefault(a + b, r)
    if any(made.get(x, -1) >= r for r, (a, b) in enumerate(merges) for x in (a, b)):
        return None
    best: dict[str, int] = {}
    most = 0
    for a, b in reversed(merges):
        f = len(a) + best.get(a, 0)
        most = max(most, f)
        b = b.removesuffix(suffix) if suffix else b
        for k in range(1, len(b) + 1):
            if best.get(b[:k], 0) < f:
                best[b[:k]] = f
    return most + 1


class LongWord(Exception):
    """A word too long to remember."""


class Known(dict):
    """Words with their ids as bytes. Those used since the last change of generations outlive the next one."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, w: str) -> bytes:
        if len(w) > LONG:
            raise LongWord
        if (x := self.old.get(w)) is None:
            x = self.make(w)
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[w] = x
        return x


class Encoder:
    """Text to token ids, as the tokenizers library does it for this file's kind of tokenizer."""

    def __init__(self, spec: dict, window: int | None = None):
        self.vocab, self.suffix, self.special = spec["vocab"], spec["suffix"], spec["special"]
        self.names = {i: t for t, i in (self.vocab | self.special).items()}
        # ranks of merges by their left id and then their right id, and what each makes
        self.none, self.made = len(spec["merges"]), [self.vocab[a + b] for a, b in spec["merges"]]
        nothing: dict[int, int] = {}
        self.after = [nothing] * (max(self.names, default=-1) + 1)
        for r, (a, b) in enumerate(spec["merges"]):
            if not (own := self.after[self.vocab[a]]):
                own = self.after[self.vocab[a]] = {}
            own.setdefault(self.vocab[b], r)
        self.ahead = lookahead(spec["merges"], self.suffix)
        self.window = window or self.ahead or 0
        chars = byte_chars()
        self.inner = [self.vocab[c] for c in chars]
        self.final = [self.vocab[c + self.suffix] for c in chars]
        self.width = {i: len(t.removesuffix(self.suffix)) for t, i in self.vocab.items()}
        self.words = regex.compile(spec["pattern"]).findall
        plain = re.sub(r"\[[^\]]*\]", lambda m: m[0].replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9"), spec["pattern"])
        self.ascii_words = self.words if r"\p" in plain else re.compile(plain).findall
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known = Known(self.packed)

    def merged(self, ids: list[int]) -> list[int]:
        """All merges applied: lowest rank first, leftmost first among equals."""
        if len(ids) > 100:
            return self.merged_long(ids)
        after, made, none = self.after, self.made, self.none
        ids, ranks = ids[:], [after[a].get(b, none) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            ids[i] = x = made[best]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = after[ids[i - 1]].get(x, none)
            if i < len(ranks):
                ranks[i] = after[x].get(ids[i + 1], none)
        return ids

    def merged_long(self, ids: list[int]) -> list[int]:
        """merged() with a heap and a linked list, for many symbols."""
        ranks, makes, n = self.after, self.made, len(ids)
        at, after, before = [*ids, -1], [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(x, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (x := ranks[a].get(b)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            if at[i] != a or (j := after[i]) >= n or at[j] != b:
                continue
            made = makes[r]
            at[i], at[j], after[i] = made, -1, (k := after[j])
            if k < n:
                before[k] = i
                if (x := ranks[made].get(at[k])) is not None:
                    heapq.heappush(heap, (x, i, made, at[k]))
            if (h := before[i]) >= 0 and (x := ranks[at[h]].get(made)) is not None:
                heapq.heappush(heap, (x, h, at[h], made))
        return [x for x in at[:n] if x >= 0]

    def transduce(self, data: bytes) -> Iterator[int]:
        """Token ids of one word, read in runs of bytes; holds at most the lookahead and a window of symbols."""
        held: list[int] = []
        at, last = 0, len(data) - 1
        full = last if self.ahead is None else self.ahead + self.window
        while at < last:
            run = data[at : min(last, at + full - len(held))]
            at += len(run)
            held += map(self.inner.__getitem__, run)
            if self.ahead is not None and len(held) >= full:
                done, safe = 0, len(held) - self.ahead
                for t in self.merged(held):
                    if done + self.width[t] > safe:
                        break
                    done += self.width[t]
                    yield t
                held = held[done:]
                full = len(held) + self.window
        if last >= 0:
            held.append(self.final[data[last]])
        yield from self.merged(held)

    def packed(self, w: str) -> bytes:
        """The ids of a word as bytes."""
        ids = [*self.transduce(w.encode())]
        return struct.pack(f"<{len(ids)}I", *ids)

    def word(self, w: str) -> Iterator[bytes]:
        """The ids of a word as bytes; more than one piece for a word too long to remember."""
        if len(w) <= LONG:
            yield self.known[w]
            return
        ids = self.transduce(w.encode())
        while part := [*islice(ids, CHUNK)]:
            yield struct.pack(f"<{len(part)}I", *part)

    def stretches(self, text: str) -> Iterator[str | tuple[str]]:
        """The text between special tokens, normalised and cut before white space into stretches of about CHUNK
        characters (a longer word stays whole), and the special tokens (as 1-tuples)."""
        for k, part in enumerate(self.marks.split(text) if self.marks and "<" in text else [text]):
            if k % 2:
                yield (part,)
                continue
            at = 0
            while at < len(part):
                cut = _space.search(part, at + CHUNK)
                end = cut.start() if cut else len(part)
                x, at = part[at:end], end
                if not x.isascii():
                    x = unicodedata.normalize("NFC", x).replace("Σ", "σ")
                yield x.lower()

    def stream(self, text: str) -> Iterator[bytes]:
        """The text's ids as little-endian unsigned 32-bit integers, piece by piece."""
        for part in self.stretches(text):
            if isinstance(part, tuple):
                yield np.array([self.special[part[0]]], "<u4").tobytes()
                continue
            words = self.ascii_words(part) if part.isascii() else self.words(part)
            try:
                got = b"".join(map(self.known.__getitem__, words))
            except LongWord:
                for w in words:
                    yield from self.word(w)
            else:
                yield got

    def encode(self, text: str) -> bytes:
        """stream() as a whole."""
        return b"".join(self.stream(text))


_back = {c: b for b, c in enumerate(byte_chars())}
_encoders: dict[str, Encoder] = {}


def encoder(name: str, spec) -> Encoder:
    """This worker's encoder of a broadcast specification, kept for its next tasks under the run's name."""
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = Encoder(spec.value)
    return _encoders[name]


class Decoder:
    """Ids to text, as they come. joined: the vocabulary's strings with spaces between (what the library does
    without a decoder section); else the bytes they stand for, as far as they are whole characters, with a space for each word end."""

    def __init__(self, names: dict[int, str], suffix: str, special: dict[str, int], joined: bool = True):
        self.names, self.suffix, self.special, self.joined = names, suffix, special, joined
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")
        self.first = True

    def push(self, ids: Iterable[int]) -> str:
        """What the ids add to the text; ids that the vocabulary lacks add nothing."""
        if not self.joined:
            return "".join(map(self.shown, ids))
        try:
            out = " ".join(map(self.names.__getitem__, ids))
        except KeyError:
            out = " ".join(self.names[i] for i in ids if i in self.names)
        if not out:
            return out
        lead, self.first = "" if self.first else " ", False
        return lead + out

    def shown(self, i: int) -> str:
        if (name := self.names.get(i)) is None:
            return ""
        if name in self.special:
            return self.utf8.decode(b"", True) + name
        ends = bool(self.suffix) and name.endswith(self.suffix)
        raw = bytes(_back[c] for c in (name.removesuffix(self.suffix) if ends else name))
        return self.utf8.decode(raw + b" " * ends)

    def end(self) -> str:
        return "" if self.joined else self.utf8.decode(b"", True)


def decoder(encoder: Encoder, joined: bool = True) -> Decoder:
    return Decoder(encoder.names, encoder.suffix, encoder.special, joined)


def decode(encoder: Encoder, ids: Sequence[int], joined: bool = True) -> str:
    d = decoder(encoder, joined)
    return d.push(ids) + d.end()


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit) and decoded text of every row."""
    spec, name = docs.sparkSession.sparkContext.broadcast(load_spec(path)), uuid.uuid4().hex

    @lean
    def run(batches):
        e = encoder(name, spec)
        for b in batches:
            ids = [e.encode(t) for t in texts_of(b)]
            text = [decode(e, np.frombuffer(x, "<u4").tolist()) for x in ids]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary()), pa.array(text, pa.string())], ["doc_id", "ids", "decoded"])

    return id_text(docs).mapInArrow(run, "doc_id long, ids binary, decoded string")


def digest(e: Encoder, text: str) -> tuple[int, str, str]:
    """How many ids, the SHA-256 of the ids and of what the decoder makes of them; both fed piece by piece."""
    n, ids, shown, d = 0, hashlib.sha256(), hashlib.sha256(), decoder(e)
    for piece in e.stream(text):
        n += len(piece) // 4
        ids.update(piece)
        shown.update(d.push(np.frombuffer(piece, "<u4").tolist()).encode())
    shown.update(d.end().encode())
    return n, ids.hexdigest(), shown.hexdigest()


def digests(docs: DataFrame, path: str) -> DataFrame:
    """tokenized() reduced to counts and SHA-256 digests where the rows are, so that no tokens travel."""
    spec, name = docs.sparkSession.sparkContext.broadcast(load_spec(path)), uuid.uuid4().hex

    @lean
    def run(batches):
        e = encoder(name, spec)
        for b in batches:
            got = [digest(e, t) for t in texts_of(b)]
            n, ids, shown = zip(*got) if got else ([], [], [])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(shown, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_text(docs).mapInArrow(run, SCHEMA)
