"""BPE encoding by dynamic programming over prefixes, and decoding.

For each prefix of a piece of text exactly one vocabulary entry can be the last token of its
encoding: an entry that is a suffix of the prefix and is compatible with the last token of what is
before it. An automaton over the vocabulary lists the suffixes; two tokens are compatible if no
merge that crosses their border would have come first. The encoding follows the back-pointers.
The work is linear in the length of a piece, also for pieces of many thousand characters.

The tokenizer file is read on the driver and its content (a few MB, whatever the corpus) is sent to
the executors, which need no copy of their own. Results of short runs of text are kept in caches whose
bytes are bounded; runs of ``KEPT_CHARS`` characters or more are never kept.

Defined results: a null or empty text has no ids, and no ids stand for the empty text; very long texts
and very long pieces (without any white space) are encoded whole, in time linear in their length;
repeated rows get equal results, one for each; there are no ties, as each prefix has one last token;
an empty table gives an empty result; columns that have the name of a new one are replaced, all others
stay.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import slices

#: Fixed value: how byte-level BPE splits text before the merges.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEPT_CHARS = 100
KEPT_BYTES = 80 << 20  # of each of two generations
KEPT_PAIRS = 400_000
_ENTRY = 260  # bytes of an entry beside its characters


class Kept:
    """Results of short strings. What is full becomes the old generation, which goes when the next is full."""

    def __init__(self, limit: int = KEPT_BYTES) -> None:
        self.new: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.size, self.limit = 0, limit

    def add(self, key: str, value: str) -> None:
        if len(key) >= KEPT_CHARS:
            return
        self.size += _ENTRY + 2 * len(key) + len(value)
        if self.size > self.limit:
            self.old, self.new, self.size = self.new, {}, 0
        self.new[key] = value


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in the vocabulary file: printable ones for themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(other)}


class ByteBpe:
    """Encoder and decoder for the content of a byte-level BPE ``tokenizer.json``."""

    def __init__(self, content: str) -> None:
        spec = json.loads(content)
        model = spec["model"]
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("a byte-level BPE without a normalizer is asked for")
        alphabet = byte_alphabet()
        to_bytes = lambda s: bytes(alphabet[c] for c in s)
        vocab = model["vocab"]
        self.content = {i: to_bytes(s) for s, i in vocab.items()}
        #: Which two tokens make a token, by their order: a token made earlier has the lower rank.
        self.rank = {i: -1 for i in self.content}
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for n, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            token = vocab[left + right]
            self.joined.setdefault((vocab[left], vocab[right]), n)
            if token not in self.parts:
                self.parts[token], self.rank[token] = (vocab[left], vocab[right]), n
        self.sizes = [0] * (max(self.content) + 1)
        for i, b in self.content.items():
            self.sizes[i] = len(b)
        self.pairs: dict[int, bool] = {}  # by left << 20 | right
        self.automaton = ahocorasick.Automaton()
        for i, b in self.content.items():
            self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", ())):
            raise ValueError("added tokens that take white space with them are not supported")
        self.content |= {i: s.encode() for s, i in self.special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.find = regex.compile(PIECES).findall
        self.units = Kept()
        self.decimal = list(map(str, range(len(self.sizes))))
        self.marks = {c: f",{self._piece(c)}" for c in ".,"}
        self.by_decimal = {str(i): b for i, b in self.content.items()}

    def compatible(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' joint text is just these two.

        Goes back through the merges that made them, the latest first. A merge over the border that
        comes before the merge looked at would have taken its parts away.
        """
        if len(self.pairs) > KEPT_PAIRS:
            self.pairs.clear()
        rank, parts, joined = self.rank, self.parts, self.joined
        a, b, fine = left, right, True
        bound = len(joined) + 1
        while True:
            across = joined.get((a, b))
            if across is not None and across < bound:
                fine = False
                break
            if a not in parts and b not in parts:
                break
            # the side that was merged last goes back; of equal merges the one further left came first
            if rank[a] > rank[b]:
                bound, a = rank[a], parts[a][1]
            else:
                bound, b = rank[b] + 1, parts[b][0]
        self.pairs[left << 20 | right] = fine
        return fine

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece (what the split pattern or the caller sees as a unit)."""
        data = piece if piece.isascii() else piece.encode().decode("latin-1")
        sizes, pairs, compatible = self.sizes, self.pairs, self.compatible
        last = [-1] * (len(data) + 1)  # by prefix: the last token of its encoding
        done = -1
        for end, token in self.automaton.iter(data):  # the suffixes of each prefix in turn
            if end == done:
                continue
            start = end + 1 - sizes[token]
            if start:
                before = last[start]
                fine = pairs.get(before << 20 | token)  # before is -1, and the key below 0, where no prefix ends
                if fine is None:
                    fine = before >= 0 and compatible(before, token)
                if not fine:
                    continue
            last[end + 1] = token
            done = end
        out, at = [], len(data)
        while at:
            token = last[at]
            if token < 0:
                raise ValueError(f"no token ends at byte {at} of {piece[:40]!r}")
            out.append(token)
            at -= sizes[token]
        out.reverse()
        return out

    def _piece(self, piece: str) -> str:
        decimal = self.decimal
        return ",".join([decimal[i] for i in self.encode_piece(piece)])

    def _units(self, text: str) -> list[str]:
        """Ids of units of a text, in order.

        A unit is what is between two spaces, with the space before it: the split pattern never looks
        past such a unit if it neither is empty nor starts or ends with white space. Other texts are
        split by the pattern as a whole. Units repeat, so their ids are kept.
        """
        chunks = text.split(" ")
        first = chunks[0]
        if not first or first[-1].isspace() or first[0].isspace():
            return self._whole(text)
        out = list(map(self.units.new.get, chunks))
        out[0] = ",".join(self._whole(first))  # no space stands before it
        if None in out:
            unit = self._unit
            for i, c in enumerate(chunks):
                if out[i] is None:
                    if (got := unit(c)) is None:
                        return self._whole(text)
                    out[i] = got
        return out

    def _whole(self, text: str) -> list[str]:
        """Ids of the pieces that the pattern finds; those that are a space and letters are units."""
        return [self._piece(p) if p[0] != " " or (got := self._unit(p[1:])) is None else got for p in self.find(text)]

    def _unit(self, word: str) -> str | None:
        """Ids of a space and ``word``, which has no space in it; None if white space is at one of its ends."""
        kept = self.units
        got = kept.new.get(word)
        if got is not None:
            return got
        got = kept.old.get(word)
        if got is None:
            if word.isalpha():  # letters alone are one piece, for the pattern as well
                got = self._piece(" " + word)
            elif word[-1:] in self.marks and word[:-1].isalpha():  # one more piece; made from the word without it
                return self._unit(word[:-1]) + self.marks[word[-1]]
            elif not word or word[0].isspace() or word[-1].isspace():
                return None
            else:
                got = ",".join([self._piece(p) for p in self.find(" " + word)])
        kept.add(word, got)
        return got

    def encode_text(self, text: str) -> str:
        """Ids of a text, as decimals joined by commas."""
        got: list[str] = []
        for part in [text] if self.split_special is None else self.split_special.split(text):
            if part in self.special:
                got.append(str(self.special[part]))
            elif part:
                got += self._units(part)
        return ",".join(got)

    def decode_ids(self, ids: str) -> str:
        """Text of decimals joined by commas; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.by_decimal.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""


class Decoder:
    """What decoding needs of a tokenizer file: the bytes of each id."""

    def __init__(self, content: str) -> None:
        spec = json.loads(content)
        alphabet = byte_alphabet()
        self.by_decimal = {str(i): bytes(alphabet[c] for c in s) for s, i in spec["model"]["vocab"].items()}
        self.by_decimal |= {str(t["id"]): t["content"].encode() for t in spec.get("added_tokens", ())}

    decode_ids = ByteBpe.decode_ids


_known: dict[tuple, ByteBpe | Decoder] = {}


def tokenizer(content: str, kind: type = ByteBpe) -> ByteBpe | Decoder:
    """One encoder or decoder for each content and Python process."""
    key = kind, hash(content)
    if key not in _known:
        _known.clear()
        _known[key] = kind(content)
    return _known[key]


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def count(ids: str) -> int:
    return ids.count(",") + 1 if ids else 0


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with its columns and a column ``ids``: the decimal ids of ``text``, joined by commas.

    A null text counts as empty and has the empty string. A column of the name ``ids`` is replaced.
    """
    return _apply(docs, path, text, {ids: "string"}, lambda t, s: (t.encode_text(s),))


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with its columns and the text that the ids (decimals joined by commas; null: none) stand for."""
    return _apply(docs, path, ids, {text: "string"}, lambda t, s: (t.decode_ids(s),), kind=Decoder)


def digests(docs: DataFrame, path: str, text: str = "text", ids: str | None = None, with_text: bool = True) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256, from :func:`encode` and then :func:`decode` in one pass.

    The ids themselves are in the column named by ``ids``, if one is asked for; ``with_text`` says
    whether the column ``text`` stays.
    """

    def both(t: ByteBpe, s: str) -> tuple:
        found = t.encode_text(s)
        back = t.decode_ids(found)
        made = count(found), hashlib.sha256(found.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()
        return made if ids is None else (*made, found)

    new = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"} | ({} if ids is None else {ids: "string"})
    return _apply(docs, path, text, new, both, with_text)


def _apply(docs: DataFrame, path: str, column: str, new: dict[str, str], each, with_text: bool = True, kind: type = ByteBpe) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(read_tokenizer(path))
    own = docs.drop(*new)
    if column not in own.columns:
        raise ValueError(f"no column {column}")
    at = own.columns.index(column)
    places = [i for i, c in enumerate(own.columns) if with_text or i != at]
    names = [own.columns[i] for i in places] + list(new)
    kinds = {"string": pa.string(), "bigint": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(shared.value, kind)
        for batch in slices(batches, at):
            rows = [each(t, s.as_py() or "") for s in batch.column(at)]
            made = [pa.array([r[k] for r in rows], kinds[x]) for k, x in enumerate(new.values())]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in places], *made], names=names)

    schema = ", ".join([f"`{own.schema[i].name}` {own.schema[i].dataType.simpleString()}" for i in places] + [f"`{k}` {v}" for k, v in new.items()])
    return own.mapInArrow(run, schema)
