"""BPE encoding and decoding by dynamic programming over prefixes.

A byte-pair encoding of a string has at each prefix exactly one possible last token: the one that
some encoding of the prefix ends with. For each end position the vocabulary's automaton gives the
tokens that end there; a token is the last one if its start is reached by a token that it is
compatible with, that is, if the pair encodes to itself. Back-pointers then give the exact ids,
with no merge loop. Words are encoded once and remembered in a bounded memory.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole

#: Words of the pre-tokenizer: contractions, letters, single numbers, runs of anything else.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def late_letters(path: str) -> tuple[str, dict[int, str]]:
    """Ranges, for a character class, of letters and numbers that the tokenizers library doesn't
    know as such: they were assigned after its Unicode tables. And the lower case of those letters
    that it knows and Python doesn't. Found by asking the library."""
    from tokenizers import Tokenizer

    unassigned = "".join([c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c) == "Cn"])
    letters = "".join(regex.findall(r"[\p{L}\p{N}]+", unassigned))
    library = Tokenizer.from_file(path)
    late = [ord(c) for c in letters if len(library.pre_tokenizer.pre_tokenize_str(f"!{c}")) == 1]
    lower = {ord(c): small for c in letters if (small := library.normalizer.normalize_str(c)) != c}
    ends = [i for i, c in enumerate(late) if i + 1 == len(late) or late[i + 1] != c + 1]
    return "".join(f"\\U{late[i]:08x}-\\U{late[j]:08x}" for i, j in zip([0, *[e + 1 for e in ends]], ends)), lower


@functools.cache
def patterns(late: str, cased: str) -> tuple[regex.Pattern, regex.Pattern]:
    """What finds a late or late cased letter, and WORD with the late ones among the rest."""
    if not late:
        return regex.compile(f"[{cased}]" if cased else "(?!)"), WORD
    known = rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{late}]]+|[\p{{N}}--[{late}]]|(?:[^\s\p{{L}}\p{{N}}]|[{late}])+"
    return regex.compile(f"[{late}{cased}]"), regex.compile(known)


def latin(text: str) -> bool:
    """Whether all characters are of Latin-1, and so in normal form already."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


#: Words and pairs of tokens of one generation. When it is full it becomes the old one and the old
#: one goes; what is met again moves to the new one, so frequent words stay.
WORDS, PAIRS = 120_000, 100_000

#: Code points beyond which a word isn't remembered.
LONG = 100

NEVER = float("inf")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}
    return [letters[b] for b in range(256)]


class WordBpe:
    """Encoder and decoder of a tokenizer file of kind BPE with word ends and byte letters."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.end: str = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.strings = {i: t for t, i in self.ids.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        marks = sorted(self.special, key=len, reverse=True)
        self.parting = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None
        self.merge: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            a, b, c = self.ids[a], self.ids[b], self.ids[a + b]
            self.merge[a, b] = rank
            self.parts.setdefault(c, (rank, a, b))
        self.letters = byte_letters()
        self.late, self.lower = spec["late"]
        self.inner, self.last = ahocorasick.Automaton(), {}
        for token, i in self.ids.items():
            if token.endswith(self.end) and token != self.end:
                self.last[token[: -len(self.end)]] = i
            else:
                self.inner.add_word(token, (i, len(token)))
        self.inner.make_automaton()
        self.longest_last = max(map(len, self.last), default=0)
        self.fits: dict[tuple[int, int], bool] = {}
        self.old_fits: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.memory: dict[str, tuple[int, str, str]] = {}
        self.old_memory: dict[str, tuple[int, str, str]] = {}

    def edge(self, token: int, right: bool, until: float = NEVER) -> list[tuple[int, float]]:
        """The pieces at one edge of a token, from the token inwards, each with the rank of the
        merge that swallows it (``until`` for the token itself)."""
        out = []
        while True:
            out.append((token, until))
            if token not in self.parts:
                return out
            until, a, b = self.parts[token]
            token = b if right else a

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens, side by side, encode to themselves.

        They don't if a piece at the left one's right edge and a piece at the right one's left edge
        would merge with each other before either is swallowed. Of merges with equal rank the
        leftmost goes first: the left piece's own merge precedes, the right piece's comes after.
        """
        known = self.fits.get((left, right))
        if known is None:
            known = self.old_fits.get((left, right))
            if known is None:
                known = self.apart(left, right)
            if len(self.fits) >= PAIRS:
                self.fits, self.old_fits = {}, self.fits
            self.fits[left, right] = known
        return known

    def apart(self, left: int, right: int, until: float = NEVER) -> bool:
        """Whether no merge across the boundary of the two comes before their merges ``until``."""
        pieces = self.edge(right, False, until)
        return not any(
            (rank := self.merge.get((a, b))) is not None and rank < a_until and rank <= b_until
            for a, a_until in self.edge(left, True, until)
            for b, b_until in pieces
        )

    def stands(self, token: int) -> bool:
        """Whether the token's own string encodes to it."""
        known = self.whole.get(token)
        if known is None:
            parts = self.parts.get(token)
            known = parts is None or (self.stands(parts[1]) and self.stands(parts[2]) and self.apart(parts[1], parts[2], until=parts[0]))
            self.whole[token] = known
        return known

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word in byte letters, without its word end."""
        n = len(word)
        token = self.last.get(word)
        if token is not None and self.stands(token):
            return [token]
        reach: list[tuple[int, int] | None] = [None] * (n + 1)  # last token of each prefix, and its start
        compatible = self.compatible
        for end, (token, size) in self.inner.iter(word):
            end += 1
            if end < n and reach[end] is None:
                start = end - size
                if start == 0:
                    if self.stands(token):
                        reach[end] = (token, 0)
                elif (before := reach[start]) is not None and compatible(before[0], token) and self.stands(token):
                    reach[end] = (token, start)
        for start in range(max(1, n - self.longest_last), n):
            token = self.last.get(word[start:])
            if token is not None and (before := reach[start]) is not None and compatible(before[0], token) and self.stands(token):
                ids = [token]
                while start:
                    token, start = reach[start]
                    ids.append(token)
                return ids[::-1]
        raise ValueError(f"the vocabulary can't spell {word!r}")

    def forget(self) -> None:
        """Lets the old generations go."""
        self.old_memory, self.old_fits = {}, {}

    def remember(self, word: str) -> tuple[int, str, str]:
        got = self.old_memory.get(word)
        if got is None:
            ids = self.encode_word("".join([self.letters[b] for b in word.encode()]))
            got = (len(ids), " ".join(map(str, ids)), " ".join([self.strings[i] for i in ids]))
        if len(self.memory) >= WORDS:
            self.memory, self.old_memory = {}, self.memory
        if len(word) <= LONG:
            self.memory[word] = got
        return got

    def pieces(self, text: str) -> Iterator[tuple[int, str, str]]:
        """(number of ids, ids, token strings) of each word and special token, in order."""
        for i, part in enumerate(self.parting.split(text) if self.parting else [text]):
            if i % 2:
                yield (1, str(self.special[part]), part)
                continue
            pattern = WORD
            if not part.isascii() and not latin(part):
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")  # no final form when lower-cased
                late, known = patterns(self.late, "".join(map(chr, self.lower)))
                if late.search(part):
                    pattern, part = known, part.translate(self.lower)
            for word in pattern.findall(part.lower()):
                yield self.memory.get(word) or self.remember(word)

    def encode_decode(self, text: str) -> tuple[int, str, str]:
        """(number of ids, ids as decimals, decoded text): tokens are put together with a space,
        as the format does that names no decoder."""
        found = list(self.pieces(text))
        return sum(p[0] for p in found), " ".join([p[1] for p in found]), " ".join([p[2] for p in found])

    def encode(self, text: str) -> list[int]:
        return [int(i) for p in self.pieces(text) for i in p[1].split()]

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.strings[i] for i in ids if i in self.strings])


def installed(name: str = "word_bpe_49k.json") -> str:
    """Where the installed public tokenizer file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str) -> dict:
    """The tokenizer file, checked to be of the kind that WordBpe encodes exactly."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model = spec["model"]
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    if model["type"] != "BPE" or not plain or not model.get("end_of_word_suffix") or spec["decoder"] or spec["post_processor"]:
        raise ValueError("only BPE with word ends, without decoder and post-processor, is supported")
    return spec | {"late": late_letters(path)}


#: The encoder of this process, by file: tasks that share a worker share its tables.
ENCODERS: dict[str, WordBpe] = {}


def encoder(path: str, spec: dict) -> WordBpe:
    if path not in ENCODERS:
        ENCODERS.clear()
        ENCODERS[path] = WordBpe(spec)
    return ENCODERS[path]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encode(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256, one row per row.

    With ``keep_ids`` also ids (array of int) and decoded (string). Null texts are empty: no ids,
    and the digests of the empty string. Repeated rows are encoded alike, each in a row of its own;
    a null doc_id stays null; an empty table gives no rows. Other columns are not used. The file is read on the
    driver and sent to the executors once; its size bounds the broadcast.
    """
    spec = docs.sparkSession.sparkContext.broadcast(load(path))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = encoder(path, spec.value)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                n, ids, decoded = bpe.encode_decode(text)
                rows.append((doc_id, n, sha(ids), sha(decoded), *([[int(i) for i in ids.split()], decoded] if keep_ids else [])))
            out = pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 6 if keep_ids else 4])
            yield out.astype({"doc_id": "Int64"})
        bpe.forget()

    return docs.select(F.col("doc_id").cast("long"), whole("text").alias("text")).mapInPandas(run, schema)
