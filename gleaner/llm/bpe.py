"""BPE encoding by backtracking over longest matches, and decoding by an offset table.

An Aho-Corasick automaton of all tokens gives the longest match at every place of a
word in one pass. The encoder walks through the word taking them. Merging by rank would split a text exactly into tokens
of which each neighbouring pair is *compatible*: merging the two tokens' own parts
would not have fused across their border. So the walk checks each new pair; where the
pair is incompatible it tries the next shorter token, and goes back a token when none
is left. A place once found impossible is not tried again, so the time is linear.

The pair test undoes merges from both tokens, latest first, and looks whether the
parts that then meet form a token of earlier rank. Its answers are kept in a table
of bounded size, as are the encodings of words: one string of ids for each word, and
none for a word that is long, so that what a worker keeps is bounded in bytes too.

Text is prepared as the tokenizer's file says: NFC, lower case by character; words are
letters, single numbers, or other signs (white space only separates them, so its runs
need no rewriting); bytes are written as printable characters and the last one
carries the word's end. Special tokens are cut out of the raw text first.

Decoding gathers the bytes of all ids from one byte string by its offset table. The
file has no decoder, so tokens are joined by one space.

Defined results: a null text is empty and has no ids; a null id stays null.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from gleaner.llm.storage import prepared

# How the tokenizer's file splits words, and the mark of a word's end.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"

# Lower case of Unicode 16 and 17, and letters and numbers of Unicode 16, which the
# tokenizer's library knows and this Python may not.
LOWER = (
    {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5}
    | {0xA7DA: 0xA7DB, 0xA7DC: 0x019B}
    | {upper: upper + 0x20 for upper in range(0x10D50, 0x10D66)}
    | {upper: upper + 0x1B for upper in range(0x16EA0, 0x16EB9)}
)
KNOWN_RANGES = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5),
    (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x116D0, 0x116E3), (0x11BC0, 0x11BE0),
    (0x11BF0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16130, 0x16139), (0x16D40, 0x16D6C),
    (0x16D70, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5FA),
]

CACHED_WORDS = 300_000
CACHED_PAIRS = 200_000
CACHED_LETTERS = 40


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0
    for byte in range(256):
        out.append(chr(byte if byte in plain else 0x100 + extra))
        extra += byte not in plain
    return out


def read_ids(written: str) -> np.ndarray:
    """The numbers of a string that has a space between them."""
    return np.fromstring(written, dtype=np.int32, sep=" ") if written else np.zeros(0, dtype=np.int32)


class Bpe:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._letters = dict(enumerate(byte_letters()))
        self._new = self._unassigned()
        self._word = regex.compile(WORD)
        unassigned = f"[{''.join(sorted(self._new))}]"
        self._old_word = regex.compile(
            WORD.replace("[\\p{L}]", f"[\\p{{L}}--{unassigned}]").replace("[\\p{N}]", f"[\\p{{N}}--{unassigned}]").replace(
                "[^\\s\\p{L}\\p{N}]", f"(?:{unassigned}|[^\\s\\p{{L}}\\p{{N}}])"
            ),
            regex.V1,
        )
        self._maybe_new = regex.compile("[\u0558-\U0010ffff]")
        parts = "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self._special = regex.compile(f"({parts})") if parts else None
        self._load(model["merges"])
        self._offsets()
        self._pairs: dict[int, bool] = {}
        self._words: dict[str, str] = {}
        self._restrict()

    @staticmethod
    def _unassigned() -> frozenset[str]:
        """Letters and numbers newer than the tokenizer's Unicode."""
        today = regex.compile(r"[\p{L}\p{N}]")
        known = {c for low, high in KNOWN_RANGES for c in range(low, high + 1)}
        fresh = [c for c in range(0x40000) if unicodedata.category(chr(c)) == "Cn" and today.match(chr(c))]
        return frozenset(chr(c) for c in fresh if c not in known) or frozenset("\uffff")

    @staticmethod
    def _symbols(token: str) -> str:
        """A token with its end mark folded into the last character, so that it is a string of symbols."""
        if token.endswith(WORD_END) and len(token) > len(WORD_END):
            body = token[: -len(WORD_END)]
            return body[:-1] + chr(ord(body[-1]) + 0x10000)
        return token

    def _load(self, merges: list) -> None:
        """Rank and parts of every token; a base symbol has rank -1 and no parts."""
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.fused: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(merges):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            ids = self.vocab[left], self.vocab[right]
            whole = self.vocab[left + right]
            self.fused.setdefault(ids, whole)
            if whole not in self.parts:
                self.parts[whole], self.rank[whole] = ids, rank

    def _offsets(self) -> None:
        """All tokens in one byte string, each with a space behind; token i is at edges[i]:edges[i + 1]."""
        tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        encoded = [tokens.get(i, "").encode() + b" " for i in range(max(tokens) + 1)]
        self.bytes = np.frombuffer(b"".join(encoded), dtype=np.uint8)
        self.edges = np.concatenate(([0], np.cumsum([len(x) for x in encoded])))

    def _restrict(self) -> None:
        """Automaton of the tokens that merging can produce, and for each token the next shorter one."""
        strings = {self._symbols(t): i for t, i in self.vocab.items()}
        made = {i for i in strings.values() if i not in self.parts}
        for token in sorted(self.parts, key=self.rank.__getitem__):
            left, right = self.parts[token]
            if left in made and right in made and self._compatible(left, right, self.rank[token]):
                made.add(token)
        self._pairs.clear()
        self.by_string = {s: i for s, i in strings.items() if i in made}
        self.symbols = {token: len(string) for string, token in self.by_string.items()}
        self.automaton = ahocorasick.Automaton()
        for string, token in self.by_string.items():
            self.automaton.add_word(string, (len(string) - 1, token))
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        for string, token in self.by_string.items():
            for length in range(len(string) - 1, 0, -1):
                if string[:length] in self.by_string:
                    self.shorter[token] = self.by_string[string[:length]]
                    break

    def _compatible(self, left: int, right: int, limit: int | None = None) -> bool:
        """Would merging by rank leave the border between two tokens alone?

        The parts next to the border are taken back, latest merge first. Two of them
        would have fused if their merge comes before the merge that joined the left one
        to its own neighbour; it may tie with the right one's, since of equal merges
        the leftmost happens first.

        limit: only merges of earlier rank count, as inside a token made by that merge.
        """
        rank, parts, fused = self.rank, self.parts, self.fused
        left_end = right_end = len(self.vocab)
        left_end = left_end if limit is None else limit
        while True:
            whole = fused.get((left, right))
            if whole is not None and rank[whole] < left_end and rank[whole] <= right_end:
                return False
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                left, left_end = parts[left][1], min(left_end, a)
            else:
                right, right_end = parts[right][0], b


    def compatible(self, left: int, right: int) -> bool:
        pair = left << 32 | right
        known = self._pairs.get(pair)
        if known is None:
            if len(self._pairs) >= CACHED_PAIRS:
                self._pairs.clear()
            known = self._pairs[pair] = self._compatible(left, right)
        return known

    def forget(self) -> None:
        """Give the memory of both tables back; a worker's next task may be another operator's."""
        self._words.clear()
        self._pairs.clear()

    def encode_symbols(self, symbols: str) -> list[int]:
        """Ids of one word, given as a string of symbols."""
        whole = self.by_string.get(symbols)
        if whole is not None:
            return [whole]
        size = len(symbols)
        longest: list[int | None] = [None] * (size + 1)
        for end, (before, token) in self.automaton.iter(symbols):
            if longest[end - before] is None or self.symbols[longest[end - before]] <= before:
                longest[end - before] = token
        shorter, lengths, compatible = self.shorter, self.symbols, self.compatible
        out: list[int] = []
        dead = bytearray(size + 1)
        at, token = 0, longest[0]
        while at < size:
            while token is not None:
                end = at + lengths[token]
                if not dead[end] and (not out or compatible(out[-1], token)):
                    break
                token = shorter.get(token)
            if token is not None:
                out.append(token)
                at = end
                token = longest[at]
            else:
                if not out:
                    raise ValueError(f"no tokens for {symbols!r}")
                dead[at] = 1
                last = out.pop()
                at -= lengths[last]
                token = shorter.get(last)
        return out

    def encode_word(self, word: str) -> str:
        """Ids of a word, written with a space between."""
        found = self._words.get(word)
        if found is None:
            letters = word.encode().decode("latin-1").translate(self._letters)
            found = " ".join(map(str, self.encode_symbols(letters[:-1] + chr(ord(letters[-1]) + 0x10000))))
            if len(word) <= CACHED_LETTERS:
                if len(self._words) >= CACHED_WORDS:
                    self._words.clear()
                self._words[word] = found
        return found

    def words(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text)
        if self._maybe_new.search(text):
            text = text.translate(LOWER)
            if not self._new.isdisjoint(text):
                return self._old_word.findall(text.replace("Σ", "σ").lower())
        # By character: a sigma at a word's end is lowered like any other.
        return self._word.findall(text.replace("Σ", "σ").lower())

    def written(self, text: str) -> str:
        """Ids of a text, written with a space between."""
        parts = self._special.split(text) if self._special and "<|" in text else [text]
        out = []
        known = self._words
        for part in parts:
            if part in self.special:
                out.append(str(self.special[part]))
            elif part:
                out += [known.get(word) or self.encode_word(word) for word in self.words(part)]
        return " ".join(out)

    def encode(self, text: str) -> list[int]:
        return read_ids(self.written(text)).tolist()

    def decode(self, ids: list[int] | np.ndarray) -> str:
        if not len(ids):
            return ""
        ids = np.asarray(ids)
        starts = self.edges[ids]
        lengths = self.edges[ids + 1] - starts
        to = np.cumsum(lengths)
        gather = np.repeat(starts - to + lengths, lengths) + np.arange(to[-1])
        return self.bytes[gather[:-1]].tobytes().decode()


_loaded: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    """The tokenizer of a file, read once by each Python worker."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encoded_batches(batches: Iterator[pa.RecordBatch], bpe: Bpe, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """What :func:`encoded` returns, of batches of (doc_id, text)."""
    try:
        for batch in batches:
            counts, digests, decoded, lists = [], [], [], []
            for text in batch["text"]:
                written = bpe.written(text.as_py() or "")
                ids = read_ids(written)
                counts.append(len(ids))
                digests.append(hashlib.sha256(written.encode()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
                if with_ids:
                    lists.append(ids)
            columns = [batch["doc_id"], pa.array(counts, pa.int64()), pa.array(digests), pa.array(decoded)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns, names = [*columns, pa.array(lists, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)
    finally:
        bpe.forget()


def encoded(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of every row of ``docs`` (doc_id, text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from encoded_batches(batches, loaded(path), with_ids)

    prepared(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(scan, schema)
