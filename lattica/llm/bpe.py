"""Byte-pair encoding and decoding over a pair occurrence index.

The words of a batch that aren't known yet are laid out as one sequence of symbols. An index maps each
adjacent pair to all its positions; a heap holds the ranks of the pairs that occur. The lowest active rank is
applied at all its positions at once, and only the lists of the pairs beside them are updated. What a word
encodes to is kept for the partition's later batches, up to a bounded number of words.

The vocabulary file is one that the tokenizers library reads: NFC, lower case, words with an end mark. Its
path is a parameter and the file has to be there on every executor, like any library's data.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections import defaultdict
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from lattica.llm.common import in_batches

#: What a Python worker keeps of runs, words and their encodings, in characters; beyond, it starts anew. Longer runs than LONGEST aren't kept.
KEPT_CHARS = 45_000_000
LONGEST = 64
#: Characters whose words are gathered before they are encoded together.
GATHER = 1_000_000
CONTROL = re.compile(r"[\x1c-\x1f]")  # white space to str.split(), not to the vocabulary
SPACES = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")

#: Letters, numbers and lower-case forms (first, last, distance to the lower-case one) of Unicode 16 and 17 that
#: the tokenizers library knows and Unicode 15.1, which unicodedata has, doesn't.
NEWER_LETTERS = "1c89-1c8a a7cb-a7cd a7da-a7dc 105c0-105f3 10d4a-10d65 10d6f-10d85 10ec2-10ec4 11380-11389 1138b 1138e 11390-113b5 113b7 113d1 113d3 11bc0-11be0 13460-143fa 16100-1611d 16d40-16d6c 18cff 1e5d0-1e5ed 1e5f0"
NEWER_NUMBERS = "10d40-10d49 116d0-116e3 11bf0-11bf9 16130-16139 16d70-16d79 1ccf0-1ccf9 1e5f1-1e5fa"
NEWER_LOWER = ((0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, -0xA567), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, -0xA641), (0x10D50, 0x10D65, 32), (0x16EA0, 0x16EB8, 27))


def _listed(ranges: str) -> set[int]:
    return {c for r in ranges.split() for first, _, last in [r.partition("-")] for c in range(int(first, 16), int(last or first, 16) + 1)}


def _char_class(points: set[int]) -> str:
    """The inside of a character class that holds these code points."""
    out, start = [], None
    for c in sorted(points):
        if c - 1 not in points:
            start = c
        if c + 1 not in points:
            out.append(f"\\U{start:08x}-\\U{c:08x}")
    return "".join(out)


@lru_cache(maxsize=1)
def pieces_pattern() -> re.Pattern:
    """Contractions, runs of letters, single numbers and runs of other characters, of text without white space. Classes are those of the library's Unicode version."""
    category = unicodedata.category
    letters, numbers = _listed(NEWER_LETTERS), _listed(NEWER_NUMBERS)
    for c in range(0x110000):
        kind = category(chr(c))[0]
        if kind == "L":
            letters.add(c)
        elif kind == "N":
            numbers.add(c)
    letter, number = _char_class(letters), _char_class(numbers)
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{letter}{number}]+")


LOWERED = {c: c + d for first, last, d in NEWER_LOWER for c in range(first, last + 1)} | {0x3A3: 0x3C3}  # a final sigma gets no form of its own
FIRST_LOWER = re.compile("[" + "".join(map(chr, LOWERED)) + "]")


def lowered(text: str) -> str:
    return (text.translate(LOWERED) if FIRST_LOWER.search(text) else text).lower()


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if it is printable in Latin-1, else the next one from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


#: The normalisation and the cutting that are implemented here, as a vocabulary file names them.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
CUTTING = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def _require(spec: dict) -> None:
    """Refuse a file that asks for other steps than those implemented."""
    split, *_ = spec["pre_tokenizer"].get("pretokenizers") or [{}]
    if spec["model"]["type"] != "BPE" or spec["normalizer"].get("normalizers") != NORMALIZERS or split.get("pattern", {}).get("Regex") != CUTTING or spec.get("decoder"):
        raise ValueError("the vocabulary file asks for another normalisation, cutting or decoding than NFC, lower case and word pieces")


class PairVocabulary:
    """Ids and merges of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        _require(spec)
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        self.ranks: dict[int, int] = {}  # left << 32 | right -> rank
        self.made: list[tuple[int, int, int]] = []  # rank -> left, right, what they become
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            left, right = self.ids[a], self.ids[b]
            self.ranks[left << 32 | right] = rank
            self.made.append((left, right, self.ids[a + b]))
        bytes_ = byte_symbols()
        self.inner = [self.ids[c] for c in bytes_]
        self.last = [self.ids[c + self.end] for c in bytes_]
        self.marks = re.compile("|".join(map(re.escape, self.special))) if self.special else None

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word, given as UTF-8."""
        symbols: list[int] = []
        after: list[int] = []  # the position of the next symbol of the word, or -1
        before: list[int] = []
        starts = []
        for word in words:
            at, n = len(symbols), len(word)
            starts.append(at)
            symbols += [self.inner[b] for b in word]
            symbols[-1] = self.last[word[-1]]
            before += [-1, *range(at, at + n - 1)]
            after += [*range(at + 1, at + n), -1]
        rank_of = self.ranks.get
        index: dict[int, list[int]] = defaultdict(list)  # rank -> positions of its pair's left symbol
        for i, j in enumerate(after):
            if j >= 0 and (rank := rank_of(symbols[i] << 32 | symbols[j])) is not None:
                index[rank].append(i)
        active = list(index)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            left, right, new = self.made[rank]
            places = index.pop(rank)
            if left == right:
                places.sort()  # of overlapping pairs the leftmost goes first
            for i in places:
                j = after[i]
                if j < 0 or symbols[i] != left or symbols[j] != right:
                    continue  # taken by an earlier merge
                symbols[i], symbols[j] = new, -1
                k = after[i] = after[j]
                if k >= 0:
                    before[k] = i
                    if (r := rank_of(new << 32 | symbols[k])) is not None:
                        if r not in index:
                            heapq.heappush(active, r)
                        index[r].append(i)
                h = before[i]
                if h >= 0 and (r := rank_of(symbols[h] << 32 | new)) is not None:
                    if r not in index:
                        heapq.heappush(active, r)
                    index[r].append(h)
        out = []
        for i in starts:
            ids = []
            while i >= 0:
                ids.append(symbols[i])
                i = after[i]
            out.append(ids)
        return out

    def pieces(self, chunk: str) -> list[str]:
        """The words that a run without white space falls into, normalised."""
        chunk = chunk.lower() if chunk.isascii() else lowered(unicodedata.normalize("NFC", chunk))
        return [chunk] if chunk.isalpha() else pieces_pattern().findall(chunk)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> PairVocabulary:
    return PairVocabulary(path)


def chunks(text: str) -> list[str]:
    return text.split() if not CONTROL.search(text) else [c for c in SPACES.split(text) if c]


class Encoder:
    """Encodes texts batch by batch; keeps what short runs without white space, and the words in them, encode to, up to a bounded number of characters."""

    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        self.forget()

    def forget(self) -> None:
        special = self.vocab.special
        self.words: dict[str, tuple[str, str]] = {}
        self.ids = {t: str(i) for t, i in special.items()}  # a run never holds a special token: texts are cut there first
        self.tokens = {t: t for t in special}
        self.held = 0
        self.passing: list[str] = []

    def learn(self, found: set[str]) -> None:
        """Encode what isn't known of the runs. Long ones are known until the next call only."""
        for c in self.passing:
            del self.ids[c], self.tokens[c]
        self.passing = []
        if self.held > KEPT_CHARS:
            self.forget()
        new = found - self.ids.keys()
        split = {c: self.vocab.pieces(c) for c in new}
        missing = list({w for ws in split.values() for w in ws} - self.words.keys())
        names = self.vocab.tokens
        words = {}
        for w, ids in zip(missing, self.vocab.encode_words([w.encode() for w in missing]), strict=True):
            words[w] = (" ".join(map(str, ids)), " ".join([names[i] for i in ids]))
            if len(w) <= LONGEST:
                self.words[w] = words[w]
                self.held += len(w) + len(words[w][0]) + len(words[w][1])
        for c, ws in split.items():
            if len(ws) == 1:
                ids, tokens = words.get(ws[0]) or self.words[ws[0]]
            else:
                parts = [words.get(w) or self.words[w] for w in ws]
                ids, tokens = " ".join([p[0] for p in parts]), " ".join([p[1] for p in parts])
            self.ids[c], self.tokens[c] = ids, tokens
            if len(c) > LONGEST:
                self.passing.append(c)
            else:
                self.held += len(c) + len(ids) + len(tokens)

    def runs(self, text: str | None) -> list[str]:
        """The runs of a text without white space, and its special tokens, which are looked for in the text as it is."""
        if not text:
            return []
        marks = self.vocab.marks
        if not marks or "<|" not in text:
            return chunks(text)
        out, done = [], 0
        for m in marks.finditer(text):
            out += [*chunks(text[done : m.start()]), m[0]]
            done = m.end()
        return out + chunks(text[done:])

    def encode(self, texts: list[str | None]):
        """(number of ids, ids joined by spaces, decoded text) of each text. Null counts as empty."""
        i = 0
        while i < len(texts):
            runs, size = [], 0
            while i < len(texts) and (not runs or size < GATHER):
                runs.append(self.runs(texts[i]))
                size += len(texts[i] or "")
                i += 1
            self.learn({c for r in runs for c in r})
            for r in runs:
                ids = " ".join(map(self.ids.__getitem__, r))
                yield ids.count(" ") + bool(ids), ids, " ".join(map(self.tokens.__getitem__, r))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each Python worker, so that later tasks find what earlier ones learnt."""
    return Encoder(path)


def decode(ids: list[int], path: str) -> str:
    """The tokens joined by single spaces: the vocabulary has no decoder of its own. Special tokens stay."""
    tokens = vocabulary(path).tokens
    return " ".join(tokens[i] for i in ids if i in tokens)


def encode_ids(texts: list[str | None], path: str) -> list[list[int]]:
    return [[int(x) for x in ids.split()] for _, ids, _ in encoder(path).encode(texts)]


def bpe_digests(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: n_tokens, ids_sha256, decoded_sha256. Null and empty texts have no tokens."""

    def run(texts):
        n, ids, decoded = [], [], []
        for count, joined, back in encoder(path).encode(texts):
            n.append(count)
            ids.append(hashlib.sha256(joined.encode()).hexdigest())
            decoded.append(hashlib.sha256(back.encode()).hexdigest())
        return {"n_tokens": n, "ids_sha256": ids, "decoded_sha256": decoded}

    kind = docs.schema[id].dataType.simpleString()
    return in_batches(docs, [id, text], run, f"`{id}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", passed=[id])


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with an array of token ids; null texts get an empty one."""

    def run(texts):
        return {ids: pa.array([[int(x) for x in joined.split()] for _, joined, _ in encoder(path).encode(texts)], pa.list_(pa.int32()))}

    others = [c for c in docs.columns if c != ids]
    taken = "_" * (1 + max(map(len, docs.columns)))  # longer than any name, so it clashes with none
    held = docs.select(*others, docs[text].alias(taken))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != ids)
    return in_batches(held, held.columns, run, f"{schema}, `{ids}` array<int>", passed=others)
