"""Byte-pair encoding by speculation and verification, and decoding.

The tokenizer file is read, not its encoder: normal form, words and merges are worked
out here, and equal what the tokenizers library gives.

1. *Words.* Special tokens are cut out as they stand. What lies between gets the
   file's normal form (composed, lower case) and is cut into runs of letters, single
   digits, runs of other signs, and English endings. Which characters are letters,
   digits or white space is asked of the file's own splitter once per worker, so that
   both sides go by the same edition of Unicode. Each task keeps the tokens of words it
   has met, in a store of bounded size; only new words go on.
2. *Speculation.* A word is bytes, the last of them marked as its end. Greedy longest
   match proposes tokens, of those that merging makes out of their own bytes.
3. *Verification.* A sequence is what merging gives if each adjacent pair would be left
   alone: undo the merges of both sides from the last one back, and see whether the
   two parts that touch would have merged before either was used up. All pairs of all
   new words are tested at once in numpy, one undone merge in a step.
4. *Exact merging* by a heap, least rank first and leftmost of equals, of the words with
   a pair that fails.

This holds where each merge builds on earlier ones and no token has two merges, which
is checked when a file is read.

Decoding gives what the library's ``decode`` gives (tokens joined by blanks, since the
file names no decoder), and ``words_of`` the words in plain characters.

Defined results: null and empty texts have no tokens; texts of any length are whole
(tasks hold one batch, of few rows, and words of any length); repeated rows and rows
without an id are rows each; other columns take no part; no rows give none.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peneira.llm.common import utf8

END = "</w>"
#: Words whose tokens a task keeps, of at most so many bytes each.
KEPT_WORDS, KEPT_BYTES = 200_000, 48
#: Characters of texts worked on at once.
PART = 1 << 21
BEYOND = 0x10000
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"


def byte_signs() -> dict[str, int]:
    """The sign that stands for each byte: printable ones for themselves, the others from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = (b for b in range(256) if b not in own)
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Tokens and merges of a file, and the test of pairs."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        signs = byte_signs()
        size = max(vocab.values()) + 1
        self.strings = [""] * size
        for token, i in vocab.items():
            self.strings[i] = token
        # by token: its merge's rank, -1 for a single byte, and the two parts
        self.rank, self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.raw: list[tuple[bytes, bool]] = [(b"", False)] * size
        for sign, b in signs.items():
            self.raw[vocab[sign]], self.raw[vocab[sign + END]] = (bytes([b]), False), (bytes([b]), True)
        self.made: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            if self.rank[k] >= 0 or len(self.raw[k][0]) or not self.raw[i][0] or not self.raw[j][0] or self.raw[i][1]:
                raise ValueError(f"merge {rank} does not build on earlier ones, or makes a token anew")
            self.raw[k] = self.raw[i][0] + self.raw[j][0], self.raw[j][1]
            self.rank[k], self.left[k], self.right[k] = rank, i, j
            self.made[i, j] = rank, k
        self.single = [self.raw.index((bytes([b]), False)) for b in range(256)]
        self.single_end = [self.raw.index((bytes([b]), True)) for b in range(256)]
        keys = np.array([i << 32 | j for i, j in self.made], np.int64)
        order = np.argsort(keys)
        self._keys, self._ranks = keys[order], np.array([r for r, _ in self.made.values()], np.int64)[order]
        self.sound = self._sound()
        held = [(i, *self.raw[i]) for i in range(size) if self.sound[i] and self.raw[i][0]]
        self.inner = {raw: i for i, raw, end in held if not end}
        self.last = {raw: i for i, raw, end in held if end}
        self.longest = max(len(raw) for _, raw, _ in held)

    def _meeting(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank at which two tokens merge; beyond all ranks if they don't."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], 1 << 40)

    def compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether merging leaves each pair alone (up to the rank ``until``, if given).

        ``used`` is the rank at which a side's part is used up by its own side. Of equal
        ranks the leftmost merge comes first: one on the left side comes before the
        meeting, one on the right after it.
        """
        a, b = a.copy(), b.copy()
        out = np.ones(len(a), bool)
        used = np.full(len(a), 1 << 39, np.int64) if until is None else until.copy()
        at = np.arange(len(a))
        while len(at):
            x, y = a[at], b[at]
            bad = self._meeting(x, y) < used[at]
            out[at[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            undo_left = rx > ry
            undo_right = ~undo_left & (ry >= 0)
            go = ~bad & (undo_left | undo_right)
            i = at[go & undo_left]
            used[i], a[i] = self.rank[a[i]], self.right[a[i]]
            i = at[go & undo_right]
            used[i], b[i] = self.rank[b[i]] + 1, self.left[b[i]]
            at = at[go]
        return out

    def _sound(self) -> np.ndarray:
        """The tokens that merging makes out of their own bytes."""
        made = np.flatnonzero(self.rank >= 0)
        fine = self.compatible(self.left[made], self.right[made], self.rank[made])
        out = np.array([bool(raw) for raw, _ in self.raw])
        for i in np.argsort(self.rank[made], kind="stable"):
            k = made[i]
            out[k] = fine[i] and out[self.left[k]] and out[self.right[k]]
        return out

    def greedy(self, word: bytes) -> list[int]:
        """Longest matches from the left; the last token ends the word."""
        out, at, n = [], 0, len(word)
        while True:
            if n - at <= self.longest and (whole := self.last.get(word[at:])) is not None:
                out.append(whole)
                return out
            for size in range(min(self.longest, n - at - 1), 0, -1):
                token = self.inner.get(word[at : at + size])
                if token is not None:
                    out.append(token)
                    at += size
                    break

    def merged(self, word: bytes) -> list[int]:
        """Exact merging: least rank first, leftmost of equals."""
        tokens = [self.single[b] for b in word[:-1]] + [self.single_end[word[-1]]]
        n = len(tokens)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*self.made[p], i, *p) for i, p in enumerate(zip(tokens[:-1], tokens[1:], strict=True)) if p in self.made]
        heapq.heapify(heap)
        while heap:
            _, made, i, a, b = heapq.heappop(heap)
            j = after[i]
            if tokens[i] != a or j >= n or tokens[j] != b:
                continue
            tokens[i], tokens[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (p := (made, tokens[k])) in self.made:
                    heapq.heappush(heap, (*self.made[p], i, *p))
            if (h := before[i]) >= 0 and (p := (tokens[h], made)) in self.made:
                heapq.heappush(heap, (*self.made[p], h, *p))
        return [t for t in tokens if t >= 0]

    def encode(self, words: list[bytes]) -> tuple[list[list[int]], int]:
        """Tokens of words, none of them empty; and how many had to be merged."""
        proposed = [self.greedy(w) for w in words]
        sizes = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((t for p in proposed for t in p), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        pairs = np.flatnonzero(owner[1:] == owner[:-1])
        kinds, back = np.unique(flat[pairs] << 32 | flat[pairs + 1], return_inverse=True)
        failing = pairs[~self.compatible(kinds >> 32, kinds & 0xFFFFFFFF)[back]]
        wrong = np.unique(owner[failing])
        for i in wrong:
            proposed[i] = self.merged(words[i])
        return proposed, len(wrong)


def _ranges(codes: list[int]) -> str:
    """A character class of code points in order."""
    out, low = [], None
    for i, c in enumerate(codes):
        low = c if low is None else low
        if i + 1 == len(codes) or codes[i + 1] != c + 1:
            out.append(f"\\U{low:08x}-\\U{c:08x}")
            low = None
    return "".join(out)


class Words:
    """Cuts texts into words as the file says."""

    def __init__(self, path: str):
        from tokenizers import Regex, Tokenizer
        from tokenizers.normalizers import Replace

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.normalizer = Tokenizer.from_file(path).normalizer
        steps = made["pre_tokenizer"]["pretokenizers"]
        expected = ENDINGS + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        if [s["type"] for s in steps] != ["Split", "ByteLevel"] or steps[0]["pattern"] != {"Regex": expected} or made["decoder"] is not None:
            raise ValueError("a tokenizer file of another kind")
        every = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
        classes = [Replace(Regex(other + "+"), "").normalize_str(every) for other in (r"[^\p{L}]", r"[^\p{N}]", r"[\s\p{L}\p{N}]")]
        form = ENDINGS + "|[{}]+|[{}]|[{}]+"
        self.flat = re.compile(form.format(*(_ranges([c for c in map(ord, x) if c < BEYOND]) for x in classes)))
        self.everywhere = re.compile(form.format(*(_ranges(list(map(ord, x))) for x in classes)))
        self.beyond = re.compile("[\U00010000-\U0010ffff]")
        # what this Python's Unicode doesn't know yet, and the rarer planes
        self.rare = re.compile(f"[^{_ranges([c for c in map(ord, every) if c < BEYOND and unicodedata.category(chr(c)) != 'Cn'])}]")
        self.special = {t["content"]: t["id"] for t in made["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def normal(self, text: str) -> str:
        """The file's normal form, but for white space, which no word has."""
        if text.isascii():
            return text.lower()
        if self.rare.search(text):
            return self.normalizer.normalize_str(text)
        # a sigma at a word's end is no special case here
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def of(self, text: str) -> list[str | int]:
        """Words, and numbers of special tokens."""
        if self.cut is None or "<" not in text:
            return self._of(text)
        out: list[str | int] = []
        for i, part in enumerate(self.cut.split(text)):
            out += [self.special[part]] if i % 2 else self._of(part)
        return out

    def _of(self, text: str) -> list[str]:
        text = self.normal(text)
        return (self.everywhere if self.beyond.search(text) else self.flat).findall(text)


class Coder:
    """Encodes and decodes by a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.words = Words(path)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in made["model"]["merges"]]
        self.merges = Merges(made["model"]["vocab"], pairs)
        self.strings = dict(enumerate(self.merges.strings)) | {t["id"]: t["content"] for t in made["added_tokens"]}
        self.known: dict[str, list[int]] = {}
        self.met = self.failed = 0

    def encode(self, texts: list[str]) -> list[list[int]]:
        parts = [self.words.of(t) for t in texts]
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        known = self.known
        new = list({w for words in parts for w in words if w not in known and not isinstance(w, int)})
        found, failed = self.merges.encode([w.encode() for w in new]) if new else ([], 0)
        self.met, self.failed = self.met + len(new), self.failed + failed
        known.update(zip(new, found, strict=True))
        out = []
        for words in parts:
            ids: list[int] = []
            for w in words:
                if w.__class__ is int:
                    ids.append(w)
                else:
                    ids += known[w]
            out.append(ids)
        for w in new:
            if len(w) > KEPT_BYTES:
                del known[w]
        return out

    def decode(self, ids: list[int]) -> str:
        """As the library does for a file without a decoder."""
        return " ".join(map(self.strings.__getitem__, ids))

    def words_of(self, ids: list[int]) -> str:
        """Words in plain characters, a blank between them; bytes that are no character are replaced."""
        out = []
        for i in ids:
            raw, end = self.merges.raw[i] if i < len(self.merges.raw) else (self.strings[i].encode(), True)
            out.append(raw + (b" " if end else b""))
        return b"".join(out).decode("utf-8", "replace").rstrip(" ")


@cache
def coder(path: str) -> Coder:
    """One for each worker and file."""
    return Coder(path)


def _run(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = coder(path)
        for batch in batches:
            texts = utf8(batch.column(1))
            low = 0
            while low < batch.num_rows:
                high, size = low, 0
                some = []
                while high < batch.num_rows and (not some or size < PART):
                    some.append(texts[high].as_py())
                    size += len(some[-1])
                    high += 1
                ids = made.encode(some)
                at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.fromiter((t for x in ids for t in x), np.int32, int(at[-1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.ListArray.from_arrays(pa.array(at), pa.array(flat)), pa.array([made.decode(x) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])
                low = high

    return run


def encode_decode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, its token ids, and what they decode to. ``path`` must be there on the executors."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_run(path), "doc_id long, ids array<int>, decoded string")


def digests(coded: DataFrame) -> DataFrame:
    """Per document: doc_id, n_tokens, and the SHA-256 of its ids and of what they decode to."""
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
