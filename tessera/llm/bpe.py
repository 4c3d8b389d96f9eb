"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The words of all texts are counted; the most frequent ones are merged once on the driver and compiled into a minimal acyclic automaton
(states with equal futures are shared), whose arcs carry how many accepted words precede them, so that a walk ends at the word's
number and that leads to its ids. The arrays are one file that Spark hands to each executor; Python
workers map it into memory. A batch's different words are walked together; a word that the automaton lacks is merged exactly by
rank. Results don't depend on the lexicon.

Texts are prepared as the vocabulary file says: its special tokens are cut out of the raw text, the rest is put in NFC, runs of white space become a blank,
letters are lower-cased one by one, and the file's pattern gives the words. Decoding joins the tokens with blanks, for
the file names no decoder.

Defined results: null and empty texts, and those of white space alone, have no ids and decode to the empty string; repeated
rows give equal rows; an empty table gives an empty result; other columns are ignored. Memory is bounded by a batch, its words, and ``CACHED`` words a worker.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import os
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, drop_cut, put, table

LEXICON_WORDS, CACHED, LONGEST, END = 32_768, 200_000, 64, "</w>"
NO_RANK, TOGETHER, PIECE = np.int32(1 << 30), 200_000, 4 << 20
#: White space as Unicode defines it.
_SPACE = regex.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
_LATIN_SPACE = re.compile("[\t-\r\x85\xa0]")
#: The same pattern for letters and numbers of Latin scripts, which Python's own engine finds faster, and what lies outside them.
_LATIN_L, _LATIN_N = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u02af", "0-9\xb2\xb3\xb9\xbc-\xbe"
_LATIN_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN_L}]+|[{_LATIN_N}]|[^ {_LATIN_L}{_LATIN_N}]+")
_NOT_LATIN = re.compile("[^\x00-\u0233\u2010-\u2027\u2030-\u205e]")
_PLAIN_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
#: Capitals whose lower case Unicode defined after Python's tables, single ones and runs at one distance.
_NEW_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
_NEW_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
_NEW = re.compile("[" + "".join(map(chr, _NEW_LOWER)) + "]")
#: Letters and numbers that Unicode assigned after the library's tables, which takes them for neither; a newer regex module knows them.
_LATER = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7),
    (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F),
    (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24),
    (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED),
    (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
]
_LATER_LETTER = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _LATER) + "]")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


class Vocabulary:
    """A BPE vocabulary with word ends, as a tokenizers file describes it."""

    def __init__(self, text: str):
        data = json.loads(text)
        model = data["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END or data["decoder"] is not None:
            raise ValueError("the file isn't one of BPE with word ends and no decoder")
        self.ids = model["vocab"]
        self.names = {i: t for t, i in self.ids.items()}
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): r for r, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.names.update({i: t for t, i in self.special.items()})
        self.numbers = {i: str(i) for i in self.names}
        self._cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in data["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._word = regex.compile(pattern)
        self._letters = byte_letters()
        # For merging many words at once: the first symbols of bytes within and at the end of a word, and merges sorted by pair.
        self._inner = np.array([self.ids.get(c, -1) for c in self._letters], np.int32)
        self._last = np.array([self.ids.get(c + END, -1) for c in self._letters], np.int32)
        merges = [(self.ids[a] << 16 | self.ids[b], r, self.ids[a + b]) for (a, b), r in self.ranks.items()]
        merges.sort()
        self._pairs = np.array([m[0] for m in merges], np.uint32)
        self._rank_of = np.array([m[1] for m in merges], np.int32)
        self._made = np.zeros(len(merges) + 1, np.int32)
        self._made[self._rank_of] = [m[2] for m in merges]
        # The same as plain Python values, for one word at a time.
        self._rank_of_pair, self._made_list = {int(m[0]): m[1] for m in merges}, self._made.tolist()

    def _pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.uint32) << np.uint32(16)) | b.astype(np.uint32)
        at = np.minimum(np.searchsorted(self._pairs, key), len(self._pairs) - 1)
        return np.where(self._pairs[at] == key, self._rank_of[at], NO_RANK)

    def merge_all(self, words: list[str]) -> list[tuple[int, ...]]:
        """merge() of each word. Words of one length form a matrix; in each round every row merges its first pair of least rank, so
        all rows that go on stay of one length. Long and special words are merged on their own."""
        out: list = [None] * len(words)
        raw = [w.encode("utf-8") for w in words]
        by_length: dict[int, list[int]] = {}
        for i, x in enumerate(raw):
            if len(x) > LONGEST or words[i] in self.special:
                out[i] = self.merge(words[i])
            else:
                by_length.setdefault(len(x), []).append(i)
        for n, places in by_length.items():
            at = np.array(places)
            text = np.frombuffer(b"".join([raw[i] for i in places]), np.uint8).reshape(-1, n)
            symbols = self._inner[text]
            symbols[:, -1] = self._last[text[:, -1]]
            ranks = self._pair_ranks(symbols[:, :-1], symbols[:, 1:]) if n > 1 else None
            while len(at):
                width = symbols.shape[1]
                if width > 1:
                    best = ranks.argmin(1)
                    rows = np.arange(len(at))
                    least = ranks[rows, best]
                    over = least == NO_RANK
                else:
                    over = np.ones(len(at), bool)
                if over.any():
                    for i, ids in zip(at[over].tolist(), symbols[over].tolist(), strict=True):
                        out[i] = tuple(ids)
                    on = ~over
                    at, symbols = at[on], symbols[on]
                    if not len(at):
                        break
                    best, least, ranks, rows = best[on], least[on], ranks[on], np.arange(len(at))
                after = np.arange(width - 1)[None, :] > best[:, None]
                symbols = np.where(after, symbols[:, 1:], symbols[:, :-1])
                symbols[rows, best] = self._made[least]
                if width == 2:
                    continue
                ranks = np.where(after[:, :-1], ranks[:, 1:], ranks[:, :-1])
                left = np.flatnonzero(best > 0)
                ranks[left, best[left] - 1] = self._pair_ranks(symbols[left, best[left] - 1], symbols[left, best[left]])
                right = np.flatnonzero(best < width - 2)
                ranks[right, best[right]] = self._pair_ranks(symbols[right, best[right]], symbols[right, best[right] + 1])
        return out

    def words(self, text: str) -> list[str]:
        """The words of a text; special tokens come as themselves."""
        if not text:
            return []
        if self._cut is None or "<|" not in text or not self._cut.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self._cut.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + self._plain(text[at:])

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return _PLAIN_WORD.findall(text.lower())
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # A final sigma has no form of its own when letters are lower-cased one by one.
        if not _NOT_LATIN.search(text):
            return _LATIN_WORD.findall(_LATIN_SPACE.sub(" ", text).lower())
        text = _SPACE.sub(" ", text).replace("Σ", "σ").lower()
        text = text.translate(_NEW_LOWER) if _NEW.search(text) else text
        if not _LATER_LETTER.search(text):
            return self._word.findall(text)
        # A character that no tables know stands in for the later letters while the words are found.
        return [text[m.start() : m.end()] for m in self._word.finditer(_LATER_LETTER.sub("\uffff", text))]

    def merge(self, word: str) -> tuple[int, ...]:
        """The ids of one word: the pair of least rank is merged until none is left; of equal pairs the first comes first.

        Symbols are a linked list and pairs wait in a heap, so a word of n bytes takes n log n steps."""
        if word in self.special:
            return (self.special[word],)
        raw = np.frombuffer(word.encode("utf-8"), np.uint8)
        first = self._inner[raw]
        first[-1] = self._last[raw[-1]]
        ranks = self._pair_ranks(first[:-1], first[1:])
        heap = [(int(ranks[i]), i) for i in np.flatnonzero(ranks < NO_RANK).tolist()]
        heapq.heapify(heap)
        symbols, after, before = first.tolist(), list(range(1, len(first) + 1)), list(range(-1, len(first) - 1))
        rank_of, made, end = self._rank_of_pair, self._made_list, len(first)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if symbols[i] is not None else end
            # A pair that one of its symbols has left since it was pushed has another rank, or none.
            if j >= end or rank_of.get(symbols[i] << 16 | symbols[j]) != rank:
                continue
            symbols[i], symbols[j] = made[rank], None
            after[i] = k = after[j]
            if k < end:
                before[k] = i
                if (r := rank_of.get(symbols[i] << 16 | symbols[k])) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := rank_of.get(symbols[h] << 16 | symbols[i])) is not None:
                heapq.heappush(heap, (r, h))
        return tuple(s for s in symbols if s is not None)

    def merge_plainly(self, word: str) -> tuple[int, ...]:
        """merge() by its definition, for tests."""
        if word in self.special:
            return (self.special[word],)
        parts = [self._letters[b] for b in word.encode("utf-8")]
        parts[-1] += END
        rank = self.ranks.get
        while len(parts) > 1:
            least, at = min(((rank(pair, 1 << 30), i) for i, pair in enumerate(zip(parts, parts[1:]))))
            if least == 1 << 30:
                break
            a, b = parts[at], parts[at + 1]
            out, i = [], 0
            while i < len(parts):
                if parts[i] == a and i + 1 < len(parts) and parts[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return tuple(self.ids[p] for p in parts)


def compile_lexicon(entries: dict[bytes, tuple[int, ...]]) -> dict[str, np.ndarray]:
    """Minimal acyclic automaton of the words: arcs sorted by state and byte, the number of words an arc skips, and the ids by word number.

    Words come in order, so all but the path of the last word is final and is folded into states that are there already.
    """
    known: dict[tuple, int] = {}
    arcs: list[tuple] = []  # by state: (accepts, ((byte, state), ...))
    counts: list[int] = []

    def close(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in known:
            known[key] = len(arcs)
            arcs.append(key)
            counts.append(node[0] + sum(counts[t] for _, t in node[1]))
        return known[key]

    path, last = [[0, []]], b""
    for word in sorted(entries):
        same = len(os.path.commonprefix([word, last]))
        while len(path) > same + 1:
            state = close(path.pop())
            path[-1][1].append((last[len(path) - 1], state))
        path += [[0, []] for _ in word[same:]]
        path[-1][0] = 1
        last = word
    while len(path) > 1:
        state = close(path.pop())
        path[-1][1].append((last[len(path) - 1], state))
    root = close(path[0])
    keys, targets, skips = [], [], []
    for state, (accepts, out) in enumerate(arcs):
        before = accepts
        for byte, target in out:
            keys.append(state * 256 + byte)
            targets.append(target)
            skips.append(before)
            before += counts[target]
    ids = [entries[w] for w in sorted(entries)]
    starts = np.cumsum([0, *map(len, ids)])
    flat = [i for w in ids for i in w]
    arrays = {"keys": keys, "targets": targets, "skips": skips, "accepts": [a for a, _ in arcs], "starts": starts, "ids": flat, "root": [root]}
    return {k: np.asarray(v, np.int64 if k == "keys" else np.int32) for k, v in arrays.items()}


def file_bytes(arrays: dict[str, np.ndarray]) -> bytes:
    """One file: a line of JSON with the arrays' names, types and lengths, then the arrays, each at a multiple of 8."""
    head = json.dumps([[k, str(v.dtype), len(v)] for k, v in arrays.items()]).encode()
    parts = [head + b" " * (-(len(head) + 1) % 8) + b"\n"]
    for v in arrays.values():
        data = v.tobytes()
        parts.append(data + b"\0" * (-len(data) % 8))
    return b"".join(parts)


class Lexicon:
    """The automaton, mapped from its file."""

    def __init__(self, path: str):
        whole = np.memmap(path, np.uint8, "r")
        with open(path, "rb") as f:
            head = f.readline()
        at = len(head)
        for name, kind, n in json.loads(head):
            size = n * np.dtype(kind).itemsize
            setattr(self, name, whole[at : at + size].view(kind))
            at += size + -size % 8

    def find(self, words: list[bytes]) -> list[tuple[int, ...] | None]:
        """The ids of each word, or None: all words walk in step, a byte at a time."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        text = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lengths) - lengths
        state, number, alive = np.full(n, self.root[0], np.int64), np.zeros(n, np.int64), np.arange(n)
        done = np.zeros(n, bool)
        step = 0
        while len(alive) and len(self.keys):
            ended = lengths[alive] == step
            over = alive[ended]
            done[over] = self.accepts[state[over]] > 0
            alive = alive[~ended]
            key = state[alive] * 256 + text[starts[alive] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            goes = self.keys[at] == key
            alive, at = alive[goes], at[goes]
            state[alive] = self.targets[at]
            number[alive] += self.skips[at]
            step += 1
        found: list = [None] * n
        for i in np.flatnonzero(done).tolist():
            a, b = self.starts[number[i]], self.starts[number[i] + 1]
            found[i] = tuple(self.ids[a:b].tolist())
        return found


@functools.lru_cache(2)
def _vocabulary(text: str) -> Vocabulary:
    return Vocabulary(text)


class Encoder:
    """Texts to ids and decoded texts, by words; a word's strings are kept until there are ``CACHED`` of them."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None):
        self.vocabulary, self.lexicon, self.of, self.named = vocabulary, lexicon, {}, {}

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.of]
        if len(self.of) + len(new) > CACHED:
            self.of, self.named, new = {}, {}, list(words)
        found = self.lexicon.find([w.encode() for w in new]) if self.lexicon and new else [None] * len(new)
        unseen = [w for w, ids in zip(new, found, strict=True) if ids is None]
        made = iter(self.vocabulary.merge_all(unseen))
        name, number = self.vocabulary.names.__getitem__, self.vocabulary.numbers.__getitem__
        for w, ids in zip(new, found, strict=True):
            ids = next(made) if ids is None else ids
            self.of[w], self.named[w] = " ".join(map(number, ids)), " ".join(map(name, ids))

    def encode(self, texts: list[str | None]) -> Iterator[tuple[str, str]]:
        """For each text the ids, decimal, joined by blanks, and the decoded text. Texts are taken together, some ``TOGETHER`` words at a time."""
        held, size = [], 0
        for i, text in enumerate(texts):
            held.append(self.vocabulary.words(text or ""))
            size += len(held[-1])
            if size >= TOGETHER or i == len(texts) - 1:
                self.learn({w for ws in held for w in ws})
                of, named = self.of.__getitem__, self.named.__getitem__
                for ws in held:
                    yield " ".join(map(of, ws)), " ".join(map(named, ws))
                held, size = [], 0


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _encoder(text: str, name: str) -> Encoder:
    """The worker's encoder for one vocabulary and lexicon file; one is kept at a time."""
    key = (hashlib.sha256(text.encode()).hexdigest(), name)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(_vocabulary(text), Lexicon(SparkFiles.get(name)))
    return _ENCODERS[key]


def word_counts(df: DataFrame, text_col: str, vocabulary_text) -> DataFrame:
    """word, n over all texts; counts are summed within a batch before they are dealt out."""

    def run(batches):
        words = _vocabulary(vocabulary_text.value).words
        for b in batches:
            seen: Counter = Counter()
            for t in b.column(0):
                seen.update(words(t.as_py() or ""))
            yield pa.RecordBatch.from_pydict({"word": list(seen), "n": pa.array(list(seen.values()), pa.int64())}, schema=schema)

    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
    return df.select(F.col(text_col).alias("t")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, size: int) -> list[str]:
    """The words above the least frequency, in eighths of powers of two, that at most ``size`` words reach. A histogram of some 500 bins
    finds it, so no task and no driver gets more than ``size`` words."""
    level = F.floor(8 * F.log2("n")).cast("int")
    bins = sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).collect(), key=lambda r: -r["level"])
    least, total = None, 0
    for r in bins:
        total += r["words"]
        if total > size:
            break
        least = r["level"]
    return [] if least is None else [r["word"] for r in counts.filter(level >= least).select("word").collect()]


def lexicon_file(df: DataFrame, text_col: str, vocabulary: Vocabulary, vocabulary_text, size: int = LEXICON_WORDS) -> str:
    """Compiles the most frequent words of df, ``size`` at most, and hands the file to the executors; returns its name."""
    counts = cut(word_counts(df, text_col, vocabulary_text))
    top = frequent(counts, size)
    drop_cut(counts)
    arrays = compile_lexicon({w.encode(): ids for w, ids in zip(top, vocabulary.merge_all(top), strict=True)})
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    df.sparkSession.sparkContext.addFile(put(df.sparkSession, name, file_bytes(arrays)))
    return name


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of some ``PIECE`` bytes of text, so that a worker holds the ids of no more than that."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    cuts = [0, *(np.flatnonzero(np.diff(size // PIECE)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, keep: bool | tuple[str, ...] = False) -> DataFrame:
    """One row per row of df: id, n_tokens, ids_sha256, decoded_sha256; with keep also ids (array) and decoded, or those of them that it names."""
    spark = df.sparkSession
    kept = [n for n in ("ids", "decoded") if keep is True or keep and n in keep]
    with open(path or default_path(), encoding="utf-8") as f:
        text = f.read()
    shared = spark.sparkContext.broadcast(text)  # as large as the vocabulary file
    name = lexicon_file(df, text_col, _vocabulary(text), shared)

    def numbers(lists: list[str]) -> pa.Array:
        parts = [np.fromstring(i, np.int32, sep=" ") if i else np.zeros(0, np.int32) for i in lists]
        ends = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)))

    def run(batches):
        encoder = _encoder(shared.value, name)
        for batch in batches:
            for b in _pieces(batch):
                ids, decoded = map(list, zip(*encoder.encode(b.column(1).to_pylist()), strict=True))
                digests = [pa.array([hashlib.sha256(x.encode()).hexdigest() for x in column], pa.string()) for column in (ids, decoded)]
                columns = [b.column(0), pa.array([i.count(" ") + 1 if i else 0 for i in ids], pa.int64()), *digests]
                columns += [numbers(ids) if n == "ids" else pa.array(decoded, pa.string()) for n in kept]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "ids_sha256", "decoded_sha256", *kept])

    slim = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    more = "".join({"ids": ", ids array<int>", "decoded": ", decoded string"}[n] for n in kept)
    return slim.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + more).withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
