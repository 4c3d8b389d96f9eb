import hashlib
import random
import time

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe
from tests.llm.helpers import DOC_SCHEMA, documents, edge_texts


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def vocabulary():
    with open(bpe.default_path(), encoding="utf-8") as f:
        return bpe.Vocabulary(f.read())


TEXTS = [
    "Hello  WORLD's it'll 123 été ΑΣ <|endoftext|> a<|startoftext|>b <|end", " x\x85y z İstanbul ǅ ﬁ ẞ", "日本語 テスト 🎉🎉 ---!!", "é é ẛ̣", "'S 'LL don't", "x\u200by ٣٤ Ⅷ ½", "a" * 300, "!" * 200, "mississippi banana",
]


def test_words_merge_as_in_the_library(library, vocabulary):
    rng = random.Random(3)
    texts = TEXTS + ["".join(chr(rng.choice([rng.randint(0, 127), rng.randint(0, 0x24F), rng.randint(0x370, 0x3FF), rng.randint(0x4E00, 0x9FFF)])) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    for t in texts:
        words = vocabulary.words(t)
        ids = library.encode(t, add_special_tokens=False).ids
        assert [i for w in vocabulary.merge_all(words) for i in w] == ids == [i for w in words for i in vocabulary.merge(w)], t


def test_automaton_is_minimal_and_exact(tmp_path):
    rng = random.Random(4)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))).encode(): (i, i + 1)[: 1 + i % 2] for i in range(400)}
    arrays = bpe.compile_lexicon(words)
    (tmp_path / "x").write_bytes(bpe.file_bytes(arrays))
    lexicon = bpe.Lexicon(str(tmp_path / "x"))
    assert isinstance(lexicon.keys, np.memmap)
    trial = [*words, *(w + b"c" for w in words), b"", b"zz"]
    assert lexicon.find(trial) == [words.get(w) for w in trial]
    futures = set()
    for w in [b"", *words]:
        for k in range(len(w) + 1):
            futures.add(frozenset(x[k:] for x in words if x.startswith(w[:k])))
    assert len(arrays["accepts"]) == len(futures)
    assert bpe.Lexicon(_saved(tmp_path, {})).find([b"a"]) == [None]


def _saved(tmp_path, words):
    (tmp_path / "y").write_bytes(bpe.file_bytes(bpe.compile_lexicon(words)))
    return str(tmp_path / "y")


def test_query_equals_the_library(spark, library):
    texts = edge_texts() + TEXTS
    rows = {r["doc_id"]: r for r in bpe.encode(documents(spark, texts), keep=True).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        r = rows[i]
        assert (r["n_tokens"], r["ids"], r["decoded"]) == (len(ids), ids, decoded)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.encode(spark.createDataFrame([], DOC_SCHEMA)).count() == 0


def test_frequent_words_are_bounded(spark):
    counts = spark.createDataFrame([(f"w{i}", 1000 - i) for i in range(100)] + [(f"r{i}", 1) for i in range(500)], "word string, n long")
    assert 0 < len(bpe.frequent(counts, 100)) <= 100 and set(bpe.frequent(counts, 100)) <= {f"w{i}" for i in range(100)}
    assert bpe.frequent(counts.filter("n = 1"), 100) == [] and len(bpe.frequent(counts, 1000)) == 600


def test_long_words_take_n_log_n_steps(library, vocabulary):
    rng = random.Random(6)
    for letters, n in (("ab", 300), ("aab", 700), ("abcdefghijklmnopqrstuvwxyz", 2000), ("éü日本", 500)):
        word = "".join(rng.choice(letters) for _ in range(n))
        assert vocabulary.merge(word) == vocabulary.merge_plainly(word) == tuple(library.encode(word, add_special_tokens=False).ids)
    word = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    began = time.process_time()
    ids = vocabulary.merge(word)
    assert time.process_time() - began < 60 and "".join(vocabulary.names[i] for i in ids) == word + bpe.END
    assert ids[:1000] == tuple(library.encode(word, add_special_tokens=False).ids)[:1000]
    with pytest.raises(ValueError, match="isn't one of BPE"):
        bpe.Vocabulary('{"model": {"type": "Unigram"}, "decoder": null}')


def test_letters_of_any_unicode_version_give_the_library_s_ids(library, vocabulary):
    later = [c for a, b in bpe._LATER for c in range(a, b + 1)]
    near = [c for a, b in bpe._LATER for c in (a - 1, b + 1)]
    texts = [f"aB{chr(c)}Cd {chr(c)}{chr(c)}" for c in [*later, *near, *range(0x80, 0x2000)]]
    words = [vocabulary.words(t) for t in texts]
    merged = iter(vocabulary.merge_all([w for ws in words for w in ws]))
    for t, ws, e in zip(texts, words, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert [i for _ in ws for i in next(merged)] == e.ids, ascii(t)
