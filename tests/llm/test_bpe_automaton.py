"""The automaton against the tokenizers library, and against merging pairs by hand."""

import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from readprism.llm import bpe_automaton as B
from readprism.llm import queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def automaton():
    return B.load(PATH)


def ids_of(automaton, text):
    return np.frombuffer(automaton.encode(text), np.int32)


def test_random_texts(automaton, library):
    rng = random.Random(1)
    letters = "aabbcde  \n\t'stné漢😀١٣ ́‍\x00​ <|endoftext|>Ᲊ\U000323b0\U0001e5d0"
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 3, 10, 40]))) + rng.choice(["", "<|endoftext|>", " " + "a" * rng.randint(1, 70), "=" * rng.randint(1, 99), " don't we'LL"])
        expected = library.encode(text, add_special_tokens=False).ids
        got = ids_of(automaton, text)
        assert got.tolist() == expected
        assert automaton.decode(got, np.array([0, len(got)])).to_pylist() == [text]


def test_any_ids_decode_like_the_library(automaton, library):
    rng = random.Random(2)
    rows = [[rng.randrange(50_257) for _ in range(rng.randint(0, 12))] for _ in range(500)]
    flat, bounds = np.array([t for r in rows for t in r]), np.cumsum([0, *map(len, rows)])
    assert automaton.decode(flat, bounds).to_pylist() == [library.decode(r, skip_special_tokens=False) for r in rows]
    assert automaton.decode(np.array([64, 99_999, -1, 65]), np.array([0, 4])).to_pylist() == ["ab"]


def merged(word, merges):
    """A word's tokens by applying each merge in turn, from left to right."""
    parts = list(word)
    for a, b in merges:
        i = 0
        while i < len(parts) - 1:
            if (parts[i], parts[i + 1]) == (a, b):
                parts[i : i + 2] = [a + b]
            i += 1
    return parts


def test_small_vocabularies():
    """All words of up to seven letters, for merges drawn as training would; and each word has one path only."""
    rng = random.Random(5)
    for _ in range(25):
        parts, merges = ["a", "b", "c"], []
        while len(merges) < 9:
            pair = (rng.choice(parts), rng.choice(parts))
            if "".join(pair) not in parts:
                merges.append(pair)
                parts.append("".join(pair))
        number = {p: i for i, p in enumerate(parts)}
        own = B.compile_merges([p.encode() for p in parts], [0, 1, 2], [(number[a], number[b], number[a + b]) for a, b in merges], {})
        assert own.states <= len(parts) + 1
        for n in range(1, 7):
            for k in range(3**n):
                word = "".join("abc"[k // 3**i % 3] for i in range(n))
                path = own.path(word.encode()).tolist()
                assert [parts[t] for t in path] == merged(word, merges)
                state = 0
                for t in path:
                    assert own.has_arc(state, t)
                    state = own.target[t]


def test_operator(spark, automaton, library):
    long = "naïve wörds, repeated! " * 20_000
    rows = [(1, None, "x"), (2, "", "x"), (3, long, None), (3, long, None), (4, "x<|endoftext|>y", "z"), (None, " \n ", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encoded = B.encode(docs, automaton)
    assert encoded.columns == ["doc_id", "text", "ids", "ids_"]
    for r in B.decode(encoded, automaton, "ids_").collect():
        assert r["ids_"] == library.encode(r["text"] or "", add_special_tokens=False).ids and r["decoded"] == (r["text"] or "")
    both = B.encode(docs, automaton, decoded=True)
    assert sorted(map(str, both.collect())) == sorted(map(str, B.decode(encoded, automaton, "ids_").collect())) and both.columns[-1] == "decoded"
    assert encoded.where("false").count() == 0 and B.encode(docs.where("false"), automaton).collect() == []
    nulls = spark.createDataFrame([(1, None), (2, [64, None, 65])], "k long, ids array<int>")
    assert {r["k"]: r["decoded"] for r in B.decode(nulls, automaton).collect()} == {1: "", 2: "ab"}


def test_query(spark, library):
    sf_dir = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = queries.op12_bpe_automaton(spark, sf_dir).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_other_tokenizers_are_refused(tmp_path):
    with pytest.raises(ValueError):
        B.load(public_tokenizers.path("word_bpe_49k.json"))
    spec = json.load(open(PATH, encoding="utf-8"))
    spec["added_tokens"][0]["lstrip"] = True
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="rules of its own"):
        B.load(str(tmp_path / "t.json"))
