"""The prefix trie against one built turn by turn, with blocks of every size."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from readprism.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string"


def by_hand(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5((hashlib.md5(role.encode()).hexdigest() + hashlib.md5(text.encode()).hexdigest()).encode()).hexdigest()
            own.setdefault(conv, []).append((turn is not None, turn or 0, digest, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    members = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 4
        full = own.get(conv - conv % 20, [])[:h] + turns[h:]
        for d in range(len(full) + 1):
            members.setdefault(tuple(full[:d]), []).append((conv, len(full)))
    children, saved, leaves = {}, {}, {}
    for path in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        saved[path] = saved.get(path, 0) + (len(members[path]) - 1) * words
        leaves[path] = leaves.get(path, 0) or 1
        if path:
            up = path[:-1]
            children[up] = children.get(up, 0) + 1
            saved[up] = saved.get(up, 0) + saved[path]
            leaves[up] = leaves.get(up, 0) + leaves[path]
    out = []
    for path, found in members.items():
        ends = ",".join(str(c) for c, n in sorted(found) if n == len(path))
        up = min(c for c, _ in members[path[:-1]]) if path else None
        out.append((min(c for c, _ in found), len(path), up, len(found), children.get(path, 0), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[:2])


def drawn(rng, n):
    rows = []
    for conv in rng.sample(range(3 * n), n):
        depth = rng.choice([1, 2, 2, 3, 4, 6, 9])
        turns = [(conv, t if rng.random() < 0.9 else None, rng.choice(["user", "bot", None]), rng.choice(["", None, "a", "a b", "one two three"])) for t in range(depth)]
        rows += turns if rng.random() < 0.7 else [(conv, t, "user", "a b") for t in range(depth)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "n", "n_blocks"), [(1, 60, 1), (2, 60, 7), (3, 150, 40), (4, 150, 120), (5, 30, 29), (6, 150, None)])
def test_random(spark, seed, n, n_blocks):
    rows = drawn(random.Random(seed), n)
    assert found(P.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3), n_blocks)) == by_hand(rows)


def test_blocks_without_spark():
    """Every way to cut small tries into blocks of one or two sequences, completed by the minima."""
    rng = random.Random(11)
    for _ in range(200):
        keys = sorted({bytes(b for x in (rng.choice("ab") for _ in range(rng.randint(0, 5))) for b in x.encode() * P.DIGEST) for _ in range(rng.randint(1, 8))})
        cuts = sorted({0, *(i for i in range(1, len(keys)) if rng.random() < 0.6), len(keys)})
        rows = [{"key": k, "words": [1] * (len(k) // P.DIGEST), "cnt": 1, "conv_id": i, "ends": "-"} for i, k in enumerate(keys)]
        shared = [P.common(keys[i - 1], keys[i]) if i else -1 for i in range(len(keys))] + [-1]
        got = [r for j, (a, b) in enumerate(zip(cuts, cuts[1:])) for r in P.block_parts(rows[a:b], j, shared[a], shared[b])]
        whole = P.block_parts(rows, 0, -1, -1)
        assert sum(r["kind"] in ("node", "child", "open") for r in got) == sum(r["kind"] == "node" for r in whole) == 1 + sum(len(k) // P.DIGEST - max(s, 0) for k, s in zip(keys, shared))
        blocks = [r for r in got if r["kind"] == "block"]
        minima = P.Minima(*(np.array([r[c] for r in blocks]) for c in ("first_l", "inner_l", "inner_n", "next_l", "n_convs", "n_leaves", "mass", "fresh", "conv_id")))
        chains = {(r["block"], r["depth"]) for r in got if r["kind"] == "chain"}
        opens = {(r["block"], r["depth"]) for r in got if r["kind"] == "open"}
        assert {(minima.end(b, d), d) for b, d in opens} == chains
        for r in got:
            if r.get("outside"):
                assert (minima.origin(r["block"], r["depth"] - 1), r["depth"] - 1) in opens


def test_copies_and_a_long_conversation(spark):
    rows = [(c, t, "user", f"hello {t}") for c in range(400, 700) for t in range(3)]
    rows += [(1000, t, "user", "x " * (t % 5)) for t in range(900)]
    rows += [(5, None, None, None), (5, None, None, None), (None, 1, "user", "left out"), (-3, 2, "user", "word " * 50_000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", depth int")
    assert found(P.prefix_trie(docs, 11)) == by_hand(rows)


def test_turnless(spark):
    """Conversations that take more turns from an absent one than they have are the root's own members."""
    short = [c for c in range(1, 400) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20]
    rows = [(c, 0, "user", "gone") for c in short[:5]]
    got = found(P.prefix_trie(spark.createDataFrame(rows, SCHEMA)))
    assert got == by_hand(rows) and len(got) == 1 and got[0][3] == 5


def test_no_rows(spark):
    empty = P.prefix_trie(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and empty.columns == P._COLUMNS
    assert P.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).collect() == []
