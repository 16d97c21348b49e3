import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from glyphmill.llm import hot_keys
from glyphmill.llm import prefix_trie as P

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def digest(turn):
    role, text = turn
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn, (role or "", text or "")))
    for conv, turns in own.items():
        own[conv] = [t for _, t in sorted(turns, key=lambda r: (r[0] is not None, r[0] or 0, digest(r[1])))]
    members = defaultdict(list)
    paths = {}
    for conv in list(own):
        h = zlib.crc32(str(conv).encode()) % 6
        first = conv - (abs(conv) % 100) * (1 if conv >= 0 else -1)
        paths[conv] = tuple(own.get(first, [])[:h] + own[conv][h:])
        for d in range(len(paths[conv]) + 1):
            members[paths[conv][:d]].append(conv)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[c] for c in children[node]) + (not children[node])
        saved[node] = sum(saved[c] for c in children[node]) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(paths[c]) == len(node))
        out.append(
            (min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children[node]), leaves[node], saved[node],
             hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(out, key=str)


def found(spark, rows, schema=SCHEMA):
    table = spark.createDataFrame(rows, schema).repartition(5)
    return sorted((tuple(r) for r in P.nodes(table).select(*P.RESULT).collect()), key=str)


def conversations(count, seed, words=3, longest=9):
    rng = random.Random(seed)
    says = [("user", "é" * k + "x") for k in range(words)] + [("assistant", "y" * k) for k in range(words)]
    ids = rng.sample(range(-150, 3 * count), count)
    return [(conv, turn, *rng.choice(says)) for conv in ids for turn in range(rng.randint(1, longest))]


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed):
    rows = conversations(300, seed)
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("shard", [1, 7, 40])
def test_many_shards_merge(spark, monkeypatch, shard):
    """Hot prefixes and equal conversations spread over shards and tasks."""
    monkeypatch.setattr(P, "SHARD", shard)
    monkeypatch.setattr(P, "PARTITION", 200)
    rows = conversations(150, shard, words=1, longest=12)
    rows += [(conv, turn, "user", f"same {turn}") for conv in range(5000, 5100) for turn in range(10)]
    assert found(spark, rows) == brute(rows)


def test_hot_parents_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(hot_keys, "HOT", 5)
    monkeypatch.setattr(hot_keys, "MOST", 50)
    monkeypatch.setattr(P, "SHARD", 30)
    rows = conversations(120, 4, words=20)
    assert found(spark, rows) == brute(rows)


def test_defined_cases(spark):
    rows = [
        (1, None, "user", "first"), (1, 0, None, None), (1, 0, "user", "b"), (1, 0, "user", "b"), (1, 5, "a", "x" * 100_000),
        (None, 0, "user", "lost"), (100, 0, "", ""), (101, 0, "u", "𝄞𝄞"), (102, 0, "u", "𝄞𝄞"), (199, 1, None, "z"),
        (-5, 0, "u", "n"), (-100, 0, "u", "n"),
    ]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    wide = [(*r, 1, b"p", "s", 2) for r in rows]
    assert found(spark, wide, SCHEMA + ", depth int, path binary, of string, first int") == brute(rows)


def test_a_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(P, "SHARD", 500)
    rows = [(conv, turn, "u", f"t{turn}" if turn < 1500 else f"t{turn}-{conv}") for conv in (7, 8, 9) for turn in range(1600 + conv)]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("seed", range(10))
def test_double_array(seed):
    rng = random.Random(seed)
    turns = [bytes([k]) * P.TURN for k in range(rng.choice([2, 5, 200]))]
    paths = sorted(b"".join(rng.choice(turns) for _ in range(rng.randint(0, 6))) for _ in range(400))
    trie = P.DoubleArray(paths)
    prefixes = {p[:k] for p in paths for k in range(0, len(p) + 1, P.TURN)}
    assert len(trie.nodes) == len(set(trie.nodes)) == len(prefixes)
    cells = {p: list(trie.walk(p))[-1] for p in prefixes}
    assert len(set(cells.values())) == len(prefixes) and all(trie.depth[c] * P.TURN == len(p) for p, c in cells.items())
    assert len(trie.check) <= 4 * len(prefixes) + len(turns)
    for path in paths[:50]:
        with pytest.raises(KeyError):
            list(trie.walk(path + bytes([255]) * P.TURN))
