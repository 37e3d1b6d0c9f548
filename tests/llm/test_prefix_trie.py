from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import corpus_cases as cases
import pytest
from meterbook.llm import prefix_trie
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string, digest string, own string, words string, node string"


def _rows() -> list[tuple]:
    """Conversations that share beginnings: copies, chains that stop at each length, long ones, null parts."""
    rng = random.Random(4)
    lines = [cases.prose(rng, n) for n in (1, 3, 5, 8)]
    rows = []

    def add(conv_id: int | None, texts: list[str | None], first: int | None = 0) -> None:
        for i, t in enumerate(texts):
            rows.append((conv_id, None if i == 0 and first is None else (first or 0) + i, None if t is None else "ab"[i % 2], t))

    for i in range(0, 130):
        add(i, [rng.choice(lines) for _ in range(rng.choice([1, 2, 2, 3, 6]))], rng.choice([None, 0, 5]))
    for i in range(10):
        add(200 + i, ["stem"] * (1 + i))
        add(300 + i, lines * 20)
        add(-100 - 20 * i, [lines[0], None, "", "x"])
    add(400, ["one", "two", "three"])
    add(401, ["only"])
    add(None, ["nobody's"])
    rows += [(500, 1, "a", "twice"), (500, 1, "a", "twice"), (500, 1, "b", "tie"), (500, None, None, None), (1 << 40, 0, "a", "far")]
    rng.shuffle(rows)
    return rows


def _expected(rows: list[tuple], stride: int | None, most: int) -> Counter:
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            turns[c].append(((turn is not None, turn or 0), role, digest, text))
    rebuilt = {}
    for c, own in turns.items():
        own.sort(key=lambda t: t[:3])
        h = zlib.crc32(str(c).encode()) % most if stride else 0
        base = c - int(c - stride * int(c / stride)) if stride else c
        rebuilt[c] = [(role, text) for _, role, _, text in sorted(turns.get(base, []), key=lambda t: t[:3])[:h] + own[h:]]
    members = defaultdict(list)
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children, leaves, saved = Counter(k[:-1] for k in members if k), Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += (len(m) - 1) * len(cases.words(k[-1][1])) if k else 0
    return Counter(
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(k)).encode()).hexdigest())
        for k, m in members.items()
    )


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("stride", [None, 20, 7])
def test_nodes(spark, stride, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 4)
    rows = _rows()
    turns = prefix_trie.turns(spark.createDataFrame([(*r, *["clash"] * 4) for r in rows], SCHEMA).repartition(3))
    nodes = prefix_trie.trie(prefix_trie.branched(turns, stride, 4) if stride else prefix_trie.whole(turns))
    assert Counter(tuple(r) for r in nodes.select(COLUMNS).collect()) == _expected(rows, stride, 4)


@pytest.mark.parametrize("rows", [[(7, 0, "a", "gone"), (7, 1, "a", "gone too")], [(1, 0, "a", "same")] + [(2, 0, "a", "same")], [(5, 0, None, None)]])
def test_small_tries(spark, rows):
    """A single turnless conversation, equal ones, one empty turn."""
    turns = prefix_trie.turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert Counter(tuple(r) for r in prefix_trie.trie(prefix_trie.branched(turns, 20, 4)).select(COLUMNS).collect()) == _expected(rows, 20, 4)


def test_long_conversation_makes_few_pairs(spark):
    """Two conversations of 3000 turns that part at the end: segments are exploded, not turns."""
    rows = [(c, i, "a", "x" if i < 2990 else f"{c} {i}") for c in (1, 2) for i in range(3000)]
    turns = prefix_trie.turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    nodes = prefix_trie.trie(prefix_trie.whole(turns))
    assert nodes.count() == 1 + 2990 + 20
    r = nodes.where("depth = 1").first()
    assert (r.n_convs, r.n_leaves, r.saved_tokens) == (2, 2, 2990)


def test_empty(spark):
    rows = prefix_trie.turns(spark.createDataFrame([], SCHEMA))
    assert prefix_trie.trie(prefix_trie.branched(rows, 20, 4)).count() == 0


def test_borrowed_turns_are_limited_before_the_shuffle(spark):
    rows = prefix_trie.turns(spark.createDataFrame([], SCHEMA))
    plan = prefix_trie.branched(rows.where(F.col("conv_id") >= 0), 20, 4)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
