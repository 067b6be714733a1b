"""The prefix trie against one built turn by turn."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from eventgraph.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(paths):
    """COLUMNS of every node, from each conversation's list of (role, text)."""
    members = defaultdict(list)
    for conv, turns in paths.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[c] for c in below) or 1
        saved[node] = sum(saved[c] for c in below) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    sha = lambda node: hashlib.sha256(",".join(str(c) for c in sorted(c for c in members[node] if len(paths[c]) == len(node))).encode()).hexdigest()
    return sorted(
        ((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), leaves[n], saved[n], sha(n)) for n, m in members.items()), key=repr
    )


def turns_of(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in sorted(((c, t, r or "", x or "") for c, t, r, x in rows if c is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2], r[3])):
        convs[conv].append((role, text))
    return convs


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + turns[h:]
    return out


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_query(spark, folder):
    rows = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert rows_of(trie.op13_prefix_trie(spark, folder)) == plain(rebuilt(turns_of(map(tuple, rows))))


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations(spark, seed):
    """Long and short paths, deep common prefixes, one path of many conversations, one that is longer than all."""
    r = random.Random(seed)
    rows = [(c, t, r.choice(["user", "assistant"][: 1 + (t > 3)]), "x" * r.randrange(1 + (r.random() < 0.3))) for c in range(60) for t in range(r.choice([0, 1, 3, 4, 9, 20]))]
    rows += [(100 + c, t, "user", f"é{t}") for c in range(40) for t in range(7)]
    rows += [(900, t, "user", f"é{t}") for t in range(70)]
    turns, convs = trie.numbered_turns(spark.createDataFrame(rows, SCHEMA).repartition(5))
    got = trie.prefix_trie(trie.paths_of(turns, convs)).withColumnRenamed("saved", "saved_tokens")
    assert rows_of(got) == plain(turns_of(rows))


def test_odd_rows(spark, tmp_path):
    rows = [(5, None, None, None), (5, 1, "user", "b"), (5, 1, "user", "a"), (5, 1, "user", "a"), (None, 1, "user", "lost"), (7, 1, "user", "long " * 40000), (107, 2, None, "z"), (100, 1, "user", "q"), (101, 3, "user", "q"), (101, 4, "", "")]
    spark.createDataFrame([(*x, 1, "n") for x in rows], SCHEMA + ", depth int, name string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert rows_of(trie.op13_prefix_trie(spark, str(tmp_path))) == plain(rebuilt(turns_of(rows)))


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    assert trie.op13_prefix_trie(spark, str(tmp_path)).count() == 0


def test_ends_in_several_pieces(spark):
    """A node at which many conversations end is hashed as one, though its ids lie in many ranges."""
    ids = list(range(0, 30000, 3))
    rows = spark.createDataFrame([(1, 4, i) for i in ids] + [(2, 5, 9)], "depth long, name long, conv_id long").repartition(7)
    got = {(r.depth, r.name): r.ends_sha256 for r in trie.ends(rows).collect()}
    assert got == {(1, 4): hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), (2, 5): hashlib.sha256(b"9").hexdigest()}
