"""The manifest against a plain tree, its traversal step by step, and its defined cases."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tesserae.llm import merkle
from tesserae.llm.common import shared_dir


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain(nodes):
    """All levels of the tree over the nodes."""
    levels = [list(nodes)]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i : i + 8]) for i in range(0, len(last), 8)])
    return levels


def siblings(levels, at):
    out = []
    for level in levels[:-1]:
        begin = at // 8 * 8
        out.append((level[begin:at], level[at + 1 : begin + 8]))
        at //= 8
    return out


def folded(node, path):
    for before, after in path:
        node = h(*before, node, *after)
    return node


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 73, 200, 511, 512])
def test_traversal(n):
    leaves = [h(str(i)) for i in range(n)]
    levels = plain(leaves)
    paths = list(merkle.traversal(leaves, merkle.height(n)))
    for t, path in enumerate(paths):
        assert [s[1:] for s in path] == ["".join(a + b) for a, b in siblings(levels, t)]
        assert merkle.fold(leaves[t], path) == levels[-1][0] == merkle.root_of(leaves, merkle.height(n))
    assert len(paths) == n


class Counted(list):
    """Leaves that count how often they are asked for, one by one."""

    asked = 0

    def __getitem__(self, k):
        self.asked += not isinstance(k, slice)
        return super().__getitem__(k)


def test_traversal_takes_as_many_leaves_in_each_step():
    leaves = Counted(h(str(i)) for i in range(512))
    steps = merkle.traversal(leaves, 3)
    next(steps)
    before = leaves.asked
    for _ in steps:
        assert leaves.asked - before <= 3
        before = leaves.asked


def expected(groups):
    """{(group, id): (leaf, subroot, root, proof, folded)} of {group: [(id, leaf, other)]} in order."""
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain([x[1] for x in groups[g]]) for g in names}
    top = plain([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for at, (name, leaf, other) in enumerate(groups[g]):
            path = siblings(trees[g], at) + siblings(top, k)
            out.append((name, leaf, trees[g][-1][0], top[-1][0], h(*(x for a, b in path for x in a + b)), folded(other or leaf, path)))
    return sorted(map(str, out))


def test_manifest(spark):
    """Groups of one leaf, of one block, of several and of over 512 blocks' worth of levels; a null group, null ids, repeated rows."""
    sizes = {None: 3, "": 1, "a": 513, "b": 8, "ü": 4100, "é": 70}
    rows = [(g, i if i else None, h(str(g), str(i)), h("other") if i % 3 == 0 else None) for g, n in sizes.items() for i in range(n)]
    rows += [("b", 3, h("b", "3"), h("other"))] * 2
    groups = {}
    for g, i, leaf, other in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        groups.setdefault(g, []).append((i, leaf, other))
    found = merkle.manifest(spark.createDataFrame(rows, "grp string, id long, digest string, other string").repartition(5), shared_dir(spark))
    assert sorted(str(tuple(r)) for r in found.collect()) == expected(groups)


def test_rounds_over_many_groups(spark, monkeypatch):
    """Small blocks: several rounds in the groups and over them."""
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    groups = {f"g{k:03d}": [(i, h(str(k), str(i)), None) for i in range(1 + k * 7 % 100)] for k in range(90)}
    rows = [(g, *x) for g, leaves in groups.items() for x in leaves]
    found = merkle.manifest(spark.createDataFrame(rows, "grp string, id long, digest string, other string"), shared_dir(spark))
    assert sorted(str(tuple(r)) for r in found.collect()) == expected(groups)


def test_leaf(spark):
    docs = spark.createDataFrame([(1, "s", None, 3, "Ünï")], "doc_id long, source string, lang string, n_chars long, text string").withColumn("leaf", F.lit("clash"))
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    got = docs.select(merkle.leaf(columns).alias("a"), merkle.leaf(columns, "text", F.lower("text")).alias("b")).first()
    assert got["a"] == h("1:1", "1:s", "-", "1:3", "5:Ünï") and got["b"] == h("1:1", "1:s", "-", "1:3", "5:ünï")


def test_nothing(spark):
    nothing = spark.createDataFrame([], "grp string, id long, digest string, other string")
    assert merkle.manifest(nothing, shared_dir(spark)).count() == 0


def test_long_texts_and_tampering(spark, tmp_path):
    """The query over a small table: nulls, an empty and a very long text; only changed texts fail."""
    from tesserae.llm import queries

    docs = [(i, t, "en" if i % 2 else None, "s", len(t or "")) for i, t in enumerate(["", None, "ABC", "abc", "Long " * 400_000, "x"] * 3)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").withColumn("root", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in queries.op12_merkle_manifest(spark, str(tmp_path)).collect()}
    assert len(found) == len(docs)
    for i, text, *_ in docs:
        changed = zlib.crc32(str(i).encode()) % 3 == 0 and (text or "") != (text or "").lower()
        assert found[i]["verified"] is not changed and (found[i]["folded_root"] == found[i]["root"]) is not changed
