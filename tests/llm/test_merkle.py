"""The manifest against plain Python: every leaf, subroot, root, proof and folded root."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tagweave.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, pos long, digest string, `a b.c` int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels_of(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def path_of(levels, at, fanout):
    out = []
    for level in levels[:-1]:
        first = at - at % fanout
        out.append(("".join(level[first:at]), "".join(level[at + 1 : first + fanout])))
        at //= fanout
    return out


def brute(rows, fanout):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append(row)
    names = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    for name in names:
        trees[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    levels = {name: levels_of([leaf_of(r) for r in trees[name]], fanout) for name in names}
    top = levels_of([levels[name][-1][0] for name in names], fanout)
    out = []
    for j, name in enumerate(names):
        for i, (doc, source, lang, n, text) in enumerate(trees[name]):
            path = path_of(levels[name], i, fanout) + path_of(top, j, fanout)
            tampered = doc is not None and n is not None and zlib.crc32(str(doc).encode()) % 7 == 0
            node = leaf_of((doc, source, lang, n + 1 if tampered else n, text))
            for before, after in path:
                node = H(before, node, after)
            root = top[-1][0]
            out.append((doc, leaf_of((doc, source, lang, n, text)), levels[name][-1][0], root, H(*map("".join, path)), node, node == root))
    return out


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((v is not None, v) for v in r))


def mixed(n):
    rng = random.Random(1)
    langs, texts = [None, "", "en", "en", "en", "é", "de"], [None, "", "x", "ÿé", "w " * 50_000]
    rows = [(i, None if i % 5 == 0 else f"s{i % 3}", rng.choice(langs), rng.choice([None, 5, 7]), rng.choice(texts)) for i in range(n)]
    return [*rows, (None, "s", "en", 3, "q"), (None, "s", "en", 3, "q"), (5, "s", "en", 1, "z"), (5, "s", "en", 1, "y")]


@pytest.mark.parametrize("fanout, every", [(2, 8), (2, 3), (3, 2)])
@pytest.mark.parametrize("rows", [mixed(300), [(1, "s", "en", 1, "t")], [(i, "s", str(i), 1, "") for i in range(9)]], ids=["mixed", "one", "lone"])
def test_digests_equal_plain_python(spark, rows, fanout, every):
    docs = spark.createDataFrame([(*r, "t", 1, "d", 2) for r in rows], SCHEMA).repartition(5)
    assert in_order(merkle.manifest_digests(docs, fanout, every).collect()) == in_order(brute(rows, fanout))


def test_an_empty_table_has_no_proof(spark):
    assert merkle.manifest_digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_only_every_few_levels_are_stored(spark):
    docs = spark.createDataFrame([(i, "s", "en", 1, "t") for i in range(1000)], SCHEMA.split(", tree")[0])
    manifest = merkle.merkle_manifest(docs, every=4)
    assert [level.count() for level in manifest.stored] == [1000, 63, 4, 1]
    shown = manifest.proofs().select(merkle.fold(F.col("leaf"), F.col("path")).alias("got"), "root", F.size("path").alias("n"))
    assert shown.where("got = root and n = 10").count() == 1000
    forged = manifest.proofs().select(merkle.fold(F.reverse("leaf"), F.col("path")).alias("got"), "root")
    assert forged.where("got = root").count() == 0
