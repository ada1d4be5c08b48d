"""Prefix trie, Merkle manifest and source mix against plain versions, with nulls, ties, repeated rows, long groups and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from spindrift.llm import common, merkle, mixture, turntrie

CLASH = "n long, i long, key string, g long, name string, depth int, digest string, path string, rate string, copies int, _source string, copy string"
MORE = (1, 2, "k", 3, "n", 4, "d", "p", "r", 5, "s", "m")


def crc(x):
    return zlib.crc32(str(x).encode())


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# ---------------------------------------------------------------- 11
def plain_trie(rows):
    turns = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in turns.items()}
    made = {c: own.get(c - c % 20, [])[: crc(c) % 4] + v[crc(c) % 4 :] for c, v in own.items()}
    members = collections.defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[tuple(made[c][:d])].append(c)
    children = collections.Counter(n[:-1] for n in members if n)
    leaves, saved = collections.Counter(), collections.Counter()
    for n, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += (len(m) - 1) * words
    return sorted((m[0], len(n), members[n[:-1]][0] if n else -1, len(m), children[n], leaves[n], saved[n], sha(",".join(str(c) for c in m if len(made[c]) == len(n)))) for n, m in members.items())


def trie_rows(df):
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], *list(r)[3:]) for r in df.collect())


def conversations(spark, rows):
    common.ship(spark)
    return spark.createDataFrame([(*r, *MORE) for r in rows], f"conv_id long, turn long, role string, text string, {CLASH}").repartition(5)


def test_trie(spark):
    r = random.Random(11)
    rows = [(c, t, r.choice(["user", "assistant"]), r.choice(["a", "b  c", "d\te f"])) for c in range(130) if c % 7 for t in range(r.randint(1, 9))]
    rows += [(200, 0, None, None), (201, 0, "", ""), (202, 0, "user", None), (203, None, "x", "first"), (203, -5, None, "second"), (None, 0, "user", "nobody's")]
    rows += [(240 + i, t, "user", f"same {t}") for i in range(30) for t in range(5)]  # copies that end at one node
    rows += [(301, t, "user" if t % 2 else None, str(t % 3)) for t in range(1100)] + [(302, t, "user" if t % 2 else None, str(t % 3)) for t in range(1000)]
    assert trie_rows(turntrie.trie(conversations(spark, rows))) == plain_trie(rows)


def test_trie_of_few_rows(spark):
    none = turntrie.trie(conversations(spark, [(1, 0, "u", "t")]).limit(0))
    assert none.collect() == [] and len(none.columns) == 8
    bare = [c for c in range(1, 20) if crc(c) % 4 > 1][:2]  # without a first conversation of the family all turns may go
    assert trie_rows(turntrie.trie(conversations(spark, [(c, 0, "u", "gone") for c in bare]))) == [(bare[0], 0, -1, 2, 0, 1, 0, sha(",".join(map(str, bare))))]
    tied = [(20, 3, "u", "x"), (20, 3, "u", "x"), (20, 3, "u", "x"), (40, 3, "u", "x"), (40, 3, "u", "x")]
    assert trie_rows(turntrie.trie(conversations(spark, tied))) == plain_trie(tied)


def test_ends_of_a_hot_node(spark, monkeypatch):
    """Ids of one node over several partitions, and nodes longer than a piece."""
    monkeypatch.setattr(turntrie, "_IDS", 50)
    rows = [(3, 7, i) for i in range(5000)] + [(1, 1, 5), (3, 8, 9)] + [(4, k, i) for k in range(40) for i in range(k)]
    got = {(x["depth"], x["name"]): x["ends_sha256"] for x in turntrie.ends(spark.createDataFrame(rows, "depth long, name long, conv_id long").repartition(7)).collect()}
    want = collections.defaultdict(list)
    for d, n, c in rows:
        want[d, n].append(c)
    assert got == {k: sha(",".join(map(str, sorted(v)))) for k, v in want.items()}


# ---------------------------------------------------------------- 12
FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


def plain_tree(nodes):
    """The root, and each node's path: by level its place and its run's others."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for p, k in zip(paths, at, strict=True):
            run = level[k // 16 * 16 : k // 16 * 16 + 16]
            p.append((k % 16, "".join(run[: k % 16] + run[k % 16 + 1 :])))
        level = [sha("".join(level[k : k + 16])) for k in range(0, len(level), 16)]
        at = [k // 16 for k in at]
    return level[0], paths


def plain_leaf(row):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def plain_fold(d, path):
    for place, others in path:
        d = sha(others[: 64 * place] + d + others[64 * place :])
    return d


def plain_manifest(rows):
    by_source = collections.defaultdict(list)
    for row in rows:
        by_source[row[1]].append(row)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r))) for s in order}
    roots = {s: plain_tree([plain_leaf(r) for r in trees[s]]) for s in order}
    root, tops = plain_tree([roots[s][0] for s in order])
    out = []
    for s, top in zip(order, tops, strict=True):
        for r, path in zip(trees[s], roots[s][1], strict=True):
            lower = re.sub("[A-Z]", lambda m: m[0].lower(), r[4]) if r[4] is not None and r[0] is not None and crc(r[0]) % 5 == 0 else r[4]
            folded = plain_fold(plain_leaf((*r[:4], lower)), path + top)
            out.append((r[0], plain_leaf(r), roots[s][0], root, sha("".join(o for _, o in path + top)), folded, folded == root))
    return sorted(out, key=str)


def manifest_rows(docs):
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    made = merkle.verified(merkle.manifest(docs, F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, lower)))
    return sorted((tuple(x) for x in made.collect()), key=str)


def documents(spark, rows):
    common.ship(spark)
    return spark.createDataFrame([(*r, *MORE) for r in rows], f"{FIELDS}, {CLASH}").repartition(4)


def test_manifest(spark):
    r = random.Random(12)
    rows = [(i, r.choice(["a", "ä", "b", "Z", "", None]), r.choice(["en", None]), r.choice([0, -3, None]), r.choice(["Text ÄÖ", "", None, "x" * 9000, "ABC"])) for i in range(150)]
    rows += [(7, "a", "en", 1, "Two"), (7, "a", "en", 1, "Two"), (7, "a", "en", 1, "Other"), (None, "a", None, None, None), (None, None, "en", 2, "Null"), (900, "alone", "en", 2, "Alone")]
    assert manifest_rows(documents(spark, rows)) == plain_manifest(rows)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 4096, 4097, 70_000])
def test_manifest_of_one_source(spark, n):
    rows = [(i * 3, "s", "en", i, f"Text {i}") for i in range(n)]
    if n < 5000:
        assert manifest_rows(documents(spark, rows)) == plain_manifest(rows)
    else:  # three trees of blocks: two levels of blocks and what is over them
        made = merkle.manifest(spark.createDataFrame(rows, FIELDS))
        root, paths = plain_tree([plain_leaf(x) for x in rows])
        assert made.first()["root"] == root
        assert {x["doc_id"]: [tuple(p) for p in x["path"]] for x in made.where("doc_id % 777 = 0").collect()} == {3 * i: p for i, p in enumerate(paths) if i % 259 == 0}


def test_many_sources_and_none(spark):
    rows = [(i, f"s{i % 300}", None, None, "T") for i in range(450)]
    assert manifest_rows(documents(spark, rows)) == plain_manifest(rows)
    assert manifest_rows(documents(spark, rows).limit(0)) == []


def test_traversal():
    """Paths from a walk with a run a level are those of the whole tree, at any length and number of levels."""
    for n in (1, 2, 15, 16, 17, 255, 256, 257, 300, 511, 4096):
        leaves = [sha(str(i)) for i in range(n)]
        root, paths = plain_tree(leaves)
        assert list(merkle.traverse(leaves, merkle._levels(n))) == paths
        assert merkle.block_root(leaves, merkle._levels(n)) == root
    raised = merkle.block_root(["x"], 3)  # a last block of one leaf goes up like the others
    assert raised == sha(sha(sha("x")))
    assert list(merkle.traverse(["x"], 3)) == [[(0, ""), (0, ""), (0, "")]]


# ---------------------------------------------------------------- 13
def plain_targets(sizes, weights=(1, 2, 3), times=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        left = total - sum(times * sizes[s] for s in capped)
        held = sum(w[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and w[s] * left > times * sizes[s] * held}
        if not over:
            return {s: Fraction(times * sizes[s]) if s in capped else Fraction(w[s] * left, held or 1) for s in order}
        capped |= over


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    r = random.Random(seed)
    sizes = {s: 0 if r.random() < 0.1 else int(10 ** r.uniform(0, 9)) for s in [None, "", "Z", "a", "ä", "日本", *(f"s{i}" for i in range(40))]}
    got = {x["source"]: x for x in mixture.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = plain_targets(sizes)
    assert {s: x["target"] for s, x in got.items()} == {s: float(t) for s, t in want.items()}
    assert sum(want.values()) == sum(sizes.values())
    assert all(x["target"] <= 3 * sizes[s] and x["rate"] <= 3 for s, x in got.items())


def plain_mix(rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = collections.Counter()
    for _, s, t in rows:
        sizes[s] += size(t)
    target = {s: float(t) for s, t in plain_targets(sizes).items()}
    out = []
    for i, s, t in rows:
        rate = target[s] / sizes[s] if sizes[s] else 0.0
        u = int(hashlib.md5(f"42:{'-' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
        out.append((i, size(t), sizes[s], target[s], math.floor(rate) + (u < rate - math.floor(rate))))
    return out


def test_mix(spark):
    common.ship(spark)
    r = random.Random(13)
    rows = [(i, r.choice(["a", "a", "a", "b", "c", "", None]), " ".join(["w x"] * r.randint(0, 300)) + r.choice(["", "\n\x0b", "\x1f"])) for i in range(600)]
    rows += [(5, "b", "twice"), (5, "b", "twice"), (None, "a", "no id"), (700, "empty", None), (701, "empty", ""), (702, "b", "long " * 50_000)]
    docs = spark.createDataFrame([(*x, *MORE) for x in rows], f"doc_id long, source string, text string, {CLASH}").repartition(3)
    want = plain_mix(rows)
    got = mixture.planned(docs).select("doc_id", "size", "source_size", "target", "copies")
    assert sorted((tuple(x) for x in got.collect()), key=str) == sorted(want, key=str)
    made = mixture.mixed(docs)
    assert made.columns == [*(c for c in docs.columns if c != "copy"), "copy"]
    copies = collections.Counter((x["doc_id"], x["text"]) for x in made.select("doc_id", "text").collect())
    expected = collections.Counter()
    for (i, _, t), x in zip(rows, want, strict=True):
        expected[i, t] += x[4]
    assert copies == +expected
    assert mixture.planned(docs.limit(0)).count() == 0 and mixture.mixed(docs.limit(0)).count() == 0


def test_words_taken_are_near_the_target(spark):
    rows = [(i, f"s{i % 5}", "w " * (1 + i * 7 % 40)) for i in range(20_000)]
    plan = mixture.planned(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    for x in plan.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("target").alias("target")).collect():
        assert abs(x["taken"] / x["target"] - 1) < 0.03
