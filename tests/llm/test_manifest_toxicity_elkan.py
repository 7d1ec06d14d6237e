from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from quire.llm import elkan, merkle, queries, toxicity

from .conftest import by_key


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


# 11 Merkle manifest


def brute_manifest(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) by the words of the contract, one list of nodes at a time."""

    def leaf(doc_id, source, lang, n_chars, text):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))

    def tree(nodes):
        """The root, and for each node its siblings and its path up as functions of a digest."""
        paths = [[] for _ in nodes]
        at = [[i] for i in range(len(nodes))]
        while len(nodes) > 1:
            runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
            for r, run in enumerate(runs):
                for i in range(len(run)):
                    for leaf_ in at[8 * r + i]:
                        paths[leaf_].append((run[:i], run[i + 1 :]))
            at = [sum(at[8 * r : 8 * r + 8], []) for r in range(len(runs))]
            nodes = [sha("".join(run)) for run in runs]
        return nodes[0], paths

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((leaf(*r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    own = {g: sorted(groups[g], key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0])) for g in order}
    trees = {g: tree([x[0] for x in own[g]]) for g in order}
    root, tops = tree([trees[g][0] for g in order])
    out = []
    for g, top in zip(order, tops, strict=True):
        for (digest, r), path in zip(own[g], trees[g][1], strict=True):
            doc_id, source, lang, n_chars, text = r
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = leaf(doc_id, source, lang, n_chars, text)
            for left, right in path + top:
                folded = sha("".join(left) + folded + "".join(right))
            out.append((doc_id, digest, trees[g][0], root, sha("".join("".join(a + b) for a, b in path + top)), folded, folded == root))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def manifested(spark, tmp_path, rows, schema="doc_id bigint, source string, lang string, n_chars bigint, text string, leaf string, tree int, pos int, proof string"):
    spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return by_key(queries.op11_merkle(spark, str(tmp_path)).collect(), *COLUMNS)


def test_manifest_brute(spark, tmp_path, hard_rows):
    rows = [(r[0], r[3], r[2], r[4], r[1]) for r in hard_rows]
    rows += [(1_000 + i, "s", "many", i, f"Text {i} ÄÖ") for i in range(70)]  # three levels, the last run of one
    rows += [(5, "s", f"g{i}", None, "") for i in range(12)] + [(7, None, "", 0, None)]  # more groups than a run, single leaves
    got = manifested(spark, tmp_path, rows)
    assert got == brute_manifest(rows)
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 8, 9, 64, 65])
def test_manifest_of_one_group(spark, tmp_path, n):
    rows = [(i, "s", "en", i, "A") for i in range(n)]
    assert manifested(spark, tmp_path, rows) == brute_manifest(rows)


def test_manifest_of_nothing(spark, tmp_path, nothing):
    nothing.write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op11_merkle(spark, str(tmp_path)).collect() == []
    assert merkle.build(nothing).root is None


def test_manifest_tells_fields_apart(spark):
    """A length stands before each field, so shifted borders, nulls and texts that look like them have other leaves."""
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "abc"), ("-", "abc"), ("", "abc")], "x string, y string")
    leaves = [r[0] for r in df.select(merkle.leaf_digest(df.x, df.y)).collect()]
    assert len(set(leaves)) == 5


# 12 toxicity


def simulated(n, seed):
    """Votes of a known model: chances by voter, and two voters of which one repeats the other."""
    r = random.Random(seed)
    m = len(toxicity.VOTERS)
    hit = [(0.05 + 0.01 * j, 0.35 + 0.02 * j) for j in range(m)]
    rows, truth = [], []
    for _ in range(n):
        y = int(r.random() < 0.3)
        v = [toxicity.TOXIC if r.random() < hit[j][y] else toxicity.SILENT for j in range(m)]
        v[1] = v[0] if r.random() < 0.9 else v[1]
        label = r.random()
        v[-1] = toxicity.SILENT if label < 0.6 else (toxicity.TOXIC if (r.random() < 0.9) == bool(y) else toxicity.CLEAN)
        rows.append("".join(map(str, v)))
        truth.append(y)
    return rows, truth, hit


def test_label_model_recovers_what_made_the_votes(spark):
    rows, truth, hit = simulated(6_000, 1)
    patterns = toxicity.patterns_of(spark.createDataFrame([(v,) for v in rows], "votes string")).cache()
    model = toxicity.fit_label_model(patterns)
    tied = {frozenset((j, p)) for j, p in enumerate(model.parent) if p >= 0}
    assert frozenset((0, 1)) in tied  # the correlated pair is found
    p = model.posterior(toxicity._matrix(rows))
    right = np.mean((p >= 0.5) == np.array(truth))
    assert right > 0.95
    free = [j for j in range(2, len(hit) - 1) if model.parent[j] < 0 and j not in model.parent]
    for j in free:
        for y in (0, 1):
            assert abs(math.exp(model.tables[j][y, 0, toxicity.TOXIC]) - hit[j][y]) < 0.06
    assert abs(math.exp(model.prior[1]) - 0.3) < 0.05


def test_expected_counts_brute(spark):
    rows, _, _ = simulated(300, 2)
    patterns = toxicity.patterns_of(spark.createDataFrame([(v,) for v in rows], "votes string"))
    model = toxicity.first_guess()
    got = toxicity.expected(patterns, model)
    m = len(toxicity.VOTERS)
    want = np.zeros((2, m, 3, m, 3))
    for text in rows:
        v = [int(c) for c in text]
        logs = [float(model.prior[y]) + sum(float(model.tables[j][y, 0, v[j]]) for j in range(m)) for y in (0, 1)]
        p = 1 / (1 + math.exp(logs[0] - logs[1]))
        for y, w in enumerate((1 - p, p)):
            for i in range(m):
                for j in range(m):
                    want[y, i, v[i], j, v[j]] += w
    assert np.allclose(got, want, atol=1e-4)


def test_votes():
    cast = lambda t: {n for n, v in zip(toxicity.VOTERS, toxicity.votes(t, toxicity.words(t), toxicity.NOTHING_INDUCED), strict=False) if v}
    assert cast("") == set() == cast("A plain text on rivers")
    assert cast("You are such an IDIOT") == {"mind", "addressed"}
    assert cast("an idiot is found far away from any form that addresses you") == {"mind"}
    assert cast("what an 1d10t, id10t") == {"disguised"}
    assert cast("Now shut  up") == {"phrase"} and cast("shut the door and look up") == set()
    assert cast("LOUD WORDS STAND HERE WITHOUT NEED") == {"shouted"} and cast("Thank you") == {"courtesy"}
    found = {"walks", "walked", "talk"}
    assert toxicity.marks(found) == found | {"wal*1", "wal*2", "walk*1", "walk*2", "tal*1"}
    assert toxicity.marks(found, frozenset({"walk"})) == found | {"walk*1", "walk*2"}


def test_words_of_long_texts(monkeypatch):
    text = "Ab cd," * 50 + "x" * 100 + "é" + " end " + "y" * 300
    whole = toxicity.words(text)
    monkeypatch.setattr(toxicity, "PIECE", 7)
    assert toxicity.words(text) == whole == {"ab", "cd", "end"}
    assert "".join(toxicity.pieces(text)) == text


def test_toxicity_held_out(spark, tmp_path):
    """Every text is scored; labels that no model has seen are mostly met; labels of held-out rows change nothing."""
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op12_toxicity(spark, sf).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert got.keys() == docs.keys()
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for k, r in got.items())
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(got[k].predicted, t) for k, t in labels.items() if got[k].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.94
    plain = {"idiot", "moron", "stupid", "scum", "trash", "clown", "loser", "pathetic", "disgusting", "worthless"}  # shorter insults come up in invented prose by chance
    insulted = [k for k, t in docs.items() if not toxicity.words(t).isdisjoint(plain)]
    assert sum(got[k].predicted for k in insulted) >= 0.95 * len(insulted) > 0
    assert sum(got[k].predicted for k, t in labels.items() if t == 0) <= 2


def test_toxicity_cases(spark, hard, hard_rows, nothing):
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, None), (None, 1), (6, 0), (7, 0)], "doc_id bigint, toxic int")
    one = {r._id: r.toxic for r in toxicity.labelled(labels).collect()}
    assert one == {3: True, 6: False, 7: False}
    rows = toxicity.score(hard, toxicity.train(hard, toxicity.labelled(labels))).collect()
    assert len(rows) == len(hard_rows) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 4}) == 1
    bare = toxicity.train(nothing, toxicity.labelled(labels.limit(0)))
    assert bare.weights == {} and toxicity.score(nothing, bare).collect() == []
    assert {r.predicted for r in toxicity.score(hard, bare).collect()} == {0}


# 13 Elkan


def brute_clusters(rows, k=8, rounds=10, dims=64):
    def fine(v):
        return v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(x) * 1024 <= elkan.MOST - 1 for x in v)

    kept = [(i, [math.floor(x * 1024) for x in v]) for i, v in rows if fine(v)]
    seed = sorted(kept, key=lambda r: (r[0] is None, sha(f"3:{r[0]}"), r[1]))[:k]
    cents = [v for _, v in seed]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min(range(len(cents)), key=lambda c: (far(v, cents[c]), c))
    for _ in range(rounds):
        of = [nearest(v) for _, v in kept]
        cents = [[sum(x) // len(x) for x in zip(*[v for (_, v), o in zip(kept, of, strict=True) if o == c], strict=True)] if c in of else cents[c] for c in range(len(cents))]
    return sorted([(i, nearest(v), far(v, cents[nearest(v)])) for i, v in kept], key=repr), cents


def vectors(seed, n=150, dims=64, ties=False):
    r = random.Random(seed)
    base = [[r.gauss(0, 0.3) for _ in range(dims)] for _ in range(6)]
    some = [(i, [x + r.gauss(0, 0.05) for x in r.choice(base)]) for i in range(n)]
    if ties:  # few places on a grid, so that many vectors lie as far from one centroid as from another
        some = [(i, [r.choice((0.0, 1.0)) if j < 3 else 0.0 for j in range(dims)]) for i in range(n)]
    return [(i, [float(np.float32(x)) for x in v]) for i, v in some]


SCHEMA = "vec_id bigint, embedding array<float>, cluster string, id int, lower int"


def clustered(spark, rows, **how):
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], SCHEMA).repartition(3)
    return elkan.cluster(df, **how)


@pytest.mark.parametrize("ties", [False, True])
def test_elkan_brute(spark, ties):
    rows = vectors(3, ties=ties)
    odd = [(900, None), (901, [0.5] * 63), (902, [0.1] * 63 + [None]), (903, [float("nan")] * 64), (904, [float("inf")] + [0.0] * 63), (905, [1e30] * 64), (906, []), (None, rows[0][1]), (5, rows[1][1]), (5, rows[1][1]), (907, [-131071.0] * 64)]
    got, cents = clustered(spark, rows + odd)
    got = got.collect()
    want, own = brute_clusters(rows + odd)
    assert by_key(got, "id", "cluster", "distance") == want and cents == own
    if not ties:
        assert sum(r.computed for r in got) < 0.5 * len(got) * 8 * 11  # most distances are never computed


def test_elkan_query(spark, tmp_path):
    rows = vectors(4, n=60)
    spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op13_elkan(spark, str(tmp_path)).collect()
    want, cents = brute_clusters(rows)
    totals = [sum(d for _, c, d in want if c == k) for k in range(8)]
    assert by_key(got, "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256") == sorted([(i, c, d, totals[c], sum(totals), sha(",".join(map(str, cents[c])))) for i, c, d in want], key=repr)


def test_elkan_few_and_none(spark):
    rows = vectors(5, n=3)
    got, cents = clustered(spark, rows)
    assert by_key(got.collect(), "id", "cluster", "distance") == brute_clusters(rows)[0] and len(cents) == 3
    none, cents = clustered(spark, [(1, None)])
    assert none.collect() == [] == cents and elkan.with_totals(none, cents).collect() == []


def test_elkan_bounds_hold():
    """After any moves of the centroids, upper bounds are above and lower bounds below the true distances."""
    r = np.random.default_rng(6)
    x = r.integers(-(1 << 20), 1 << 20, (200, 16))
    cents = x[:5].tolist()
    cluster, upper, lower, before = np.zeros(200, np.int32), np.full(200, np.inf), np.zeros((200, 5)), None
    for _ in range(8):
        step = elkan.Round(cents, before)
        cluster, upper, lower, _, _ = step.assign(x, cluster, upper, lower)
        true = ((x[:, None] - np.array(cents)[None]) ** 2).sum(axis=2)
        assert (cluster == true.argmin(axis=1)).all()
        root = np.sqrt(true.astype(float))
        assert (upper >= root[np.arange(200), cluster]).all() and (lower <= root).all()
        before = cents
        cents = (np.array(cents) + r.integers(-5_000, 5_000, (5, 16))).tolist()
