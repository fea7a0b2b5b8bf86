"""Training-data operators against brute force on small fixtures."""

import os
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayfold.llm import encoding, mixing, nearest, overlap, pieces, runs, spans, splits, transducer
from wayfold.llm import queries as Q
from wayfold.operators.components import connected_components


# Problem 1: the same records across splits
def test_overlaps_as_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [rng.sample(vocabulary, rng.randint(9, 16)) for _ in range(12)]
    rows = []
    for i in range(120):
        ws = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            ws[rng.randrange(len(ws))] = rng.choice(vocabulary)
        text = rng.choice([", ", " ", "  - "]).join(ws)
        text = rng.choice([text, text.upper(), " " + text + ".", None, ""]) if rng.random() < 0.3 else text
        digest = rng.choice([None, "0" * 64, f"{rng.randint(1, 25):016x}" + "a" * 48, f"SHA256:{rng.randint(1, 25):016X}...", "12ab"])
        rows.append((i, rng.choice(["dev", " DEV ", "val", "Test", None, "other"]), digest, text, rng.choice(["r1", None])))
    rows.append((500, *rows[3][1:]))
    df = spark.createDataFrame(rows, "n int, split string, sha string, text string, rig string")
    got = {(r["train_id"], r["eval_id"]) for r in overlap.overlaps(df, "n", "split", "sha", "text", ["rig"]).collect()}

    def dig(s):
        s = re.sub(r"[^0-9a-f]", "", re.sub(r"^sha256:", "", (s or "").lower()))
        return s[:16] if len(s) >= 16 and set(s) != {"0"} else None

    want = set()
    for a in rows:
        for b in rows:
            if (a[1] or "").strip().lower() == "dev" and (b[1] or "").strip().lower() in ("val", "test"):
                x, y = (set(re.findall("[a-z0-9]+", (r[3] or "").lower())) for r in (a, b))
                near = min(len(x), len(y)) >= 10 and len(x & y) >= 0.7 * len(x | y)
                if near or (dig(a[2]) and dig(a[2]) == dig(b[2])):
                    want.add((a[0], b[0]))
    assert got == want and len(want) > 50
    assert overlap.overlaps(df.limit(0), "n", "split", "sha", "text", ["rig"]).count() == 0


# Problem 3: runs of equal events
@pytest.mark.parametrize("block", [10**12, 7, 50])
def test_runs_as_brute_force(spark, block):
    rng = random.Random(2)
    rows, t = [], 0
    for _ in range(300):
        t += rng.choice([1, 1, 2, 9])
        rows.append((rng.choice(["a", "a", None]), t if rng.random() > 0.05 else None, rng.choice([0, 0, 0, 1, None])))
        if rng.random() < 0.1:
            rows.append(rows[-1])
    df = spark.createDataFrame(rows, "key string, t bigint, rank int")
    got = sorted((r["key"] or "", r["first_t_ns"], r["last_t_ns"], r["n_events"], r["n_rows"]) for r in runs.collapse_runs(df, "key", "t", "rank", gap_ns=8, block=block).collect())
    want = []
    for key in ("a", None):
        seq = {}
        for k, t, r in rows:
            if k == key and t is not None and r is not None:
                seq.setdefault(t, []).append(r)
        now = None
        for t in sorted(seq):
            if now and now[5] == max(seq[t]) and t - now[2] <= 8:
                now[2], now[3], now[4] = t, now[3] + 1, now[4] + len(seq[t])
            else:
                now = [key or "", t, t, 1, len(seq[t]), max(seq[t])]
                want.append(now)
    assert got == sorted(tuple(w[:5]) for w in want)
    assert runs.collapse_runs(df.limit(0), "key", "t", "rank", gap_ns=8).count() == 0


# Problem 5: nearest in time
def test_nearest_as_brute_force(spark):
    rng = random.Random(4)
    left = [(i, rng.choice(["x", "y", None]), rng.choice([rng.randint(-500, 500), None])) for i in range(200)]
    right = [(i, rng.choice(["x", "y", None]), rng.choice([rng.randint(-500, 500), None])) for i in range(120)]
    right += [(900, *right[0][1:]), (-1, *right[1][1:])]
    a, b = spark.createDataFrame(left, "row int, rig string, t bigint"), spark.createDataFrame(right, "ego int, rig string, t bigint")
    got = {r["row"]: (r["ego"], r["dt_ns"]) for r in nearest.nearest_in_time(a, b, "rig", "t", "ego", tolerance=6).collect()}
    for row, rig, t in left:
        near = [(abs(t - u), e) for e, r, u in right if None not in (rig, t, u) and r == rig and abs(t - u) <= 6]
        assert got[row] == ((min(near)[1], min(near)[0]) if near else (None, None))
    assert nearest.nearest_in_time(a, b.limit(0), "rig", "t", "ego", tolerance=6).filter("ego IS NOT NULL").count() == 0
    clash = nearest.nearest_in_time(a.withColumn("ego", F.lit(1)).withColumn("_b", F.lit(2)), b.withColumn("row", F.lit(3)), "rig", "t", "ego", tolerance=6)
    assert {r["row"]: r["ego"] for r in clash.collect()} == {k: v[0] for k, v in got.items()}
    assert nearest.nearest_in_time(a.limit(0), b, "rig", "t", "ego", tolerance=6).count() == 0


# Problem 6: linked sets and splits
def test_components_of_long_chains(spark):
    rng = random.Random(6)
    ids = list(range(300))
    rng.shuffle(ids)
    edges = [(ids[i], ids[i + 1]) for i in range(199)] + [(ids[200 + i], ids[200]) for i in range(1, 60)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u int, v int"), "u", "v").collect()}
    chain, star = ids[:200], ids[200:260]
    assert all(got.get(i, i) == min(chain) for i in chain) and all(got.get(i, i) == min(star) for i in star)


def test_linked_sets_and_splits(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([f"v{rng.randint(0, 120)}", None]), rng.choice([f"s{rng.randint(0, 200)}", None]), rng.choice(["a", "b", None])) for i in range(600)]
    df = spark.createDataFrame(rows, "n int, v string, s string, stratum string")
    links = {"v": F.col("v"), "s": F.col("s")}
    first = {r["row_id"]: r["first_id"] for r in splits.linked_sets(df, "n", links).collect()}
    parent = {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = {}
    for n, v, s, _ in rows:
        for key in (("v", v), ("s", s)):
            if key[1] is not None:
                a, b = root(n), root(seen.setdefault(key, n))
                parent[max(a, b)] = min(a, b)
    assert first == {n: root(n) for n in parent}
    out = splits.grouped_splits(df, "n", links, F.col("stratum"), {"train": 0.7, "val": 0.15, "test": 0.15}).collect()
    assert sorted(r["row_id"] for r in out) == [r[0] for r in rows]
    of = {}
    for r in out:
        assert of.setdefault(r["first_id"], r["split"]) == r["split"]
    assert splits.grouped_splits(df.limit(0), "n", links, F.col("stratum"), {"train": 1.0}).count() == 0


def test_shares_are_met_when_sets_are_small(spark):
    rows = [(i, f"v{i // 3}", rng) for i, rng in zip(range(3000), "abc" * 1000)]
    df = spark.createDataFrame(rows, "n int, v string, stratum string")
    out = splits.grouped_splits(df, "n", {"v": F.col("v")}, F.col("stratum"), {"train": 0.7, "val": 0.15, "test": 0.15})
    n = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert abs(n["train"] - 2100) <= 60 and abs(n["val"] - 450) <= 60


def test_differencing_balances():
    w = np.array([random.Random(i).randint(1, 50) for i in range(400)], dtype=float)
    sums = np.bincount(splits.difference_into_bins(w, 7), weights=w)
    assert sums.max() - sums.min() <= 2
    assert len(splits.difference_into_bins(np.zeros(0), 7)) == 0


def test_splits_are_the_same_whatever_the_layout(spark):
    rng = random.Random(12)
    rows = [(i, f"v{int(rng.paretovariate(0.8)) % 900}", rng.choice(["a", "a", "b", None])) for i in range(5000)]
    df = spark.createDataFrame(rows, "n int, v string, stratum string")
    shares = {"train": 0.7, "val": 0.15, "test": 0.15}
    got = []
    for partitions in (3, 11):
        out = splits.grouped_splits(df.repartition(partitions, "n"), "n", {"v": F.col("v")}, F.col("stratum"), shares).collect()
        got.append({r["row_id"]: r["split"] for r in out})
    assert got[0] == got[1] and len(got[0]) == 5000
    for s in ("a", "b", None):
        of = [got[0][i] for i, _, x in rows if x == s]
        assert abs(of.count("train") / len(of) - 0.7) < 0.06


def test_bins_are_even_and_whole(spark):
    rng = random.Random(13)
    rows = [(rng.choice("xy"), f"i{i}", rng.choice([1, 1, 1, 2, 3, rng.randint(1, 400)])) for i in range(3000)]
    out = splits.balanced_bins(spark.createDataFrame(rows, "g string, item string, w int"), "g", "item", "w", bins=10).collect()
    assert sorted((r["group"], r["item"], r["weight"]) for r in out) == sorted(rows)
    for g in "xy":
        sums = np.zeros(10)
        for r in out:
            if r["group"] == g:
                sums[r["bin"]] += r["weight"]
        assert np.ptp(sums) <= 0.002 * sums.mean()


def test_bins_settle_at_a_local_best():
    rng = np.random.default_rng(5)
    m, shares = rng.random((12, 3)), np.array([0.6, 0.4])
    of = np.zeros(12, dtype=int)
    gap = np.stack([m.sum(0) * (1 - 0.6), -m.sum(0) * 0.4])
    error = lambda o: sum((((m * (o == k)[:, None]).sum(0) - shares[k] * m.sum(0)) ** 2).sum() for k in (0, 1))
    best = splits.settle(m, of, gap)
    for i in range(12):
        flipped = best.copy()
        flipped[i] = 1 - flipped[i]
        assert error(flipped) >= error(best) - 1e-9
        for j in range(12):
            if best[i] != best[j]:
                swapped = best.copy()
                swapped[[i, j]] = best[[j, i]]
                assert error(swapped) >= error(best) - 1e-9


def test_long_sets_meet_too(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    base = [rng.sample(words, n) for n in (60, 78, 80, 82, 90, 110, 118, 200, 300)]
    rows = []
    for i in range(60):
        ws = list(rng.choice(base))
        for _ in range(rng.randint(0, len(ws) // 4)):
            ws[rng.randrange(len(ws))] = rng.choice(words)
        rows.append((i, rng.choice(["dev", "val"]), None, " ".join(ws[: rng.randint(len(ws) * 3 // 4, len(ws))])))
    df = spark.createDataFrame(rows, "n int, split string, sha string, text string")
    got = {(r["train_id"], r["eval_id"]) for r in overlap.overlaps(df, "n", "split", "sha", "text", []).collect()}
    want = set()
    for a in rows:
        for b in rows:
            x, y = set(a[3].split()), set(b[3].split())
            if (a[1], b[1]) == ("dev", "val") and len(x & y) >= 0.7 * len(x | y) - 1e-9:
                want.add((a[0], b[0]))
    assert got == want and len(want) > 20


# Problem 7: encoding
@pytest.fixture(scope="module")
def machine():
    if not os.path.exists(encoding.VOCABULARY):
        pytest.skip("no vocabulary")
    data = open(encoding.VOCABULARY, "rb").read()
    import tiktoken

    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    known = tiktoken.Encoding("known", pat_str=pattern, mergeable_ranks=transducer.read_ranks(data), special_tokens={})
    return transducer.machine_for(data), known


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=20), st.sampled_from(["'s", "'ll", "'", "  ", "\n", "\t", " the", "ing", "aaaa", "\0", "é", "漢字", "0123", "==="])), max_size=25))
def test_ids_as_a_known_encoder(machine, parts):
    text = "".join(parts).encode("utf-8", "ignore").decode()
    ours, known = machine
    ids = ours.encode(text)
    assert ids == known.encode_ordinary(text)
    assert transducer.decode(ours.merges.bytes_of, ids) == text


def test_long_pieces_and_segments(machine, monkeypatch):
    ours, known = machine
    rng = random.Random(1)
    for text in ("ab" * 5000, "".join(rng.choice("abcdefgh") for _ in range(3000)), "=" * 2000, " " * 700 + "x"):
        assert ours.encode(text) == known.encode_ordinary(text)
    monkeypatch.setattr(pieces, "SEGMENT", 50)
    monkeypatch.setattr(transducer, "BATCH", 100)
    text = " ".join(rng.choice(["one", "two's", "\n\n", "3.5", "  ", "漢"]) for _ in range(900))
    assert ours.encode(text) == known.encode_ordinary(text)
    lengths, ids = ours.encode_many([None, text, "", "a b", None])
    assert lengths[0] == lengths[2] == lengths[4] == 0 and lengths.sum() == len(ids)


def test_encode_corpus(spark, machine):
    df = spark.createDataFrame([(1, "a b", "x"), (2, "", "y"), (3, None, "z"), (4, "<|endoftext|>", None)], "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in encoding.encode_corpus(df, "text", ["doc_id"]).collect()}
    assert got[2] == got[3] == [] and got[1] == machine[1].encode_ordinary("a b") and 50256 not in got[4]
    back = encoding.decode_corpus(encoding.encode_corpus(df, "text", ["doc_id"]), "ids", ["doc_id"])
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {1: "a b", 2: "", 3: "", 4: "<|endoftext|>"}
    assert encoding.encode_corpus(df.limit(0), "text", ["doc_id"]).count() == 0


# Problem 8: mixing
def test_mixing(spark):
    rng = random.Random(3)
    words = {"a": ["red", "blue", "green"], "b": ["one", "two", "three"], "c": ["cat", "dog", "cow"]}
    rows = []
    for i in range(600):
        s = "a" if i < 400 else rng.choice("bc")
        text = " ".join(rng.choice(words[s]) for _ in range(rng.randint(5, 40)))
        rows.append((i, text, None if i % 10 == 0 else s))
    rows += [(1000, None, "a"), (1001, "", "b"), (1002, "odd one", "zzz"), (1003, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 0.4, 2), ("b", 0.35, 3), ("c", 0.25, 4), ("none", 0.0, 1), ("gone", 0.1, 1)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix_sources(df, targets, "doc_id", "source", "text", [])
    out = {r["doc_id"]: r for r in mixed.collect()}
    assert len(out) == len(rows) and out[1002]["copies"] == 0
    caps = {"a": 2, "b": 3, "c": 4}
    assert all(0 <= r["copies"] <= caps.get(r["domain"], 0) for r in out.values())
    right = [out[i]["domain"] == ("a" if i < 400 else None) for i, _, s in rows if s is None and i < 400]
    assert sum(right) >= 0.9 * len(right)  # held out from the fit
    report = {r["source"]: r for r in mixing.mixed_shares(mixed, targets).collect()}
    share = {s: r["share"] for s, r in report.items()}
    for s in "abc":  # what is missed is less than any document that could be used once more
        assert -(report[s]["spare_tokens"] or 1) < report[s]["residual"] <= 1e-3 and report[s]["filled"]
    assert not report["gone"]["filled"] and sum(r["n_tokens"] for r in report.values()) == sum(r["n_tokens"] * r["copies"] for r in out.values())
    for s, want in (("a", 0.4), ("b", 0.35), ("c", 0.25)):
        assert share[s] == pytest.approx(want, abs=0.02)
    assert share["gone"] == 0
    assert mixing.mix_sources(df.limit(0), targets, "doc_id", "source", "text", []).count() == 0
    assert mixing.mix_sources(df, targets.limit(0), "doc_id", "source", "text", []).filter("copies > 0").count() == 0


# Problem 9: shared spans
def brute_spans(docs, span):
    where = {}
    for d, x in docs:
        for i in range(len(x or "") - span + 1):
            where.setdefault(x[i : i + span], set()).add(d)
    out = set()
    for d, x in docs:
        covered = [False] * len(x or "")
        for i in range(len(covered) - span + 1):
            if len(where[x[i : i + span]]) > 1:
                covered[i : i + span] = [True] * span
        i = 0
        while i < len(covered):
            if covered[i]:
                j = i
                while j < len(covered) and covered[j]:
                    j += 1
                out.add((d, i, j))
                i = j
            i += 1
    return out


def test_spans_as_brute_force(spark):
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdeé漢𝛼 \n") for _ in range(n))
    shared = [noise(rng.randint(25, 120)) for _ in range(6)] + ["x" * 90, "yz" * 60]
    docs = []
    for d in range(40):
        parts = [noise(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 2)
            parts += [s[a : a + rng.randint(10, 120)], noise(rng.randint(0, 40))]
        docs.append((d, "".join(parts)))
    docs += [(100, docs[0][1]), (101, docs[1][1]), (102, None), (103, ""), (104, "short")]
    df = spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, text string, start int")
    out = {tuple(r) for r in spans.shared_spans(df, "doc_id", "text", span=24).collect()}
    assert out == brute_spans(docs, 24) and len(out) > 20
    assert spans.shared_spans(df.limit(0), "doc_id", "text", span=24).count() == 0


def test_anchors_by_segments_cover_the_same(monkeypatch):
    monkeypatch.setattr(spans, "SEGMENT", 64)
    text = "".join(random.Random(2).choice("abc") for _ in range(900))
    start, last, _, _ = spans.anchors_of(text, 200)
    covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(start, last)])
    assert list(covered) == list(range(len(text) - 200 + 1))


# The registered queries
@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_queries_run(spark, data, name):
    df = Q.QUERIES[name](spark, data)
    per_row = {"p7_ids": "documents", "p7_roundtrip": "documents", "p8_mix": "documents", "p9_shares": "documents", "p6_splits": "raw_records"}
    n = df.count()
    assert n > 0 and len(set(df.columns)) == len(df.columns)
    if name in per_row:
        assert n == spark.read.parquet(f"{data}/{per_row[name]}.parquet").count()
