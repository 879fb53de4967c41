"""The source audit, the hard negatives and the quality rules against plain versions, with awkward rows."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from discern.llm.common import read
from tests.llm.test_operators import DOCS, awkward, prose


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def same(df, other):
    return sorted(map(str, df.collect())) == sorted(map(str, other.collect()))


# ---- transducer


@given(st.sets(st.binary(min_size=1, max_size=6), max_size=60), st.lists(st.binary(max_size=7), max_size=20))
@settings(max_examples=120, deadline=None)
def test_transducer(words, others):
    from discern.llm.transducer import Transducer

    words = sorted(words)
    place = {w: i for i, w in enumerate(words)}
    made = Transducer.from_bytes(Transducer.build(words).to_bytes())
    assert made.ordinals(words + others).tolist() == [place.get(w, -1) for w in words + others]
    assert [made.word(i) for i in range(len(words))] == words


def test_transducer_is_minimal():
    from discern.llm.transducer import Transducer

    words = [a + b + c for a in (b"a", b"b", b"c") for b in (b"", b"x") for c in (b"ed", b"ing")]
    made = Transducer.build(sorted(words))
    # a state of the minimal automaton for each distinct set of endings
    endings = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in {w[:k] for w in words for k in range(len(w) + 1)}}
    assert len(made.final) == len(endings)
    with pytest.raises(ValueError):
        Transducer.build([b"b", b"a"])
    with pytest.raises(ValueError):
        Transducer.build([b"a", b"a"])


# ---- source audit


def plain_audit(rows, least=3, top=200):
    rows = [(t or "", lang or "", source or "") for t, lang, source in rows]
    words = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t, _, _ in rows]
    out = []
    for lang in {r[1] for r in rows}:
        seen = Counter(w for (_, x, _), ws in zip(rows, words) if x == lang for w in set(ws))
        kept = [w for w, n in seen.items() if n >= least]
        counts = {s: Counter() for _, x, s in rows if x == lang}
        for (_, x, s), ws in zip(rows, words):
            if x == lang:
                counts[s].update(w for w in ws if w in set(kept))
        whole = sum(counts.values(), Counter())

        def share(c, kept=kept):
            total = sum(c.values()) + len(kept)
            return {w: 1 + 1_000_000_000 * (c[w] + 1) // total for w in kept}

        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        for s in counts:
            pairs = [(o, sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept)) for o in counts if o != s]
            own = [(w, (p[s][w] - q[w]) ** 2 // q[w]) for w in kept if counts[s][w] > 0 and p[s][w] > q[w]]
            for part, found, most in (("pair", pairs, None), ("term", own, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def answers(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in df.collect())


def test_source_audit(spark, docs, no_docs, sf_dir):
    from discern.llm.source_audit import source_audit

    wanted = plain_audit([(t, lang, source) for _, t, lang, source, *_ in awkward()])
    assert answers(source_audit(docs)) == wanted and any(r[2] == "term" for r in wanted)
    assert answers(source_audit(docs.repartition(7))) == wanted
    assert source_audit(no_docs).count() == 0
    real = read(spark, sf_dir, "documents")
    wanted = plain_audit([(r.text, r.lang, r.source) for r in real.collect()])
    assert answers(source_audit(real)) == wanted
    # many small transducers, blocks of a few ordinals, and words dealt to transducers that stay where they are
    assert answers(source_audit(real, shard_terms=50, cells=400)) == wanted
    assert answers(source_audit(real, shard_terms=50, most_bytes=0)) == wanted
    assert answers(source_audit(docs, shard_terms=3, most_bytes=0)) == answers(source_audit(docs))


def test_source_audit_edges(spark):
    from discern.llm.source_audit import source_audit

    kind = "text string, lang string, source string"
    # no term in three rows: no terms, pairs of value 0, ranked by the source's bytes
    rows = [("alpha beta", "x", "b"), ("gamma", "x", "\U0001f600"), (None, "x", "￮"), ("", None, "only")]
    got = answers(source_audit(spark.createDataFrame(rows, kind)))
    assert got == plain_audit(rows) and len(got) == 6 and {r[4] for r in got} == {0}
    # repeated rows count as rows; a hot row, ties and a group without any kept term
    rows = [("zeta Alpha alpha", "x", "a")] * 500 + [("alpha zeta", "x", "b")] * 3 + [("lone", "x", "c"), ("Ä ä z", "x", "b")]
    table = spark.createDataFrame(rows, kind)
    assert answers(source_audit(table)) == plain_audit(rows) == answers(source_audit(table, most_bytes=0, shard_terms=1))


def test_counts_beyond_64_bit_products():
    import pyarrow as pa

    from discern.llm.source_audit import UNIT, _compare

    n = [[1 << 40, 3], [5, 1 << 39]]
    totals = [sum(x) + 2 for x in n]
    counts = pa.table({"lang": ["x"] * 4, "block": [0] * 4, "source": ["a", "a", "b", "b"], "ordinal": [0, 1, 0, 1], "n": n[0] + n[1]})
    groups = pa.table({"lang": ["x"] * 2, "source": ["a", "b"], "total": totals, "block": [0, 0], "low": [0, 0], "width": [2, 2]})
    p = [[1 + UNIT * (c + 1) // t for c in x] for x, t in zip(n, totals)]
    got = {(r["source"], r["item"]): r["value"] for r in _compare(counts, groups).to_pylist()}
    assert got == {("ab"[i], "ab"[1 - i]): sum((x - y) ** 2 // y for x, y in zip(p[i], p[1 - i])) for i in (0, 1)}


# ---- hard negatives


def plain_negatives(rows, every=4, n_positives=5, n_negatives=10):
    """rows: (id, vector, label), ids not repeated."""
    there = {}
    for i, v, label in rows:
        if i is not None and v and label is not None and all(x is not None and np.isfinite(x) for x in v):
            there[i] = ([int(np.floor(256 * float(x))) for x in v], label)
    out = []
    for a, (x, label) in there.items():
        if a % every:
            continue
        scores = {b: sum(p * q for p, q in zip(x, y)) for b, (y, _) in there.items() if b != a and len(y) == len(x)}
        first = sorted(scores, key=lambda b: (-scores[b], b))
        for p in [b for b in first if there[b][1] == label][:n_positives]:
            inside = [b for b in first if there[b][1] != label and 30 * scores[p] <= 100 * scores[b] <= 90 * scores[p]]
            out += [(a, p, k, b, scores[p], scores[b]) for k, b in enumerate(inside[:n_negatives], 1)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int, id int, row string, width int, part int, asks string"


def clustered(n, seed=3, width=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, width))
    return [(i, (centres[i % 5] + rng.normal(size=width) * 0.05).astype(np.float32).tolist(), int(rng.integers(0, 4))) for i in range(n)]


def odd_vectors():
    rows = clustered(150)
    rows += [(i, rows[8][1], i % 2) for i in range(200, 240)]  # equal vectors: ties
    rows += [(300, None, 1), (301, [1.0, None] + [0.0] * 4, 1), (304, [float("nan")] * 6, 1), (305, [float("inf")] * 6, 1), (306, [], 1),
             (308, [0.5] * 6, None), (None, [0.5] * 6, 1), (312, [0.0] * 6, 1), (316, [-1.0] * 6, 2), (320, [1.0, 2.0], 1), (321, [1.0, 1.0], 1),
             (322, [0.5, 1.0], 2), (324, [3.0], 0)]
    return rows


def mined(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in df.collect())


def test_hard_negatives(spark):
    from discern.llm.hard_negatives import hard_negatives

    rows = odd_vectors()
    table = spark.createDataFrame([(*r, 1, "r", 2, 3, "a") for r in rows], VECTORS)
    wanted = plain_negatives(rows)
    anchors = F.col("vec_id") % 4 == 0
    assert mined(hard_negatives(table, anchors)) == wanted and len(wanted) > 500
    # many shards and blocks, another partitioning
    assert mined(hard_negatives(table.repartition(5), anchors, shard_rows=16, block_anchors=7)) == wanted
    assert hard_negatives(spark.createDataFrame([], VECTORS), anchors).count() == 0
    assert hard_negatives(table, F.lit(None).cast("boolean")).count() == 0
    # repeated rows, one of them a third of the table, are one row; so is an id on several vectors: the least label's
    again = table.unionByName(table).unionByName(spark.createDataFrame([(8, rows[8][1], rows[8][2], 1, "r", 2, 3, "a")] * 200, VECTORS))
    assert mined(hard_negatives(again, anchors)) == wanted
    several = table.unionByName(spark.createDataFrame([(16, [9.0] * 6, 99, 1, "r", 2, 3, "a")], VECTORS))
    assert mined(hard_negatives(several.repartition(4), anchors)) == wanted


def test_hard_negatives_large_components(spark):
    from discern.llm.hard_negatives import hard_negatives

    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=3) * 1e6).astype(np.float32).tolist(), i % 2) for i in range(40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert mined(hard_negatives(table, F.col("vec_id") % 4 == 0, shard_rows=8)) == plain_negatives(rows)


def test_spanning_tree_and_bounds():
    from discern.llm.hard_negatives import spanning_tree, walk

    rng = np.random.default_rng(2)
    points = np.floor(rng.normal(size=(40, 8)) * 100)
    points[7] = points[3]
    parent, length = spanning_tree(points)
    apart = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    assert parent[0] == -1 and all(np.isclose(length[i], apart[i, p]) for i, p in enumerate(parent) if p >= 0)
    # Kruskal's method gives the same total
    group, total = list(range(40)), 0.0
    for d, i, j in sorted((apart[i, j], i, j) for i in range(40) for j in range(i)):
        if group[i] != group[j]:
            total, old = total + d, group[i]
            group = [group[j] if g == old else g for g in group]
    assert np.isclose(length.sum(), total)
    rows = np.floor(rng.normal(size=(300, 8)) * 100)
    seen = set()

    def window(i, low, high):
        exact = rows @ points[i]
        assert (low <= exact).all() and (exact <= high).all()
        return np.flatnonzero(high > 1e5)

    def use(i, which, scores):
        seen.add(i)
        assert (scores == (rows[which] @ points[i])).all()

    walk(points, rows, parent, length, window, use)
    assert seen == set(range(40))


def test_bounds_spare_scores():
    """Where anchors lie close together most candidates are never scored again."""
    from discern.llm.hard_negatives import negatives_in, positives_in, spanning_tree

    rng = np.random.default_rng(4)
    rows = np.floor(rng.normal(size=(4000, 16)) * 256)
    near = np.floor(rows[0] + rng.normal(size=(60, 16)) * 2)
    parent, length = spanning_tree(near)
    shard = {"ids": np.arange(4000), "labels": np.arange(4000) % 3, "rows": rows}
    anchors = {"ids": np.arange(10_000, 10_060), "labels": np.arange(60) % 3, "rows": near, "parent": parent, "length": length}
    found, scored = positives_in(anchors, shard, 5)
    assert len(found) == 300 and scored < 0.1 * 60 * 4000
    lists = defaultdict(list)
    for a, v, s in found:
        lists[a].append((v, s))
    anchors["positives"] = [lists[i] for i in anchors["ids"].tolist()]
    found, scored = negatives_in(anchors, shard, 10, 30, 90)
    assert scored < 0.3 * 60 * 4000 and all(30 * p <= 100 * n <= 90 * p for _, _, p, _, n in found)


# ---- quality rules


def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    again = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    letters = [w for w in words if re.search(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]", w)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(again),
        len(lines), len(letters), len(re.findall("[A-Z]", text)), len(re.findall("[a-z]", text)),
    )


@given(st.lists(st.none() | st.text("ab A#é\n\t\x0b\x1f|\U0001f600", max_size=60), max_size=8))
@settings(max_examples=150, deadline=None)
def test_measures(texts):
    from discern.llm.quality_rules import measure

    assert measure(texts).tolist() == [list(plain_measures(t)) for t in texts]


def test_quality_rules(docs, no_docs):
    from discern.llm.quality_rules import MEASURES, quality_rules

    found = quality_rules(docs)
    got = [tuple(r) for r in found.select("doc_id", *MEASURES).collect()]
    assert sorted(got, key=str) == sorted(((i, *plain_measures(t)) for i, t, *_ in awkward()), key=str)
    for r in found.collect():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed) and (r.only_rule is None) == (bin(r.fail_bits).count("1") != 1)
    assert {r.doc_id for r in found.where("n_words = 0").collect()} == {4, 5, 6, None}
    assert same(quality_rules(docs), quality_rules(docs.repartition(5))) and quality_rules(no_docs).count() == 0
    hot = docs.limit(1).crossJoin(docs.sparkSession.range(400).select(F.col("id").alias("n"))).drop("n")
    assert quality_rules(hot).distinct().count() == 1 and quality_rules(hot).count() == 400


def test_policies_and_ablations(spark, docs):
    from discern.llm.quality_rules import BASE, POLICIES, RULES, ablations, apply_policy, ledger, mask

    text = " ".join(f"{w}ing" for w in prose(5, 120).split())
    rows = [(1, text), (2, text.upper()), (3, " ".join(f"{w}$$$" for w in text.split())), (4, "short"), (5, " | ".join(text.split())), (6, (text + "\n") * 12), (7, None)]
    entries = ledger(spark.createDataFrame(rows, "doc_id long, text string"))
    bits = {r.doc_id: r.fail_bits for r in entries.collect()}
    names = {i: {n for k, (n, _) in enumerate(RULES) if b >> k & 1} for i, b in bits.items()}
    assert names[1] == set() and names[2] == {"upper_case"} and "symbols" in names[3] and names[4] == {"few_words"}
    assert "few_letter_words" in names[5] and {"duplicate_lines", "repeated_words"} <= names[6] and names[7] == {"few_words"}
    for version, policy in POLICIES.items():
        kept = {r.doc_id: r.kept for r in apply_policy(entries, version).collect()}
        assert kept == {i: not names[i] & {*policy, *BASE} for i in bits}
        # each policy is judged from the stored bits, rule by rule
        for r in ablations(entries).where(F.col("version") == version).collect():
            asked = {*policy, *BASE}
            without = asked - {r.rule}
            assert r.n_docs == 7 and r.n_kept == sum(not names[i] & asked for i in bits)
            assert r.n_failed == sum(r.rule in names[i] for i in bits) and r.n_kept_without == sum(not names[i] & without for i in bits)
            assert r.n_only == sum(names[i] & asked == {r.rule} for i in bits)
    assert ablations(entries).count() == sum(len({*p, *BASE}) for p in POLICIES.values())
    with pytest.raises(ValueError):
        mask(["no such rule"])
    assert ablations(ledger(docs.limit(0))).count() == 0


def test_clean_documents_stay(spark):
    """Held against the labelled documents: junk goes, good ones of 50 words stay."""
    from discern.llm.quality_rules import quality_rules

    directory = "/root/testdata/sf0.01"
    found = quality_rules(read(spark, directory, "documents")).join(read(spark, directory, "labels"), "doc_id")
    good = found.where("quality = 1 AND n_words >= 50").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    junk = found.where("quality = 0").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert good > 0.99 and junk < 0.02
