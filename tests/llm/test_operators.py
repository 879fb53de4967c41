"""Each numbered operator against a plain version, on small tables with awkward rows."""

import hashlib
import platform
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from discern.llm.common import read

WORDS = "the of and to in that is was for on are with as his they at be this from have or by one had not but what all were when".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, key string, id int, label string, run long, band int"


def prose(seed: int, words: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, words))


def awkward():
    """Null, empty, blank, tiny, very long, equal and repeated texts; null and repeated ids; columns that clash."""
    long = prose(1, 30_000)
    rows = [
        (1, prose(2, 80)), (2, prose(2, 80)), (3, prose(2, 78) + " end here"), (4, None), (5, ""), (6, " \t\n"), (7, "One two"), (8, "one  TWO"),
        (9, long), (10, long + " more"), (11, "ünïcödé \u00a0 \U0001f600 wörds " * 30), (12, "a" * 500), (13, "ab" * 300), (13, "ab" * 300),
        (None, prose(2, 80)), (None, None), (None, "alone here"), (20, prose(3, 90)), (21, prose(3, 90)), (22, "12345 !!"), (23, "x\x00y " * 60),
    ]
    langs, sources = ["en", None, "de"], ["a", "b", None, "c"]
    return [(i, t, langs[k % 3], sources[k % 4], 7, 1, "k", 2, "l", 3, 4) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def texts_by_id(rows):
    return sorted((r[0], r[1]) for r in rows if r[0] is not None)


# ---- language ID


def test_language_id(spark, docs, no_docs):
    from discern.llm import language_id as L

    lands = {"en": "the and of that with", "de": "der und nicht ein ist", "fr": "les des une dans que"}
    rows = [(k, " ".join(np.random.default_rng(k).choice(lands[n].split(), 30)), n) for k, n in enumerate(list(lands) * 40)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = L.identify(table, F.col("doc_id") % 4 == 2).join(table, "doc_id").collect()
    assert len(got) == 120 and all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in got)
    found = L.identify(docs, F.col("doc_id") % 4 == 2)
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"]
    got = found.collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in awkward())
    assert all((r.lang_pred == "und") == (r.doc_id in (4, 5, 6, 22)) for r in got if r.doc_id)
    assert L.identify(no_docs, F.lit(False)).count() == 0
    everything_held_out = L.identify(docs, F.lit(True)).collect()
    assert {(r.lang_pred, r.score) for r in everything_held_out} == {("und", 0.0)}


def test_kernel_is_the_blended_spectrum():
    from discern.llm import language_id as L

    texts = ["the cat", "the dog sat", "le chat", "der hund"]
    presence = L.Presence([np.unique(np.concatenate([L.grams(t)[n] for t in texts])) for n in range(L.LONGEST)])
    places, counts, own = presence.of(texts)
    rows = np.zeros((4, presence.size))
    rows[np.repeat(np.arange(4), counts), places] = 1
    sets = [[{w for w in L.grams(t)[n].tolist()} for n in range(L.LONGEST)] for t in texts]

    def kernel(a, b):
        return sum(L.WEIGHTS[n + 1] * len(sets[a][n] & sets[b][n]) for n in range(L.LONGEST))

    for a in range(4):
        assert own[a] == kernel(a, a)
        other = presence.product(texts, (rows[a] * np.concatenate([[L.WEIGHTS[n + 1]] * len(v) for n, v in enumerate(
            [np.unique(np.concatenate([L.grams(t)[n] for t in texts])) for n in range(L.LONGEST)])]))[:, None])
        assert np.allclose(other[:, 0] * np.sqrt(own), [kernel(a, b) for b in range(4)])


# ---- mixing


def plain_targets(sizes, share=1.5, limit=2.0, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, left, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > limit * sizes[s]}
        for s in full or open_:
            target[s] = limit * sizes[s] if full else weight[s] * level
        if not full:
            break
        left -= sum(target[s] for s in full)
        open_ -= full
    return target


def test_mixing(spark, docs, no_docs, sf_dir):
    from discern.llm.mixing import BLOCK, mix

    real = read(spark, sf_dir, "documents")
    for table in (docs, real):
        got = mix(table).collect()
        assert len(got) == table.count() and sorted(map(str, got)) == sorted(map(str, mix(table.repartition(5)).collect()))
        sizes, taken = defaultdict(int), defaultdict(int)
        for r in got:
            sizes[r.source] += r["size"]
            taken[r.source] += r.taken
            assert 0 <= r.taken <= 2 * r["size"]
        wanted = plain_targets(sizes)
        for r in got:
            assert r.source_size == sizes[r.source] and r.target == pytest.approx(wanted[r.source])
        assert all(abs(taken[s] - wanted[s]) <= 3 * BLOCK for s in sizes)
    count = {r.doc_id: r["size"] for r in mix(docs).collect() if r.doc_id}
    assert all(count[i] == len((t or "").encode().split()) for i, t, *_ in awkward() if i)
    assert mix(no_docs).count() == 0


@pytest.mark.parametrize("words", [1, 10, 64, 100, 1000])
def test_mixing_of_many_small_sources(spark, words):
    """Every source comes within one document, or a thirtieth of its size, of its target."""
    from discern.llm.mixing import mix

    a_doc = min(words, 20)
    rows = [(s * 1000 + k, prose(s * 100 + k, a_doc), f"s{s:03d}") for s in range(120) for k in range(words // a_doc)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    target, taken = {r.source: r.target for r in got}, Counter()
    for r in got:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r["size"]
    assert all(abs(taken[s] - t) <= max(a_doc, words / 30) for s, t in target.items())
    assert abs(sum(taken.values()) - sum(target.values())) <= 0.02 * sum(target.values())


@given(st.lists(st.integers(1, 40), min_size=1, max_size=6), st.integers(0, 90))
@settings(max_examples=60, deadline=None)
def test_sainte_lague(votes, seats):
    from discern.llm.mixing import sainte_lague

    most = [2 * v for v in votes]
    won = [0] * len(votes)
    for _ in range(min(seats, sum(most))):
        best = max((i for i in range(len(votes)) if won[i] < most[i]), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        won[best] += 1
    assert sainte_lague(np.array(votes), seats, np.array(most)).tolist() == won


# ---- MinHash


def plain_components(rows, width, percent):
    """Brute force: links on full shingle sets, then the least id reachable."""

    def grams(text):
        w = (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()
        if not w:
            return frozenset()
        return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))

    sets = [(i, grams(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((root(i), root(j)))
                parent[hi] = lo
    return {i: (len(x), root(i)) for i, x in sets}


def test_minhash(spark, docs, no_docs):
    from discern.llm.minhash import near_duplicates

    got = near_duplicates(docs, width=4).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in awkward())
    want = plain_components(texts_by_id(awkward()), 4, 80)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)
    assert sorted((r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is None and r.component_id) == [(77, 1, False)]
    assert all(r.kept for r in got if r.doc_id is None and r.component_id is None)
    assert near_duplicates(no_docs).count() == 0


def test_words_that_a_polynomial_takes_for_one(spark):
    """Two words of 1024 letters that have one value under every polynomial modulo 2**64."""
    from discern.llm.minhash import near_duplicates

    word = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, word + " x"), (4, word)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 3, 4: 1}


def test_minhash_chain_and_crowded_bucket(spark):
    """A chain of small changes whose ends are far apart, and a crowd around one text."""
    from discern.llm.minhash import near_duplicates

    base = prose(5, 300).split()
    rows = [(k, " ".join(["new%d" % j for j in range(6 * k)] + base[6 * k :])) for k in range(12)]
    rng = np.random.default_rng(6)
    for k in range(60):
        words = list(prose(7, 200).split())
        for at in rng.choice(200, 4, replace=False):
            words[at] = f"w{k}x{at}"
        rows.append((100 + k, " ".join(words)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(table).collect()}
    assert got == {i: c for i, (_, c) in plain_components(rows, 5, 80).items()}


# ---- suffix arrays


def plain_removed(rows):
    seen, out = {}, {}
    for i, text in sorted(rows):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in seen:
                gone[p : p + 100] = True
            else:
                seen[w] = p
        out[i] = bytes(np.frombuffer(raw, np.uint8)[~gone])
    return out


def test_suffix(spark, docs, no_docs):
    from discern.llm import suffix as S

    got = S.remove_repeats(docs, carry=("doc_id", "key", "run", "text")).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in awkward())
    want = plain_removed({(i, t or "") for i, t, *_ in awkward() if i is not None})
    for r in got:
        raw = (r.text or "").encode()
        assert r.n_bytes == len(raw) and (r.key, r.run) == ("k", 3)
        assert r.kept == (want[r.doc_id] if r.doc_id is not None else raw)
        assert r.n_bytes - len(r.kept) == sum(s["to"] - s["from"] for s in r.removed)
    assert S.remove_repeats(no_docs).count() == 0
    decoded = S.remove_repeats(docs, as_text=True).collect()
    assert all(isinstance(r.kept, str) for r in decoded)


@pytest.mark.parametrize("contexts", [4096, 2])
def test_suffix_judges_repeated_ids(spark, docs, monkeypatch, contexts):
    """Copies are one document; different texts under one id follow each other."""
    from discern.llm import suffix as S

    monkeypatch.setattr(S, "SHARD_CONTEXTS", contexts)
    want = plain_removed({(i, t or "") for i, t, *_ in awkward() if i is not None})
    got = S.remove_repeats(docs, carry=("doc_id", "text")).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in awkward()) and len(want[13]) < 600
    assert all(r.kept == (want[r.doc_id] if r.doc_id is not None else (r.text or "").encode()) for r in got)

    line = "this line of about one hundred and ten bytes is found in every document of the table and repeats again"
    rows = [(k, f"{prose(k, 12)} {line} {prose(k % 5, 9)} {prose(99, 4)}") for k in range(20)]
    twice = spark.createDataFrame(rows + rows, "doc_id long, text string").repartition(3)
    once = plain_removed(rows)
    assert Counter((r.doc_id, bytes(r.kept)) for r in S.remove_repeats(twice).collect()) == Counter({x: 2 for x in once.items()})

    rows += [(3, f"other words {line} and {prose(98, 30)}"), (3, f"third {prose(98, 30)}"), (3, rows[3][1]), (3, None), (30, prose(98, 30))]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    texts = {(i, t or "") for i, t in rows}
    tie = {tuple(r[:2]): r[2] for r in spark.createDataFrame(sorted(texts), "doc_id long, text string").select("doc_id", "text", F.xxhash64("text")).collect()}
    order = sorted(texts, key=lambda x: (x[0], tie[x]))
    want = {x: kept for x, kept in zip(order, plain_removed([(n, t) for n, (_, t) in enumerate(order)]).values())}
    got = S.remove_repeats(table, carry=("doc_id", "text")).collect()
    assert len(got) == len(rows) and all(r.kept == want[r.doc_id, r.text or ""] for r in got)


def test_suffix_with_a_frequent_line_over_several_shards(spark, monkeypatch):
    from discern.llm import suffix as S

    monkeypatch.setattr(S, "SHARD_CONTEXTS", 4)
    line = "this line of about one hundred and ten bytes is found in every document of the table and repeats again"
    rows = [(k, f"{prose(k, 12)} {line} {prose(k % 5, 9)} {prose(99, 4)}") for k in range(60)]
    got = {r.doc_id: r.kept for r in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_removed(rows)


def test_suffix_in_small_shards_and_slices(spark, monkeypatch):
    """Where a shard, a slice or a batch ends changes nothing."""
    from discern.llm import suffix as S

    rows = [(k, None if k == 7 else f"{prose(k, 12)} {prose(k % 5, 30)} é {prose(k % 3, 25)} {prose(99, 30)}") for k in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    monkeypatch.setattr(S, "SHARD_BYTES", 700)
    monkeypatch.setattr(S, "SLICE_BYTES", 1500)
    got = S.remove_repeats(table, carry=("doc_id", "text")).collect()
    assert {(r.doc_id, r.text) for r in got} == set(rows) and {r.doc_id: bytes(r.kept) for r in got} == plain_removed(rows)


@pytest.mark.skipif(platform.libc_ver()[0] != "glibc", reason="only glibc gives pages back on demand")
def test_a_worker_gives_back_what_a_task_has_freed():
    from discern.llm import common as C

    def held():
        return next(int(line.split()[1]) for line in open("/proc/self/status") if line.startswith("RssAnon")) / 1024

    pins = []

    def run(batches):
        for batch in batches:
            texts = [bytes(2000) for _ in range(50_000)]
            pins.append(bytes(2000))  # above the freed ones, which so stay in the process
            del texts
            yield batch

    C.give_back()
    before = held()
    plain, after_plain = list(run([1, 2])), held()
    assert list(C.lean(run)([1, 2])) == plain == [1, 2]
    assert after_plain - before > 60 and held() - before < 30


def test_a_suffix_shard_takes_little_memory():
    """Three megabytes of contexts of many anchors, in a peak that does not grow with them."""
    import tracemalloc

    import pyarrow as pa

    from discern.llm import suffix as S

    texts = np.random.default_rng(5).integers(97, 123, (18_000, 160), np.uint8)
    texts[1::2] = texts[::2]  # two contexts of one anchor differ in one byte
    texts[1::2, 120] = 48
    n = len(texts)
    columns = {"key": np.arange(n) // 2, "shard": np.zeros(n, int), "shards": np.ones(n, int), "doc_id": np.arange(n), "tie": np.zeros(n, int), "start": np.zeros(n, int)}
    table = pa.table({**columns, "bytes": pa.array([t.tobytes() for t in texts], pa.binary())})
    tracemalloc.start()
    found = pa.Table.from_batches(list(S._shards(iter(table.to_batches(max_chunksize=5000)))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # of each pair the windows before the changed byte start again in the second
    assert sorted(zip(*(found[c].to_pylist() for c in ("doc_id", "first", "last")))) == [(d, 0, 20) for d in range(1, n, 2)]
    assert peak < 180e6


@given(st.binary(min_size=1, max_size=300), st.integers(1, 4))
@settings(max_examples=60, deadline=None)
def test_suffix_array_and_common_prefixes(data, times):
    from discern.llm import suffix as S

    data = bytes(b % 3 for b in data) * times
    order, place = S.suffix_array(np.frombuffer(data, np.uint8))
    assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
    assert place[order].tolist() == list(range(len(data)))

    def common(a, b):
        n = 0
        while n < 100 and max(a, b) + n < len(data) and data[a + n] == data[b + n]:
            n += 1
        return n

    shared = S.common_prefixes(np.frombuffer(data, np.uint8), order, place, 100, lane=17)
    assert shared.tolist() == [0] + [common(order[k - 1], order[k]) for k in range(1, len(data))]


# ---- top-k


VECTORS = "vec_id long, embedding array<float>, label int, id int, vector string, score double"


def awkward_vectors():
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=6).tolist()) for k in range(120)]
    rows += [(k, rows[3][1]) for k in range(120, 130)]  # ties
    rows += [(200, None), (201, []), (202, [0.0] * 6), (203, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (204, [float("nan")] * 6), (205, [float("inf")] * 6)]
    rows += [(206, [1.0, 2.0]), (250, [2.0, 1.0]), (None, rows[3][1]), (7, rows[7][1]), (207, [3e8] * 6), (208, [-3e8] * 6)]
    return [(i, v, 1, 2, "v", 0.5) for i, v in rows]


def test_top_k(spark):
    from discern.llm.top_k import top_k

    rows = awkward_vectors()
    table = spark.createDataFrame(rows, VECTORS).repartition(4)
    fine = {i: v for i, v, *_ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    whole = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v in fine.items()}
    want = []
    for q in whole:
        if q % 50 == 0:
            scores = [(-sum(a * b for a, b in zip(whole[q], w)), i) for i, w in whole.items() if i != q and len(w) == len(whole[q])]
            want += [(q, k, i, -s) for k, (s, i) in enumerate(sorted(scores)[:5], 1)]
    for shard_rows in (16, 1024):
        assert sorted(tuple(r) for r in top_k(table, F.col("vec_id") % 50 == 0, shard_rows=shard_rows).collect()) == sorted(want)
    assert top_k(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("shard_rows", [8, 1024])
def test_top_k_with_repeated_ids_among_the_best(spark, shard_rows):
    """Equal and different vectors under the best ids take one place each."""
    from discern.llm.top_k import top_k

    rng = np.random.default_rng(8)
    rows = [(k, rng.normal(size=6).tolist()) for k in range(60)]
    best = [3.0 * x for x in rows[0][1]]
    rows += [(70, best)] * 9 + [(71, [x * (1 + k / 10) for x in best]) for k in range(9)] + [(72, best)] * 6
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    whole = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows]
    want = []
    for q in (0, 50):
        query, scores = next(v for i, v in whole if i == q), {}
        for i, v in whole:
            if i != q:
                scores[i] = max(scores.get(i, -(1 << 62)), sum(a * b for a, b in zip(query, v)))
        want += [(q, k, i, s) for k, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:5], 1)]
    got = top_k(table, F.col("vec_id").isin(0, 50), shard_rows=shard_rows)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("shard_rows", [8, 1024])
def test_top_k_of_query_ids_on_several_vectors(spark, shard_rows):
    """Every vector of a query id asks, whatever the order of the rows."""
    from discern.llm.top_k import top_k

    rng = np.random.default_rng(9)
    rows = [(k, rng.normal(size=6).tolist()) for k in range(60)] + [(0, rng.normal(size=6).tolist()) for _ in range(4)]
    rows += [(50, [1.0, 2.0]), (61, [3.0, 2.0])]
    whole = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows]
    want = []
    for q in (0, 50):
        scores = {}
        for query in (v for i, v in whole if i == q):
            for i, v in whole:
                if i != q and len(v) == len(query):
                    scores[i] = max(scores.get(i, -(1 << 62)), sum(a * b for a, b in zip(query, v)))
        want += [(q, k, i, s) for k, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:5], 1)]
    for parts in (1, 3, 7):
        table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(parts)
        got = top_k(table, F.col("vec_id").isin(0, 50), shard_rows=shard_rows)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)


# ---- quality


def test_quality(spark, docs, no_docs):
    from discern.llm import quality as Q

    rows = []
    for k in range(160):
        good = prose(k, 40 + k % 7 * 60)
        rows.append((k, good if k % 2 else good.upper().replace(" ", "!! ")))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(160)] + [(5, 1), (None, 0), (7, None), (9, 3)], "doc_id long, quality int")
    got = Q.rate_quality(table, labels, F.col("doc_id") % 3 == 1).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 160 and np.mean([r.predicted == r.doc_id % 2 for r in held]) > 0.95
    assert all((r.score >= 0.5) == (r.predicted == 1) and 0 <= r.score <= 1 for r in got)
    rated = Q.rate_quality(docs, labels, F.lit(False)).collect()
    assert Counter(r.doc_id for r in rated) == Counter(r[0] for r in awkward())
    assert Q.rate_quality(no_docs, labels, F.lit(False)).count() == 0
    assert {r.score for r in Q.rate_quality(docs, labels.limit(0), F.lit(False)).collect()} == {0.5}


@given(st.integers(0, 5000))
@settings(max_examples=40, deadline=None)
def test_chunks_cover_the_text(n):
    from discern.llm import quality as Q

    text = bytes(k % 251 + 1 for k in range(n))
    cut = Q.chunks(text)
    again = cut[0].tobytes() + b"".join(c[Q.CHUNK - Q.HOP :].tobytes() for c in cut[1:])
    assert again.rstrip(b"\0") == text


# ---- sharding


def test_sharding(spark, docs, no_docs, sf_dir):
    from discern.llm.sharding import shard_documents

    for table in (docs, read(spark, sf_dir, "documents")):
        source = table.collect()
        got = shard_documents(table).collect()
        assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in source)
        wanted = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in source)
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == wanted
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
            assert 0 <= r.shard < 8 and r.law == "bytes" and r.grown_shard is None
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shard_documents(no_docs).count() == 0


def test_sharding_balance_copies_and_movement(spark):
    from discern.llm.sharding import shard_documents

    rows = [(k, "x" * 20 if k < 600 else prose(k, 30)) for k in range(6000)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = shard_documents(table, slack=0.01).collect()
    size = Counter()
    for r in got:
        size[r.shard] += r["size"]
    assert max(size.values()) <= 1.02 * sum(size.values()) / 8 and min(size.values()) > 0.9 * sum(size.values()) / 8
    assert len({r.shard for r in got if r.doc_id < 600}) == 1  # copies that fit stay together
    before = {r.doc_id: r.shard for r in got}
    after = {r.doc_id: r.shard for r in shard_documents(table, shards=9, slack=0.01).collect()}
    assert sum(before[i] != after[i] for i in before) < 0.25 * len(before)


@pytest.mark.parametrize("hot", [(1, "one hot text of some words"), (None, None), (None, "text without id")])
def test_sharding_divides_a_row_that_fills_half_the_table(spark, hot):
    from discern.llm.sharding import shard_documents

    rows = [hot] * 6000 + [(k, prose(k, 5) + str(k)) for k in range(10, 3010)]
    results = []
    for parts in (1, 4, 13):
        table = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        results.append(shard_documents(table).collect())
    assert len({tuple(sorted(map(str, r))) for r in results}) == 1
    size, slots = Counter(), defaultdict(list)
    for r in results[0]:
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    share = sum(size.values()) / 8
    assert len(size) == 8 and max(size.values()) <= 1.02 * share and min(size.values()) >= 0.95 * share
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter(r.doc_id for r in results[0]) == Counter(i for i, _ in rows)


def test_sharding_divides_nothing_but_the_hot_group(spark, monkeypatch):
    """A cell that a hot text shares with small groups of copies leaves them together."""
    from discern.llm import sharding

    monkeypatch.setattr(sharding, "CELLS", 1)
    rows = [(k, "hot " * 30) for k in range(4000)] + [(10_000 + k, f"small {k % 50}") for k in range(500)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    homes = defaultdict(set)
    for r in got:
        homes[r.text_crc32].add(r.shard)
    hot = zlib.crc32(b"hot " * 30)
    assert len(homes.pop(hot)) == 8 and all(len(h) == 1 for h in homes.values())


# ---- lattice hashing


def test_lattice(spark):
    from discern.llm.lattice import near_vectors

    rng = np.random.default_rng(8)
    rows = [(i, v) for i, v, *_ in awkward_vectors()]
    for k in range(300, 420):
        near = rng.normal(size=6) if k % 4 == 0 else near + rng.normal(size=6) * 0.1
        rows.append((k, near.tolist()))
    table = spark.createDataFrame([(i, v, 1, 2, "v", 0.5) for i, v in rows], VECTORS).repartition(4)
    fine = {i: np.array(v, np.float32).astype(float) for i, v in rows
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    parent = {i: i for i, _ in rows if i is not None}
    links = Counter()

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in fine.items():
        for j, y in fine.items():
            if i < j and len(x) == len(y) and x @ y >= 0.9 * np.sqrt((x @ x) * (y @ y)):
                links[i] += 1
                links[j] += 1
                lo, hi = sorted((root(i), root(j)))
                parent[hi] = lo
    got = near_vectors(table).collect()
    assert Counter(r.vec_id for r in got) == Counter(i for i, _ in rows)
    for r in got:
        if r.vec_id is not None:
            assert (r.n_links, r.component_id, r.kept) == (links[r.vec_id], root(r.vec_id), root(r.vec_id) == r.vec_id), r
        else:
            assert (r.n_links, r.component_id, r.kept) == (0, None, True)
    assert near_vectors(table.limit(0)).count() == 0


def test_lattice_with_an_id_on_several_vectors(spark):
    """Each vector of the id has its own links and component, whatever the order of the rows."""
    from discern.llm.lattice import near_vectors

    one, two, three = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0]
    close = [1.0, 0.05, 0.0, 0.0]
    rows = [(5, one), (5, two), (5, two), (6, close), (7, two), (8, three), (5, three), (9, [0.0, 0.0, 0.0, 1.0])]
    want = {(5, 1, 5, True), (5, 1, 5, True), (6, 1, 5, False), (7, 1, 5, False), (8, 1, 5, False), (9, 0, 9, True)}
    for parts in (1, 2, 3, 5):
        table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(parts)
        got = near_vectors(table).collect()
        assert len(got) == len(rows) and {tuple(r) for r in got} == want


def test_e8_decoder_and_neighbours():
    from discern.llm import lattice as L

    steps = L.shortest_vectors()
    assert len({tuple(s) for s in steps.tolist()}) == 240 and set((steps**2).sum(axis=1).tolist()) == {8}
    x = np.random.default_rng(1).normal(size=(200, 8)) * 3
    point = L.decode(x)
    assert ((point % 2 == point[:, :1] % 2).all()) and ((point.sum(axis=1) % 4) == 0).all()
    own = ((2 * x - point) ** 2).sum(axis=1)
    assert (own <= 4 + 1e-9).all()  # the covering radius is one
    assert (own[:, None] <= ((2 * x[:, None] - point[:, None] - steps[None]) ** 2).sum(axis=2) + 1e-9).all()


# ---- URL filter


def plain_url(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, after = rest[:cut], rest[cut:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = after[: min([after.find(c) for c in "?#" if c in after] or [len(after)])]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_url_filter(spark):
    from discern.llm.queries import URL_RULES
    from discern.llm.url_filter import filter_urls

    urls = [None, "", "no scheme", "http://", "HTTP://A.B.NET", "http://x.net/", "https://Example.NET/en/a?b=/c", "https://www.example.net/en", "http://notexample.net/en/x",
            "http://de.example.com/de/", "http://example.com/de/a#b", "http://x.org/fr/1", "http://org/fr/", "http://x.net?/en/", "http://x.net#a/b", "a://b://c.net/d",
            "http://Ünï.NET/Ü", "http://x.net./", "http://" + "a." * 2000 + "net/" + "p/" * 3000, "http://x.com/de/", "http://x.net/"]
    rows = [(k if k % 7 else None, u, "x", "y", 1) for k, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string, size int").repartition(3)
    more = [(f"h{k}.example.org", f"/p{k}/", "block") for k in range(300)] + [("example.org", "", "block"), (None, "/", "block"), ("a", None, "block")]
    for listed in (URL_RULES, URL_RULES + more):
        rules = spark.createDataFrame(listed, "host string, path string, verdict string")
        plain = [r for r in listed if None not in r]
        got = filter_urls(pages, rules, keep=("page_id", "url"))
        assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
        want = [(p, u, *plain_url(u, plain)) for p, u, *_ in rows]
        assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {(r.rule, r.verdict) for r in filter_urls(pages, none).collect()} == {(None, "allow")}
    assert filter_urls(pages.limit(0), spark.createDataFrame(URL_RULES, "host string, path string, verdict string")).count() == 0


# ---- packing


def test_packing_holds_little_text_at_once(spark, monkeypatch):
    """Texts reach a worker in small Arrow batches and its encoder in small slices; the session keeps its own limit."""
    from discern.llm import packing as P

    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, texts = spark.conf.get(limit), [f"{k} " + "some words here " * 125 for k in range(4000)]

    def pieces(*_):
        def run(batches):
            for batch in batches:
                n = batch.num_rows
                columns = [batch.column(0), pa.array([0] * n, pa.int32()), *[pa.array([v] * n, pa.int64()) for v in (batch.nbytes, 1, 0)]]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

        return run

    seen = []

    class Counting:
        def __init__(self, path):
            pass

        def encode(self, texts):
            seen.append(sum(map(len, texts)))
            return [np.arange(len(t) % 7, dtype=np.int32) for t in texts]

    with monkeypatch.context() as patched:
        patched.setattr(P, "Encoder", Counting)
        batch = pa.RecordBatch.from_arrays([pa.array(range(4000), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
        found = [i for rows in P._pieces("counting", 1024, 2)(iter([batch])) for i in rows.column(0).to_pylist()]
    assert found == list(range(4000)) and max(seen) <= 250_000
    table = spark.createDataFrame(enumerate(texts), "doc_id long, text string").coalesce(1)
    with monkeypatch.context() as patched:
        patched.setattr(P, "_pieces", pieces)
        got = P.pack(table, "").select("doc_id", "start").collect()
    assert sorted(r.doc_id for r in got) == list(range(4000)) and max(r.start for r in got) < 4_000_000
    assert spark.conf.get(limit) == before


def test_packing(spark, docs, no_docs):
    from tokenizers import Tokenizer

    from discern.llm.packing import pack
    from discern.llm.queries import tokenizer_path

    plain = Tokenizer.from_file(tokenizer_path())
    got = pack(docs, tokenizer_path(), size=64, shard_pieces=100).collect()
    texts = defaultdict(list)
    for i, t, *_ in awkward():
        texts[i].append(t)
    pieces = Counter()
    for i, own in texts.items():
        for t in own:
            ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
            first = len(ids) % 64 or 64
            starts = [0, *range(first, len(ids), 64)]
            for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                pieces[(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in got) == pieces
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in got)
    assert len(bins) <= -(-total // 64) + len({r.sequence_id >> 32 for r in got}) + 1
    assert pack(no_docs, tokenizer_path()).count() == 0


@given(st.text(alphabet=st.sampled_from("abZ '\n\t1²é\u3000!?s定'😀\x1c\u00a0trevld"), max_size=60), st.text(max_size=20))
@settings(max_examples=150, deadline=None)
def test_encoder_agrees_with_the_tokenizer(text, other):
    from discern.llm.packing import Encoder
    from discern.llm.queries import tokenizer_path

    encoder = test_encoder_agrees_with_the_tokenizer.__dict__.setdefault("encoder", None) or Encoder(tokenizer_path())
    test_encoder_agrees_with_the_tokenizer.__dict__["encoder"] = encoder
    other = other.encode("utf-8", "ignore").decode()
    texts = [text, other, "", text + "<|endoftext|>" + text]
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in encoder.encode(texts)] == want


@given(st.lists(st.integers(1, 50), max_size=80))
@settings(max_examples=80, deadline=None)
def test_best_two_fit(lengths):
    from discern.llm.packing import best_two_fit

    bins = best_two_fit(lengths, 50)
    assert sorted(x for b in bins for x in b) == sorted(lengths) and all(sum(b) <= 50 for b in bins)
    greedy = []
    for x in sorted(lengths, reverse=True):
        for b in greedy:
            if sum(b) + x <= 50:
                b.append(x)
                break
        else:
            greedy.append([x])
    assert len(bins) <= len(greedy) + 1


def test_contract_digests(spark, sf_dir):
    """The digest columns of op4 follow from the operator's bytes."""
    from discern.llm import queries as Q

    small = {r.doc_id: r for r in Q.op4_suffix(spark, sf_dir).collect()}
    source = [(r.doc_id, r.text) for r in read(spark, sf_dir, "documents").collect()]
    for i, kept in plain_removed(source).items():
        assert small[i].kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_words_that_a_polynomial_takes_for_one_keep_their_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from discern.llm.packing import Encoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    other, plain, encoder = word.translate(str.maketrans("ab", "ba")), Tokenizer.from_file(path), Encoder(path)
    for text in (word, other, word + " " + other):
        assert encoder.encode([text])[0].tolist() == plain.encode(text, add_special_tokens=False).ids


def test_copies_of_one_row_spread_over_the_shards(spark):
    import public_tokenizers

    from discern.llm.packing import pack

    docs = spark.createDataFrame([(5, prose(5, 30))] * 900 + [(k, prose(k, 40)) for k in range(300)], "doc_id long, text string").repartition(4)
    got = pack(docs, public_tokenizers.path("byte_bpe_50k.json"), shard_pieces=200)
    shards = Counter(r.sequence_id >> 32 for r in got.collect())
    assert len(shards) == 6 and max(shards.values()) <= 300
