"""The training sample, the language regression and the quality network against plain versions."""

import numpy as np
from pyspark.sql import functions as F

from tests.llm.test_operators import prose


def plain_grams(text, longest=3):
    b = bytes(x if x >= 0x80 or 0x61 <= x <= 0x7A else 0x20 for x in (" " + text.lower() + " ").encode())
    return [{b[i : i + n] for i in range(len(b) - n + 1)} for n in range(1, longest + 1)]


def test_ridge_on_explicit_nystroem_features(monkeypatch):
    """Kernel, landmarks, features and regression written out with sets."""
    from discern.llm import language_id as L

    lands = {"en": "the and of that with", "de": "der und nicht ein ist", "fr": "les des une dans que"}
    rng = np.random.default_rng(8)
    rows = [(" ".join(rng.choice(words.split() + ["zoo", "a"], 12)), lang) for _ in range(25) for lang, words in lands.items()]
    texts, langs = [r[0] for r in rows], [r[1] for r in rows]
    monkeypatch.setattr(L, "LANDMARKS", 6)
    monkeypatch.setattr(L, "CELLS", 500)  # many blocks
    model = L.fit(texts, langs)
    names = sorted(lands)
    label = np.array([names.index(x) for x in langs])
    order = np.random.default_rng(3).permutation(len(texts))
    marks = np.concatenate([order[label[order] == k][:6] for k in range(3)])
    seen = [set().union(*(plain_grams(texts[i])[n] for i in marks)) for n in range(3)]

    def kernel(x, y):
        a, b = plain_grams(x), plain_grams(y)
        both = sum(L.WEIGHTS[n + 1] * len(a[n] & b[n] & seen[n]) for n in range(3))
        own = [sum(L.WEIGHTS[n + 1] * len(g[n]) for n in range(3)) for g in (a, b)]
        return both / np.sqrt(own[0] * own[1])

    among = np.array([[kernel(texts[i], texts[j]) for j in marks] for i in marks])
    values, vectors = np.linalg.eigh(among)
    whiten = vectors[:, values > 1e-8 * values.max()] / np.sqrt(values[values > 1e-8 * values.max()])

    def features(some):
        return np.hstack([np.array([[kernel(t, texts[j]) for j in marks] for t in some]) @ whiten, np.ones((len(some), 1))])

    x = features(texts)
    share = 1.0 / np.bincount(label)[label] / 3
    target = (label[:, None] == np.arange(3)).astype(float)
    solved = np.linalg.solve((x * share[:, None]).T @ x + L.RIDGE * np.eye(x.shape[1]), (x * share[:, None]).T @ target)
    unseen = ["the und les zoo", "der der", "que the of a", "q", "zoo"]
    got = L.Presence(model["vocabulary"]).product(unseen, model["weights"]) + model["offset"]
    assert np.allclose(got, features(unseen) @ solved, atol=1e-8)


def test_long_texts_are_cut_without_losing_grams(monkeypatch):
    from discern.llm import language_id as L

    text = prose(3, 400)
    whole = [g.tolist() for g in L.grams(text)]
    monkeypatch.setattr(L, "STRETCH", 97)
    assert [g.tolist() for g in L.grams(text)] == whole
    assert [{int.from_bytes(g) for g in p} for p in plain_grams(text)] == [set(w) for w in whole]


def test_memory_of_training_is_bounded():
    """Ten languages, 2000 texts of 2 KB: the peak of what numpy holds stays far below a worker's share."""
    import tracemalloc

    from discern.llm import language_id as L

    rng = np.random.default_rng(1)
    words = ["".join(map(chr, rng.integers(97, 123, 6))) for _ in range(3000)]
    texts = [" ".join(rng.choice(words[k % 10 * 300 : k % 10 * 300 + 300], 300)) for k in range(2000)]
    tracemalloc.start()
    L.fit(texts, [f"l{k % 10}" for k in range(2000)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20


def test_the_sample_is_exact(spark):
    from discern.llm.sampling import balanced_sample

    rows = [(7, "hot", "en")] * 5000 + [(k, f"t{k}", "en") for k in range(100, 300)] + [(7, f"other {k}", "en") for k in range(30)] + [(1, "x", "de")] * 9
    rows += [(2, "nothing", None)]
    table = spark.createDataFrame(rows, "id long, text string, label string")
    got = balanced_sample(table, 50, 1000).collect()
    count = {k: [r for r in got if r.label == k] for k in ("en", "de", None)}
    assert (len(count["en"]), len(count["de"]), len(count[None])) == (50, 1, 0) and len({(r.id, r.text) for r in got}) == 51
    assert sorted(map(str, got)) == sorted(map(str, balanced_sample(table.repartition(6), 50, 1000).collect()))
    many = spark.createDataFrame([(k, f"t{k}", f"l{k % 40}") for k in range(400)], "id long, text string, label string")
    few = balanced_sample(many, 5, 60).collect()
    assert len(few) == 60 and {sum(r.label == f"l{k}" for r in few) for k in range(40)} == {1, 2}


def plain_forward(model, text):
    """The network by loops over chunks, places and filters."""
    from discern.llm import quality as Q

    count = 1 + max(0, -(-(len(text) - Q.CHUNK) // Q.HOP))
    hidden = np.zeros((count, Q.FILTERS))
    for c in range(count):
        own = text[c * Q.HOP : c * Q.HOP + Q.CHUNK].ljust(Q.CHUNK, b"\0")
        best = np.full(Q.FILTERS, -np.inf)
        for at in range(0, Q.CHUNK - Q.WIDTH + 1, Q.STRIDE):
            seen = model["embed"][list(own[at : at + Q.WIDTH])].astype(float).ravel()
            best = np.maximum(best, seen @ model["filter"].astype(float))
        hidden[c] = np.maximum(best + model["bias"], 0)
    both = np.concatenate([hidden.mean(axis=0), hidden.max(axis=0)])
    return 1 / (1 + np.exp(-(both @ model["out"].astype(float) + float(model["out_bias"][0]))))


def test_network_is_a_plain_convolution():
    from discern.llm import quality as Q

    texts = [prose(1, 40).encode(), b"", prose(2, 900).encode(), b"x" * 1025, bytes(range(256)) * 3]
    model = Q.fit(texts, np.array([1, 0, 1, 0, 0]))
    got = Q.score(model, texts)
    assert np.allclose(got, [plain_forward(model, t) for t in texts], atol=1e-4)


def test_conflicting_labels_are_not_learned(spark):
    from discern.llm.quality import rate_quality

    good, bad = prose(4, 60), "!!! $$$ ### " * 20
    docs = spark.createDataFrame([(k, (good if k % 2 else bad) + f" {k}") for k in range(60)], "doc_id long, text string")
    marks = [(k, k % 2) for k in range(60)]
    clean = rate_quality(docs, spark.createDataFrame(marks, "doc_id long, quality int"), F.lit(False))
    # both labels on ten ids, in any order of the rows, count like no label
    mixed = marks + [(k, 1 - k % 2) for k in range(10)]
    answers = []
    for rows in (mixed, mixed[::-1], [m for m in marks if m[0] >= 10]):
        table = spark.createDataFrame(rows, "doc_id long, quality int").repartition(3)
        answers.append(sorted((r.doc_id, r.score) for r in rate_quality(docs.repartition(4), table, F.lit(False)).collect()))
    assert np.allclose(answers[0], answers[1]) and np.allclose(answers[0], answers[2]) and clean.count() == 60


def test_a_sample_by_marks_shuffles_no_text(spark):
    """Labels of another table draw the rows that a join before the draw gives, and no text is shuffled to them."""
    from discern.llm.sampling import balanced_sample

    rows = spark.createDataFrame([(i % 40, f"text {i % 60}") for i in range(200)] + [(None, "x"), (5, None)], "id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(31, None)], "id long, label int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        light = balanced_sample(rows, 7, 14, marks=marks)
        plan = light._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(light.collect()) == sorted(balanced_sample(rows.join(marks, "id"), 7, 14).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert len(joins) == 2 and sum("broadcast" in line for line in joins) == 1  # the texts' own join needs no shuffle
