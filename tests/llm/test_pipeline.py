"""The pipeline's stages on a small table with planted cases and awkward rows."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm.test_operators import plain_components, plain_removed, plain_targets

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
LANDS = {
    "en": "the and of that with this from have were which their there would about other could these into after".split(),
    "de": "der die und nicht ein ist auch sich mit dem auf eine wird von haben werden oder nach noch".split(),
}


def sentence(seed, words, land="en"):
    return " ".join(np.random.default_rng(seed).choice(LANDS[land], words)) + f" {seed}"


PASSAGE = "a passage of more than one hundred bytes that several documents of this small collection have taken over word for word"


def planted():
    rows = [(k, sentence(k, 60, "de" if k % 3 == 0 else "en"), "de" if k % 3 == 0 else "en", f"s{k % 3}") for k in range(40)]
    rows += [(100, rows[5][1], "en", "s0"), (101, rows[5][1] + " more", "en", "s1"), (102, sentence(7, 60) + " x y", "en", None)]
    rows += [(110 + k, f"{sentence(200 + k, 40)} {PASSAGE} {sentence(300 + k, 30)}", "en", "s2") for k in range(4)]
    rows += [(120, None, "en", "s1"), (121, "", None, "s1"), (122, "12 34 !!", "en", "s1"), (None, sentence(500, 50), "en", "s1"), (123, sentence(9, 4000), "en", "s2")]
    return [(i, t, x, s, len(t) if t is not None else None) for i, t, x, s in rows]


@pytest.fixture(scope="module")
def stages(spark):
    """The input and the output of each stage."""
    docs, seen = spark.createDataFrame(planted(), COLUMNS), []
    for name, stage in P.STAGES:
        out = stage(spark, docs, "")
        rows = out.collect()
        seen.append((name, docs.collect(), rows, out.columns))
        docs = spark.createDataFrame(rows, out.schema)
    return seen


def test_stages_return_the_columns_of_documents(stages):
    assert [n for n, *_ in stages] == [n for n, _ in P.STAGES] and len(stages) == 5
    for _, before, after, columns in stages[:-1]:
        assert columns == ["doc_id", "text", "lang", "source", "n_chars"] and 0 < len(after)


def test_language_stage_drops_what_has_no_letters(stages):
    _, before, after, _ = stages[0]
    gone = Counter(before) - Counter(after)
    assert {r.doc_id for r in gone} == {120, 121, 122}


def test_near_dedup_keeps_one_of_each_group(stages):
    _, before, after, _ = stages[1]
    found = plain_components([(r.doc_id, r.text) for r in before if r.doc_id is not None], 5, 80)
    assert {r.doc_id for r in after} == {i for i, (_, c) in found.items() if c == i} | {None}


def test_near_dedup_judges_rows_not_ids(spark):
    """A table loaded twice, copies and near copies without ids, one id on two texts."""
    near = sentence(600, 60)
    rows = [(k, sentence(k, 60)) for k in range(4)]
    rows += rows + [(None, rows[1][1]), (None, near), (None, near + " more"), (None, near)]
    rows += [(9, rows[0][1] + " more"), (9, sentence(700, 60)), (10, sentence(701, 60)), (10, sentence(702, 60)), (11, sentence(702, 60).upper())]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], COLUMNS).repartition(3)
    after = Counter((r.doc_id, r.text) for r in P.near_dedup(spark, docs, "").collect())
    left = [x for x in after if x[0] is None]
    assert len(left) == 1 and left[0][1] in (near, near + " more") and set(after.values()) == {1}
    assert set(after) - set(left) == {*rows[:4], (9, sentence(700, 60)), (10, sentence(701, 60)), (10, sentence(702, 60))}


def test_suffix_stage_cuts_repeated_passages(stages):
    _, before, after, _ = stages[2]
    want = plain_removed([(r.doc_id, r.text) for r in before if r.doc_id is not None])
    for r in after:
        if r.doc_id is not None:
            assert r.text == want[r.doc_id].decode() and r.n_chars == len(r.text)
    assert [PASSAGE in r.text for r in sorted((r for r in after if r.doc_id in range(110, 114)), key=lambda r: r.doc_id)] == [True, False, False, False]


def test_mixing_stage_comes_near_its_targets(stages):
    _, before, after, _ = stages[3]
    sizes, taken, times = defaultdict(int), defaultdict(int), Counter(r.doc_id for r in after)
    for r in before:
        sizes[r.source] += len(r.text.split())
    for r in after:
        taken[r.source] += len(r.text.split())
        assert r.text and r.n_chars == len(r.text)
    wanted = plain_targets(sizes)
    assert max(times.values()) <= 2 and all(abs(taken[s] - wanted[s]) <= 3 * 64 for s in sizes)


def test_packing_stage_packs_every_token(stages):
    _, before, after, _ = stages[4]
    bins = defaultdict(list)
    for r in after:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        assert sum(n for _, n in own) <= 1024 and [o for o, _ in sorted(own)] == np.cumsum([0] + [n for _, n in sorted(own)])[:-1].tolist()
    assert Counter(r.doc_id for r in after if r.piece == 0) == Counter(r.doc_id for r in before)


def test_no_documents(spark):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
        docs = spark.createDataFrame([], docs.schema)


def test_run_follows_the_stages(spark, tmp_path):
    spark.createDataFrame(planted(), COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    found = P.run(spark, str(tmp_path))
    assert found.agg(F.sum("length")).first()[0] > 0 and "sequence_id" in found.columns


def test_clashing_columns_and_no_language(spark):
    """Columns named like anything the stages make keep their values; without a language all documents stay."""
    from tests.llm.test_operators import prose

    names = ["score", "lang_pred", "_key", "key", "row", "id", "kept", "removed", "n_bytes", "size", "spans", "taken", "pass", "own", "several", "target"]
    rows = [(k, prose(k, 60) + f" word{k}", ("en", "de")[k % 2], "ab"[k % 2], 1, *[f"{n} {k}" for n in names]) for k in range(24)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame(rows, schema)
    for name, stage in P.STAGES[:-1]:
        got = stage(spark, docs, "")
        assert got.columns == docs.columns, name
        found = got.collect()
        assert found and all(r[n] == f"{n} {r.doc_id}" for r in found for n in names), name
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert P.language_id(spark, none, "").count() == 24


def test_language_stage_keeps_clean_documents(spark):
    """Of the labelled documents of good quality with a letter none is lost."""
    directory = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{directory}/documents.parquet")
    good = docs.join(spark.read.parquet(f"{directory}/labels.parquet").where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    stays = P.language_id(spark, docs, directory).select("doc_id")
    assert good.where(F.regexp_like("text", F.lit("[A-Za-z]"))).join(stays, "doc_id", "left_anti").count() == 0


def test_near_dedup_groups_no_texts(spark, monkeypatch):
    """What is grouped and sorted by class are marks of rows; a text is stored once."""
    seen, keep = {}, P.stored.keep

    def watch(self, df, name):
        if self.operator == "near-dedup":
            seen[name] = df.schema.simpleString()
        return keep(self, df, name)

    monkeypatch.setattr(P.stored, "keep", watch)
    rows = [(k, sentence(k % 3, 30), "en", "s", 1) for k in range(6)] + [(7, " \t\n", "en", "s", 3), (None, None, "en", "s", 0)]
    after = P.near_dedup(spark, spark.createDataFrame(rows, COLUMNS), "").collect()
    assert sorted(str(r.doc_id) for r in after) == ["0", "1", "2", "7", "None"]
    assert [name for name, schema in seen.items() if "text" in schema] == ["rows"] and seen["rows"].count("text:") == 1
