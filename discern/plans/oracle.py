"""The same questions as in ``catalog`` in SQL, over the same tables.

Model queries are answered from the definition of the data: where the features fix
the row's class up to noise that they cannot see, a fitted model has to predict the
majority class, and the counts follow.
"""

from __future__ import annotations

from itertools import product

from discern.functions.text import LETTERS
from discern.operators.importance import PERMUTE_SEED
from discern.operators.split import (
    FOLD_SEED,
    SAMPLE_SEED,
    SPARSE_SPLIT_SEED,
    SPLIT_SEED,
    poisson_cuts,
)
from discern.operators.tuning import DEFAULT_FOLDS, REFERENCE_FOLDS, REFERENCE_GRIDS
from discern.plans.inputs import HALVING_SEED, LINE_ID

ORACLE: dict[str, str] = {}

LINE_KEY = f"concat_ws('-', {', '.join(LINE_ID)})"


def md5_of(key: str, seed: int) -> str:
    return f"md5('{seed}:' || {key})"


def hash32(key: str, seed: int) -> str:
    return f"('0x' || substr({md5_of(key, seed)}, 1, 8))::bigint"


# Where the parts of a split end, as 32-bit hashes.
CUT_60, CUT_80 = round(0.6 * 2**32), round(0.8 * 2**32)
DOC_TEST = f"({hash32('doc_id::varchar', SPLIT_SEED)} >= {CUT_80})"
PAGE_TEST = f"({hash32('page_id::varchar', SPARSE_SPLIT_SEED)} >= {CUT_80})"
LINE_TEST = f"({hash32(LINE_KEY, SPLIT_SEED)} >= {CUT_80})"

# Line items with the quantity classes and their noisy labels.
LINES = f"""
lines AS (
  SELECT *, CASE WHEN l_linenumber = 7 THEN (clean + 1) % 4 ELSE clean END AS label,
         CASE WHEN l_linenumber = 7 THEN 1 - clean_big ELSE clean_big END AS big
  FROM (SELECT {', '.join(LINE_ID)}, l_quantity, l_extendedprice, l_discount, l_tax,
               l_quantity::int AS quantity, (l_quantity::int - 1) // 13 AS clean,
               (l_quantity > 25)::int AS clean_big,
               {LINE_TEST} AS is_test, {hash32(LINE_KEY, FOLD_SEED)} % 3 AS fold
        FROM lineitem))"""

EMBEDDING_CELLS = """
cells AS (
  SELECT vec_id, label, i, embedding[i + 1]::double AS x,
         (vec_id % 7 = 0 AND i BETWEEN 10 AND 14) AS missing
  FROM embeddings, (SELECT unnest(range(0, (SELECT max(len(embedding)) FROM embeddings)))::int AS i))"""

RULE_DOCUMENTS = """
b AS (SELECT doc_id, toxic::double AS label, (n_chars % 2)::double AS prediction, n_chars % 101 / 100.0 AS score
      FROM documents JOIN labels USING (doc_id))"""

RULE_LINES = """
b AS (SELECT (l_quantity::int % 4)::double AS label, (l_linenumber % 4)::double AS prediction FROM lineitem)"""


def class_totals(source: str, keys: str = "") -> str:
    """CTE ``k``: rows, predictions and hits per class of ``source(label, prediction)``."""
    key = f"{keys}, " if keys else ""
    return f"""
k AS (
  SELECT {key}c, sum(a)::double AS a, sum(p)::double AS p, sum(h)::double AS h FROM (
    SELECT {key}label AS c, 1 AS a, 0 AS p, (label = prediction)::int AS h FROM {source}
    UNION ALL SELECT {key}prediction, 0, 1, 0 FROM {source}) GROUP BY {key}c)"""


WEIGHTED_F1 = "sum(a * coalesce(2 * h / nullif(a + p, 0), 0)) / sum(a)"
BALANCED = "avg(h / nullif(a, 0))"


def rounds(select: str, *columns: str, digits: int = 6) -> str:
    replaced = ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)
    return f"SELECT * REPLACE ({replaced}) FROM ({select})"


# --- sources, sinks, cleaning -------------------------------------------------

_CSV_TOTALS = """
SELECT '_c' || i AS column_name, {n} AS n_present, round({total}, 6) AS total FROM cells GROUP BY i
UNION ALL
SELECT '_c' || (SELECT max(len(embedding)) FROM embeddings), count(label), sum(label)::double FROM embeddings"""

ORACLE["csv_roundtrip_clean"] = f"WITH {EMBEDDING_CELLS} " + _CSV_TOTALS.format(
    n="count(*)", total="sum(CASE WHEN missing THEN 0 ELSE x END)"
)
ORACLE["csv_missing_as_null"] = f"WITH {EMBEDDING_CELLS} " + _CSV_TOTALS.format(
    n="count(CASE WHEN NOT missing THEN 1 END)", total="sum(CASE WHEN NOT missing THEN x END)"
)
ORACLE["csv_drop_and_assemble"] = f"""WITH {EMBEDDING_CELLS}
SELECT label, count(DISTINCT vec_id) AS n, count(DISTINCT i)::int AS width, round(sum(x), 6) AS total
FROM cells WHERE i NOT BETWEEN 10 AND 14 GROUP BY label"""

_LETTER_COUNTS = ", ".join(
    f"length(text) - length(replace(replace(text, '{x}', ''), '{x.upper()}', '')) AS n_{x}" for x in LETTERS
)
_LETTERS = f"letters AS (SELECT doc_id, lang, {DOC_TEST} AS is_test, {_LETTER_COUNTS} FROM documents)"
_LETTER_LIST = "[" + ", ".join(f"n_{x}" for x in LETTERS) + "]"
_LETTER_NAMES = "[" + ", ".join(f"'n_{x}'" for x in LETTERS) + "]"
_LETTER_ROWS = f"""
letter_rows AS (
  SELECT doc_id, lang, is_test, unnest({_LETTER_NAMES}) AS term, unnest({_LETTER_LIST})::double AS n FROM letters)"""

ORACLE["libsvm_roundtrip_stats"] = f"""WITH {_LETTERS}, {_LETTER_ROWS}
SELECT (lang = 'en')::double AS label, count(DISTINCT doc_id) AS n,
       sum((n > 0)::int)::double AS nnz, sum(n)::double AS total
FROM letter_rows GROUP BY 1"""

ORACLE["split_handoff_counts"] = f"""
SELECT CASE WHEN {hash32('vec_id::varchar', SPLIT_SEED)} < {CUT_80} THEN 0 ELSE 1 END AS split,
       label::double AS label, count(*) AS n, round(sum(list_sum(embedding::double[])), 6) AS total
FROM embeddings GROUP BY 1, 2"""


def _profile(table: str, columns: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{t}' AS data_type, count(*) AS n_rows, "
        f"count(*) - count({c}) AS n_missing, count(DISTINCT {c}) AS n_distinct FROM {table}"
        for c, t in columns.items()
    )


ORACLE["table_profile"] = _profile(
    "lineitem",
    {
        "l_orderkey": "bigint",
        "l_partkey": "bigint",
        "l_suppkey": "bigint",
        "l_linenumber": "int",
        "l_quantity": "double",
        "l_extendedprice": "double",
        "l_discount": "double",
        "l_tax": "double",
        "l_returnflag": "string",
        "l_linestatus": "string",
        "l_shipdate": "timestamp_ntz",
    },
)
ORACLE["document_profile"] = _profile(
    "documents", {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}
)
ORACLE["reversed_columns"] = """
SELECT position, value, count(*) AS n FROM (
  SELECT 0 AS position, toxic::bigint AS value FROM labels
  UNION ALL SELECT 1, quality::bigint FROM labels
  UNION ALL SELECT 2, doc_id::bigint FROM labels) GROUP BY 1, 2"""
ORACLE["label_distinct"] = "SELECT DISTINCT label FROM embeddings"
ORACLE["label_count_distinct"] = "SELECT count(DISTINCT label) AS n_distinct FROM embeddings"
ORACLE["scored_result"] = f"""WITH {RULE_DOCUMENTS}
SELECT doc_id, score, label, prediction AS "Predicted_label" FROM b"""
ORACLE["first_scores"] = f"""WITH {RULE_DOCUMENTS}
SELECT doc_id, coalesce(prediction::varchar, 'NaN') AS prediction
FROM documents LEFT JOIN b USING (doc_id) ORDER BY doc_id LIMIT 10"""

# --- splits and samples -------------------------------------------------------

ORACLE["hash_split_2way"] = f"SELECT doc_id, {DOC_TEST}::int AS split FROM documents"
ORACLE["hash_split_3way"] = f"""
SELECT CASE WHEN h < {CUT_60} THEN 0 WHEN h < {CUT_80} THEN 1 ELSE 2 END AS split, count(*) AS n, sum(l_quantity) AS quantity
FROM (SELECT l_quantity, {hash32(LINE_KEY, SPLIT_SEED)} AS h FROM lineitem) GROUP BY 1"""
ORACLE["hash_folds"] = f"""
SELECT ({hash32(LINE_KEY, FOLD_SEED)} % 10)::int AS fold, count(*) AS n, sum(l_quantity) AS quantity
FROM lineitem GROUP BY 1"""
ORACLE["shuffle_tenth"] = f"""
SELECT {', '.join(LINE_ID)} FROM lineitem
QUALIFY row_number() OVER (ORDER BY {md5_of(LINE_KEY, SAMPLE_SEED)}, {', '.join(LINE_ID)}) <= (SELECT count(*) // 10 FROM lineitem)"""
ORACLE["shuffle_top_n"] = f"""
SELECT {', '.join(LINE_ID)} FROM lineitem ORDER BY {md5_of(LINE_KEY, SAMPLE_SEED)}, {', '.join(LINE_ID)} LIMIT 1000"""
_COPIES = " + ".join(f"(u >= '{cut!r}'::double)::int" for cut in poisson_cuts(0.1))
ORACLE["sample_copies"] = f"""
SELECT {', '.join(LINE_ID)}, unnest(range(1, n + 1))::int AS copy FROM (
  SELECT {', '.join(LINE_ID)}, {_COPIES} AS n FROM (
    SELECT {', '.join(LINE_ID)}, {hash32(LINE_KEY, SAMPLE_SEED)} / 4294967296.0::double AS u FROM lineitem))
WHERE n > 0"""

# --- features -----------------------------------------------------------------


def _index(table: str, column: str) -> str:
    return f"""SELECT {column}::varchar AS value, count(*) AS n,
       row_number() OVER (ORDER BY count(*) DESC, {column}::varchar) - 1 AS idx FROM {table} GROUP BY {column}"""


ORACLE["label_index"] = " UNION ALL ".join(
    f"SELECT value, n, idx AS label_index, '{c}' AS column_name FROM ({_index('documents', c)})"
    for c in ("lang", "source")
)
ORACLE["category_index"] = f"""
WITH a AS ({_index('lineitem', 'l_returnflag')}), b AS ({_index('lineitem', 'l_linestatus')}),
     c AS ({_index('lineitem', 'l_linenumber')})
SELECT l_returnflag, l_linestatus, l_linenumber, a.idx::double AS l_returnflag_index,
       b.idx::double AS l_linestatus_index, c.idx::double AS l_linenumber_index, count(*) AS n
FROM lineitem JOIN a ON a.value = l_returnflag JOIN b ON b.value = l_linestatus
     JOIN c ON c.value = l_linenumber::varchar GROUP BY ALL"""
# The label column is left out of the vector.
ORACLE["all_categories"] = f"""
WITH a AS ({_index('documents', 'lang')}), b AS ({_index('documents', 'source')})
SELECT a.idx::double AS lang, b.idx::double AS source, 0.0::double AS label, count(*) AS n
FROM documents d JOIN a ON a.value = d.lang JOIN b ON b.value = d.source GROUP BY 1, 2, 3"""
ORACLE["assembled_feature_sums"] = """
SELECT vec_id, len(embedding)::int AS width, round(list_sum(embedding::double[]), 6) AS total FROM embeddings"""
ORACLE["impute_mean"] = "SELECT vec_id, " + ", ".join(
    f"round(CASE WHEN vec_id % 7 <> 0 THEN embedding[{i + 1}]::double ELSE "
    f"(SELECT avg(embedding[{i + 1}]::double) FROM embeddings WHERE vec_id % 7 <> 0) END, 6) AS f{i}"
    for i in range(10, 15)
) + " FROM embeddings"
ORACLE["hashed_term_counts"] = r"""
SELECT doc_id, len([t for t in string_split_regex(text, '\s+') if t <> ''])::double AS n_terms FROM documents"""
ORACLE["feature_covariance"] = f"""WITH {EMBEDDING_CELLS}
SELECT a.i, b.i AS j, round(covar_samp(a.x, b.x), 8) AS covariance
FROM cells a JOIN cells b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY 1, 2"""
ORACLE["pca_rotation_norms"] = """
SELECT vec_id, round(list_sum([x * x for x in embedding::double[]]), 6) AS squared_length FROM embeddings"""

# --- naive Bayes and trees with a closed form ---------------------------------

_BAYES = f"""{_LETTERS}, {_LETTER_ROWS},
sums AS (SELECT lang, term, sum(n) AS s FROM letter_rows WHERE NOT is_test GROUP BY 1, 2),
docs AS (SELECT lang, count(*) AS n FROM letters WHERE NOT is_test GROUP BY 1),
model AS (
  SELECT lang, 'prior' AS term, ln(n + 1e-4) - ln(sum(n) OVER () + 1e-4 * count(*) OVER ()) AS value FROM docs
  UNION ALL
  SELECT lang, term, ln(s + 1e-4) - ln(sum(s) OVER (PARTITION BY lang) + 1e-4 * count(*) OVER (PARTITION BY lang))
  FROM sums)"""
ORACLE["nb_model"] = f"WITH {_BAYES} SELECT lang, term, round(value, 6) AS value FROM model"
ORACLE["nb_predictions"] = f"""WITH {_BAYES},
scores AS (
  SELECT r.doc_id, r.lang, m.lang AS predicted, sum(r.n * m.value) + any_value(q.value) AS score
  FROM letter_rows r JOIN model m ON m.term = r.term JOIN model q ON q.lang = m.lang AND q.term = 'prior'
  WHERE r.is_test GROUP BY 1, 2, 3)
SELECT doc_id, any_value(lang) AS lang, arg_max(predicted, score) AS predicted FROM scores GROUP BY doc_id"""
ORACLE["stump_gini"] = f"""WITH {LINES},
cuts AS (SELECT DISTINCT quantity AS cut FROM lines WHERE quantity < (SELECT max(quantity) FROM lines)),
qc AS (SELECT quantity, label, count(*) AS n FROM lines GROUP BY 1, 2),
sides AS (SELECT cut, quantity > cut AS side, label, sum(n)::double AS n FROM cuts, qc GROUP BY 1, 2, 3),
impurity AS (SELECT cut, sum(w) AS w FROM (
  SELECT cut, side, sum(n) - sum(n * n) / sum(n) AS w FROM sides GROUP BY 1, 2) GROUP BY 1),
best AS (SELECT arg_min(cut, w) AS cut FROM impurity)
SELECT (quantity > cut)::double AS leaf, min(quantity) AS low, max(quantity) AS high, count(*) AS n,
       {', '.join(f"round(avg((label = {i})::int), 6) AS share_{i}" for i in range(4))}
FROM lines, best GROUP BY 1"""

# --- classifiers --------------------------------------------------------------

# Murmur3 (32 bits, seed 42) of each distinct word, the hash behind the term positions:
# four bytes at a time, low byte first, then the bytes left over.
_M32 = "4294967295::ubigint"


def _rotl(x: str, r: int) -> str:
    return f"((({x}) << {r}) & {_M32} | (({x}) >> {32 - r}))"


def _mul(x: str, c: int) -> str:
    return f"((({x}) * {c}::ubigint) & {_M32})"


def _byte(i: str) -> str:
    return f"coalesce(('0x' || nullif(substr(hx, 2 * ({i}) + 1, 2), ''))::ubigint, 0::ubigint)"


def _mixed(k: str) -> str:
    return _mul(_rotl(_mul(k, 0xCC9E2D51), 15), 0x1B873593)


_WORD = f"({_byte('4 * i')} | ({_byte('4 * i + 1')} << 8) | ({_byte('4 * i + 2')} << 16) | ({_byte('4 * i + 3')} << 24))"
_STEP = f"((({_mul(_rotl('xor(h, w.ks[i + 1])', 13), 5)}) + 3864292196::ubigint) & {_M32})"
_TAIL = f"CASE WHEN nb % 4 > 0 THEN xor(h, w.ks[nb // 4 + 1]) ELSE h END"


def _xor_shift(x: str, r: int) -> str:
    return f"xor({x}, ({x}) >> {r})"


MURMUR = f"""
hexed AS (SELECT token, hex(encode(token)) AS hx FROM (SELECT DISTINCT token FROM tokens)),
w AS (SELECT token, len(hx) // 2 AS nb, [{_mixed('k')} for k in [{_WORD} for i in range(0, len(hx) // 8 + 1)]] AS ks FROM hexed),
rounds AS (
  SELECT token, nb, 0 AS i, 42::ubigint AS h FROM w
  UNION ALL
  SELECT r.token, r.nb, r.i + 1, {_STEP} FROM rounds r JOIN w USING (token) WHERE r.i < r.nb // 4),
tails AS (SELECT token, xor({_TAIL}, nb::ubigint) AS h FROM rounds JOIN w USING (token, nb) WHERE i = nb // 4),
final1 AS (SELECT token, {_mul(_xor_shift('h', 16), 0x85EBCA6B)} AS h FROM tails),
final2 AS (SELECT token, {_mul(_xor_shift('h', 13), 0xC2B2AE35)} AS h FROM final1),
places AS (SELECT token, {_xor_shift('h', 16)} AS h FROM final2)"""

ORACLE["nb_sparse"] = rf"""WITH RECURSIVE
tokens AS (
  SELECT doc_id, toxic AS label, {DOC_TEST} AS is_test, unnest([t for t in string_split_regex(text, '\s+') if t <> '']) AS token
  FROM documents JOIN labels USING (doc_id)),
{MURMUR},
terms AS (SELECT doc_id, label, is_test, h % 262144 AS place, count(*)::double AS tf
          FROM tokens JOIN places USING (token) GROUP BY 1, 2, 3, 4),
docs AS (SELECT doc_id, toxic AS label, {DOC_TEST} AS is_test FROM documents JOIN labels USING (doc_id)),
prior AS (SELECT c, ln(n + 1e-4) - ln(total + 2e-4) AS value FROM (
  SELECT label AS c, count(*) AS n, sum(count(*)) OVER () AS total FROM docs WHERE NOT is_test GROUP BY label)),
mass AS (SELECT label AS c, ln(sum(tf) + 1e-4 * 262144) AS value FROM terms WHERE NOT is_test GROUP BY label),
theta AS (SELECT label AS c, place, ln(sum(tf) + 1e-4) AS value FROM terms WHERE NOT is_test GROUP BY label, place),
scores AS (
  SELECT d.doc_id, d.label, p.c, any_value(p.value) + coalesce(sum(t.tf * (coalesce(h.value, ln(1e-4)) - m.value)), 0) AS score
  FROM docs d CROSS JOIN prior p JOIN mass m ON m.c = p.c
       LEFT JOIN terms t ON t.doc_id = d.doc_id LEFT JOIN theta h ON h.c = p.c AND h.place = t.place
  WHERE d.is_test GROUP BY 1, 2, 3),
b AS (SELECT doc_id, any_value(label) AS label, arg_max(c, score) AS prediction FROM scores GROUP BY doc_id),
{{counts}}
SELECT *, {{ratios}}, round(correct / nullif(total, 0)::double, 6) AS accuracy,
  round((tp / nullif(tp + fn, 0)::double + tn / nullif(tn + fp, 0)::double) / 2, 6) AS auc_roc_hard,
  round({{mcc}}, 6) AS mcc FROM counts"""


ORACLE["best_words"] = rf"""WITH RECURSIVE
docs AS (SELECT doc_id, toxic AS label, text FROM documents JOIN labels USING (doc_id) WHERE NOT {DOC_TEST}),
tokens AS (SELECT doc_id, label, unnest([t for t in string_split_regex(text, '\s+') if t <> '']) AS token FROM docs),
{MURMUR},
sizes AS (SELECT count(*)::double AS n, count(*) FILTER (label = 0)::double AS n0, count(*) FILTER (label = 1)::double AS n1 FROM docs WHERE text IS NOT NULL),
present AS (SELECT (h % 262144)::int AS place, count(DISTINCT doc_id) AS n_rows, count(DISTINCT doc_id) FILTER (label = 0) AS o0,
                   count(DISTINCT doc_id) FILTER (label = 1) AS o1 FROM tokens JOIN places USING (token) GROUP BY 1),
scored AS (SELECT place, n_rows, CASE WHEN n_rows < n THEN
  (n * o0 - n_rows * n0) * (n * o0 - n_rows * n0) / (n0 * n_rows * (n - n_rows)) + (n * o1 - n_rows * n1) * (n * o1 - n_rows * n1) / (n1 * n_rows * (n - n_rows))
  ELSE 0 END AS statistic FROM present, sizes)
SELECT row_number() OVER (ORDER BY round(statistic, 9) DESC, place)::int AS rank, place, n_rows, round(statistic, 4) AS statistic
FROM scored ORDER BY rank LIMIT 200"""
for _name in ("dt_selected", "mlp_selected"):
    ORACLE[_name] = f"""
SELECT CASE WHEN page_id % 7 = 0 THEN 1 - clean ELSE clean END AS actual, clean AS predicted, count(*) AS n
FROM (SELECT page_id, contains(url, '?')::int::double AS clean FROM pages WHERE {PAGE_TEST}) GROUP BY 1, 2"""


def _majority(actual: str, predicted: str) -> str:
    return f"""WITH {LINES}
SELECT {actual}::double AS actual, {predicted}::double AS predicted, count(*) AS n FROM lines WHERE is_test GROUP BY 1, 2"""


for _name in ("lr_multinomial", "mlp_multiclass", "deep_mlp", "dt_multiclass", "rf_multiclass", "tuned_refit"):
    ORACLE[_name] = _majority("label", "clean")
ORACLE["svm_quantity"] = _majority("big", "clean_big")
# The query string of a URL is one of its tokens, so the label can be read off the features.
for _name in ("lr_binary_sparse", "svm_linear", "dt_sparse"):
    ORACLE[_name] = f"""
SELECT contains(url, '?')::double AS actual, contains(url, '?')::double AS predicted, count(*) AS n
FROM pages WHERE {PAGE_TEST} GROUP BY 1, 2"""


ORACLE["mlp_folded"] = f"""
SELECT (CASE WHEN l_linenumber = 7 THEN 1 - upper ELSE upper END)::double AS actual, upper::double AS predicted,
       count(*) AS n
FROM (SELECT l_linenumber, (l_quantity::int % 26 >= 13)::int AS upper, {LINE_TEST} AS is_test FROM lineitem)
WHERE is_test GROUP BY 1, 2"""
ORACLE["dense_job_lines"] = f"""WITH {LINES},
i AS ({_index('lines', 'label')}),
pairs AS (SELECT a.idx AS actual, p.idx AS predicted FROM lines l JOIN i a ON a.value = l.label::varchar
          JOIN i p ON p.value = l.clean::varchar WHERE is_test)
SELECT x.idx::double AS actual, y.idx::double AS predicted, count(pairs.actual) AS n
FROM i x CROSS JOIN i y LEFT JOIN pairs ON pairs.actual = x.idx AND pairs.predicted = y.idx GROUP BY 1, 2"""
# URLs with a query string are the rarer kind, so they are class 1.
ORACLE["sparse_job_urls"] = f"""
SELECT count(*) AS total, count(*) AS correct, 0::bigint AS wrong, count(*) FILTER (contains(url, '?')) AS tp,
       0::bigint AS fp, count(*) FILTER (NOT contains(url, '?')) AS tn, 0::bigint AS fn, 1.0::double AS accuracy,
       1.0::double AS mcc, 1.0::double AS auc_roc FROM pages WHERE {PAGE_TEST}"""

STEPS = f"""
steps AS (
  SELECT CASE WHEN l_quantity = 50 THEN (clean + 1) % 4 ELSE clean END::double AS label, clean::double AS prediction, h
  FROM (SELECT l_quantity, l_linenumber // 2 AS clean, {hash32(LINE_KEY, SPLIT_SEED)} AS h FROM lineitem))"""
ORACLE["second_stage_lines"] = f"""WITH {STEPS}
SELECT label AS actual, prediction AS predicted, count(*) AS n FROM steps WHERE h >= {CUT_80} GROUP BY 1, 2"""


ORACLE["deep_rounds"] = f"""WITH {LINES}
SELECT CASE WHEN h < {CUT_80} THEN 'validation' ELSE 'test' END AS part, label::double AS actual, clean::double AS predicted, count(*) AS n
FROM (SELECT *, {hash32(LINE_KEY, SPLIT_SEED)} AS h FROM lines) WHERE h >= {CUT_60} GROUP BY ALL"""


def _layers(hidden: tuple[int, ...], net: str) -> str:
    sizes = ["width", *[str(h) for h in hidden], "classes"]
    terms = [f"({a} + 1) * {b}" for a, b in zip(sizes, sizes[1:])]
    rows = [f"SELECT {i} AS layer, ({t})::bigint AS n_params, '{net}' AS net FROM shape" for i, t in enumerate(terms)]
    rows.append(f"SELECT -1, ({' + '.join(terms)})::bigint, '{net}' FROM shape")
    return " UNION ALL ".join(rows)


ORACLE["layer_param_counts"] = """
WITH shape AS (SELECT max(len(embedding)) AS width, count(DISTINCT label) AS classes FROM embeddings)
""" + " UNION ALL ".join(
    [_layers((16, 32), "multilayer_perceptron"), _layers((32, 64, 128), "deep"), _layers((256, 256, 256), "second_stage")]
)

_LETTERS = f"""
letters AS (SELECT doc_id, c, length(regexp_replace(coalesce(text, ''), '[^' || c || upper(c) || ']', '', 'g'))::double AS n
  FROM documents, (SELECT unnest([{', '.join(f"'{c}'" for c in LETTERS)}]) AS c))"""
ORACLE["wide_pca_lengths"] = f"""WITH {_LETTERS},
means AS (SELECT c, avg(n) AS mean FROM letters GROUP BY c)
SELECT doc_id, round(sqrt(sum((n - mean) * (n - mean))), 4) AS length FROM letters JOIN means USING (c) GROUP BY doc_id"""
ORACLE["wide_pca_spectrum"] = f"""WITH {_LETTERS},
cells AS (SELECT a.c AS a, b.c AS b, covar_samp(a.n, b.n) AS v, avg(a.n) AS mean FROM letters a JOIN letters b USING (doc_id) GROUP BY ALL)
SELECT count(*) FILTER (a = b AND mean > 0) AS n_features, round(sum(mean) FILTER (a = b), 4) AS mean_letters,
  round(sum(v) FILTER (a = b), 3) AS variance, round(sqrt(sum(v * v)), 3) AS norm FROM cells"""

# --- tuning -------------------------------------------------------------------


def _tuning(points: list[str], source: str, figure: str, metric: str, folds: str = "3") -> str:
    values = ", ".join(f"({i}, '{p}', {'true' if i == 0 else 'false'})" for i, p in enumerate(points))
    return f"""WITH {source}, {class_totals('b', 'fold')},
per_fold AS (SELECT fold, {figure} AS v FROM k GROUP BY fold)
SELECT point, params, '{metric}' AS metric, round(avg(v), 6) AS avg_metric, count(*)::int AS folds, best
FROM per_fold, (VALUES {values}) AS p(point, params, best) GROUP BY point, params, best"""


_QUANTITY_FOLDS = f"{LINES}, b AS (SELECT fold, label, clean AS prediction FROM lines)"
ORACLE["cv_grid_lr"] = _tuning(
    ["maxIter=20, regParam=0.1", "maxIter=20, regParam=0.01"], _QUANTITY_FOLDS, WEIGHTED_F1, "f1"
)
# A tree that may not split predicts the most frequent label of its training rows.
ORACLE["cv_grid_dt"] = f"""WITH {LINES},
majority AS (SELECT f.fold, l.label, count(*) AS n FROM (SELECT DISTINCT fold FROM lines) f JOIN lines l ON l.fold <> f.fold GROUP BY 1, 2),
flat AS (SELECT fold, arg_max(label, n) AS prediction FROM majority GROUP BY fold),
b AS (SELECT fold, label, clean AS prediction FROM lines
      UNION ALL SELECT 100 + fold, label, flat.prediction FROM lines JOIN flat USING (fold)),
{class_totals('b', 'fold')},
per_fold AS (SELECT fold >= 100 AS flat, {WEIGHTED_F1} AS v FROM k GROUP BY fold)
SELECT point, params, 'f1' AS metric, round(avg(v), 6) AS avg_metric, count(*)::int AS folds, point = 1 AS best
FROM per_fold JOIN (VALUES (0, 'maxDepth=3, minInfoGain=10.0', true), (1, 'maxDepth=3, minInfoGain=0.0', false),
  (2, 'maxDepth=4, minInfoGain=10.0', true), (3, 'maxDepth=4, minInfoGain=0.0', false)) AS p(point, params, flat) USING (flat)
GROUP BY point, params"""
ORACLE["cv_grid_rf"] = _tuning(
    ["maxDepth=3, numTrees=3", "maxDepth=3, numTrees=5"], _QUANTITY_FOLDS, WEIGHTED_F1, "f1"
)
ORACLE["cv_deep_mlp"] = _tuning(["defaults"], _QUANTITY_FOLDS, WEIGHTED_F1, "f1")
ORACLE["cv_grid_svm"] = _tuning(
    ["regParam=0.01", "regParam=0.001"],
    f"{LINES}, b AS (SELECT fold, big AS label, clean_big AS prediction FROM lines)",
    BALANCED,
    "balancedAccuracy",
)
ORACLE["cv_grid_lr_sparse"] = _tuning(
    ["maxIter=100, regParam=0.001", "maxIter=100, regParam=0.0001"],
    f"""b AS (SELECT {hash32('page_id::varchar', FOLD_SEED)} % 3 AS fold, contains(url, '?')::int AS label,
           contains(url, '?')::int AS prediction FROM pages)""",
    BALANCED,
    "balancedAccuracy",
)


def _halving(name: str, folds: int) -> str:
    """A tree of depth d with b bins tells apart the first min(d, b - 1) of the halving classes."""
    grid = REFERENCE_GRIDS[name]
    points = []
    for i, values in enumerate(product(*grid.values())):
        point = dict(zip(grid, values))
        text = ", ".join(f"{k}={v}" for k, v in sorted(point.items()))
        points.append(f"({i}, '{text}', {min(point['maxDepth'], point['maxBins'] - 1, 7)})")
    return f"""WITH p(point, params, apart) AS (VALUES {', '.join(points)}),
r AS (SELECT least(bit_count((h & -h) - 1), 7)::double AS label, fold FROM
  (SELECT {hash32('o_orderkey::varchar', HALVING_SEED)} AS h, {hash32('o_orderkey::varchar', FOLD_SEED)} % {folds} AS fold FROM orders)),
m AS (SELECT DISTINCT apart FROM p),
b AS (SELECT apart * 1000 + fold AS fold, label, least(label, apart)::double AS prediction FROM r CROSS JOIN m),
{class_totals('b', 'fold')},
per_fold AS (SELECT fold // 1000 AS apart, {WEIGHTED_F1} AS v FROM k GROUP BY fold),
means AS (SELECT apart, avg(v) AS v, count(*)::int AS folds FROM per_fold GROUP BY apart)
SELECT point, params, 'f1' AS metric, round(v, 6) AS avg_metric, folds,
  point = first_value(point) OVER (ORDER BY round(v, 12) DESC, point) AS best
FROM p JOIN means USING (apart)"""


ORACLE["cv_reference_dt"] = _halving("decision_tree", DEFAULT_FOLDS)
ORACLE["cv_reference_rf"] = _halving("random_forest", REFERENCE_FOLDS["random_forest"])

# --- evaluation ---------------------------------------------------------------

_WEIGHTED = f"""sum(a)::bigint AS n, sum(h) / sum(a) AS accuracy,
  sum(a * coalesce(h / nullif(p, 0), 0)) / sum(a) AS weighted_precision,
  sum(a * coalesce(h / nullif(a, 0), 0)) / sum(a) AS weighted_recall,
  {WEIGHTED_F1} AS weighted_f1, {BALANCED} AS balanced_accuracy, 1 - sum(h) / sum(a) AS test_error"""
ORACLE["multiclass_report"] = f"WITH {RULE_LINES}, {class_totals('b')} " + rounds(
    f"SELECT {_WEIGHTED} FROM k",
    "accuracy",
    "weighted_precision",
    "weighted_recall",
    "weighted_f1",
    "balanced_accuracy",
    "test_error",
)
ORACLE["deep_lines"] = f"""WITH {STEPS},
b AS (SELECT CASE WHEN h < {CUT_80} THEN 'validation' ELSE 'test' END AS part, label, prediction FROM steps WHERE h >= {CUT_60}),
{class_totals('b', 'part')} """ + rounds(
    f"SELECT part, {_WEIGHTED} FROM k GROUP BY part",
    "accuracy",
    "weighted_precision",
    "weighted_recall",
    "weighted_f1",
    "balanced_accuracy",
    "test_error",
)
ORACLE["test_error"] = f"""WITH {RULE_DOCUMENTS}
SELECT count(*) AS n, round(avg((label <> prediction)::int), 6) AS test_error FROM b"""


def _areas(source: str, score: str, figures: str) -> str:
    return f"""WITH {source},
g AS (SELECT {score} AS s, sum(label) AS tp, count(*) - sum(label) AS fp FROM b GROUP BY 1),
c AS (SELECT s, tp, fp, sum(tp) OVER w AS ctp, sum(fp) OVER w AS cfp, sum(tp) OVER () AS p, sum(fp) OVER () AS n
      FROM g WINDOW w AS (ORDER BY s DESC)),
k AS (SELECT *, ctp / (ctp + cfp) AS prec, lag(ctp / (ctp + cfp)) OVER (ORDER BY s DESC) AS prev FROM c)
SELECT {figures} FROM k"""


_ROC = "round(sum(fp / nullif(n, 0) * (ctp - tp / 2) / nullif(p, 0)), 6) AS auc_roc"
_FIRST = "round(sum(tp / nullif(p, 0) * (prec + coalesce(prev, prec)) / 2), 6) AS auc_pr_first"
_ONE = "round(sum(tp / nullif(p, 0) * (prec + coalesce(prev, 1.0)) / 2), 6) AS auc_pr_one"
ORACLE["auc_roc_hard"] = _areas(RULE_DOCUMENTS, "prediction", _ROC)
ORACLE["auc_roc_score"] = _areas(RULE_DOCUMENTS, "score", _ROC)
ORACLE["auc_pr_first"] = _areas(RULE_DOCUMENTS, "score", _FIRST)
ORACLE["auc_pr_one"] = _areas(RULE_DOCUMENTS, "score", _ONE)
ORACLE["auc_many_scores"] = _areas(
    "b AS (SELECT (l_quantity > 25)::int::double AS label, l_extendedprice + 100 * l_quantity AS score FROM lineitem)",
    "score",
    f"{_ROC}, {_FIRST}, {_ONE}",
)

ORACLE["auc_sketched"] = """WITH
bins AS (SELECT least(floor(greatest(0, least(131072, score)) / 131072.0::double * 2048), 2047) AS bin,
                count(*) FILTER (big)::double AS tp, count(*) FILTER (NOT big)::double AS fp
         FROM (SELECT l_quantity > 25 AS big, (l_extendedprice + 100 * l_quantity)::double AS score FROM lineitem) GROUP BY 1),
curve AS (SELECT tp, fp, coalesce(sum(tp) OVER (ORDER BY bin DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM bins)
SELECT round(sum(fp * (2 * above + tp)) / (2 * sum(tp) * sum(fp)), 9) AS auc_roc, round(sum(fp * tp) / (2 * sum(tp) * sum(fp)), 9) AS error,
       count(*) AS n_bins FROM curve"""
_COUNTS = """counts AS (
  SELECT count(*) AS total, count(*) FILTER (label = prediction) AS correct,
         count(*) FILTER (label <> prediction) AS wrong,
         count(*) FILTER (prediction = {p} AND label = prediction) AS tp,
         count(*) FILTER (prediction = {p} AND label <> prediction) AS fp,
         count(*) FILTER (prediction <> {p} AND label = prediction) AS tn,
         count(*) FILTER (prediction <> {p} AND label <> prediction) AS fn FROM b)"""
_MCC = """(tp::double * tn - fp::double * fn)
  / nullif(sqrt((tp + fp)::double * (tp + fn) * (tn + fp) * (tn + fn)), 0)"""
_RATIOS = ", ".join(f"round({c} / nullif(total, 0)::double, 6) AS {c}_ratio" for c in ("correct", "wrong", "tp", "fp", "tn", "fn"))
ORACLE["binary_report"] = f"""WITH {RULE_DOCUMENTS}, {_COUNTS.format(p="1.0")}
SELECT *, {_RATIOS}, round(correct / nullif(total, 0)::double, 6) AS accuracy,
  round((tp / nullif(tp + fn, 0)::double + tn / nullif(tn + fp, 0)::double) / 2, 6) AS auc_roc_hard,
  round({_MCC}, 6) AS mcc FROM counts"""
ORACLE["nb_sparse"] = (
    ORACLE["nb_sparse"]
    .replace("{counts}", _COUNTS.format(p="1.0"))
    .replace("{ratios}", _RATIOS)
    .replace("{mcc}", _MCC)
)
ORACLE["mcc"] = " UNION ALL ".join(
    f"""(WITH {RULE_DOCUMENTS}, {_COUNTS.format(p=p)}
SELECT {p}::double AS positive, tp, fn, round({_MCC}, 6) AS mcc FROM counts)"""
    for p in ("0.0", "1.0")
)
ORACLE["confusion_long"] = f"""WITH {RULE_LINES}
SELECT label AS actual, prediction AS predicted, count(*) AS n FROM b GROUP BY 1, 2"""
ORACLE["confusion_matrix_full"] = f"""WITH {RULE_LINES}, c AS (SELECT unnest(range(6))::double AS c)
SELECT x.c AS actual, y.c AS predicted, count(b.label) AS n
FROM c x CROSS JOIN c y LEFT JOIN b ON b.label = x.c AND b.prediction = y.c GROUP BY 1, 2"""
ORACLE["confusion_matrix_wide"] = f"""WITH {RULE_LINES}
SELECT label AS actual, {', '.join(f"count(*) FILTER (prediction = {i}) AS p_{i}" for i in range(4))} FROM b GROUP BY 1"""
ORACLE["mean_class_error"] = f"""WITH {RULE_LINES}, {class_totals('b')}
SELECT round(1 - {BALANCED}, 6) AS mean_per_class_error FROM k"""
ORACLE["accuracy_pct"] = f"WITH {RULE_LINES} SELECT round(100 * avg((label = prediction)::int), 6) AS accuracy_pct FROM b"
ORACLE["macro_report"] = f"""WITH {RULE_LINES.replace('b AS', 'raw AS')},
b AS (SELECT label, least(prediction, 2.0) AS prediction FROM raw), {class_totals('b')}
SELECT round(sum(h) / sum(a), 6) AS accuracy, round(avg(h / nullif(p, 0)), 6) AS macro_precision,
       round(avg(h / nullif(a, 0)), 6) AS macro_recall,
       round(avg(CASE WHEN a > 0 AND p > 0 THEN 2 * h / (a + p) END), 6) AS macro_f1,
       6 - count(*) FILTER (p > 0) AS precision_excluded, 6 - count(*) FILTER (a > 0) AS recall_excluded,
       6 - count(*) FILTER (a > 0 AND p > 0) AS f1_excluded FROM k"""
ORACLE["evaluator_params"] = f"""WITH {RULE_DOCUMENTS}
SELECT param, value, count(*) AS n_rows FROM b, (VALUES ('labelCol', 'label'), ('metricName', 'areaUnderROC'),
  ('numBins', '1000'), ('rawPredictionCol', 'prediction')) AS v(param, value) GROUP BY 1, 2"""
# Only the quantity tells the class, and two levels of a tree use nothing else.
ORACLE["feature_importance"] = """
SELECT feature, importance::double AS importance, count(*) AS n_rows FROM lineitem,
  (VALUES ('l_quantity', 1), ('l_extendedprice', 0), ('l_discount', 0), ('l_tax', 0)) AS v(feature, importance)
GROUP BY 1, 2"""


def _donors(source: str, columns: list[str]) -> str:
    order = f"ORDER BY h, {', '.join(LINE_ID)}"
    donor = ", ".join(
        f"coalesce(lag({c}) OVER (PARTITION BY b {order}), last_value({c}) OVER (PARTITION BY b {order} "
        f"ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS donor_{c}"
        for c in columns
    )
    return f"""
picked AS (SELECT *, {md5_of(LINE_KEY, PERMUTE_SEED)} AS h,
  {hash32(LINE_KEY, PERMUTE_SEED)} % 8 AS b FROM {source}),
donors AS (SELECT *, {donor} FROM picked)"""


_RULE = "(({q} > 25) OR ({d} > 0.08))::int"
_A = f"avg(({_RULE.format(q='l_quantity', d='l_discount')} = big)::int)"
ORACLE["rule_permutation_importance"] = f"""WITH {LINES}, {_donors('lines', ['l_quantity', 'l_discount'])},
r AS (SELECT count(*) AS n_rows, {_A} AS base,
  avg(({_RULE.format(q='donor_l_quantity', d='l_discount')} = big)::int) AS q,
  avg(({_RULE.format(q='l_quantity', d='donor_l_discount')} = big)::int) AS d FROM donors)
SELECT feature, round(base, 6) AS accuracy, round(p, 6) AS permuted_accuracy, n_rows, round(base - p, 6) AS importance
FROM (SELECT 'l_quantity' AS feature, base, q AS p, n_rows FROM r
      UNION ALL SELECT 'l_discount', base, d, n_rows FROM r)"""
ORACLE["model_permutation_importance"] = f"""WITH {LINES}, test_lines AS (SELECT * FROM lines WHERE is_test),
{_donors('test_lines', ['l_quantity'])},
r AS (SELECT avg((clean = label)::int) AS base,
  avg(((donor_l_quantity::int - 1) // 13 = label)::int) AS q FROM donors)
SELECT feature, round(base, 6) AS accuracy, round(p, 6) AS permuted_accuracy, round(base - p, 6) AS importance
FROM (SELECT 'l_quantity' AS feature, base, q AS p FROM r UNION ALL SELECT 'l_extendedprice', base, base FROM r
      UNION ALL SELECT 'l_discount', base, base FROM r UNION ALL SELECT 'l_tax', base, base FROM r)"""

# The eigenvalues of a symmetric matrix sum to its trace, their squares to the sum of its squared entries.
ORACLE["pca_spectrum"] = f"""WITH {EMBEDDING_CELLS},
c AS (SELECT a.i AS i, b.i AS j, covar_samp(a.x, b.x) AS v FROM cells a JOIN cells b USING (vec_id) GROUP BY 1, 2)
SELECT (SELECT count(*) FROM embeddings) AS n_rows, (SELECT max(len(embedding)) FROM embeddings)::int AS n_components,
       1.0::double AS share_sum, round(sum(v * v) / pow(sum(v) FILTER (WHERE i = j), 2), 6) AS share_squares FROM c"""
