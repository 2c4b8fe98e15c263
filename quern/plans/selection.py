"""Queries: seats, stratified, balanced and gap-filling selection. Titles are unique first, so each phase is set-based."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import dedup, sampling
from quern.sources.tables import table

TARGET, FLOOR = 300, 12
QUOTAS, MINIMUMS = {"en": 60, "fr": 40, "de": 30}, {"good": 70, "long": 50}
TARGETS = {"en": 100, "fr": 90, "es": 200}


def _pool(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    unique = dedup.keep_first(docs, text.dedup_key(F.col("text")), "doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return unique.select("doc_id", "lang", "source", "n_chars", F.coalesce(F.col("quality") == 1, F.lit(False)).alias("good"), (F.col("n_chars") > 3000).alias("long"), sampling.stratum(F.col("lang"), F.col("source")).alias("stratum"))


_POOL = """u AS (SELECT * FROM documents WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(trim(text, ' ')) ORDER BY doc_id) = 1),
p AS (SELECT doc_id, lang, source, n_chars, coalesce(quality = 1, false) AS good, n_chars > 3000 AS long,
  CASE WHEN lang IS NULL OR lower(lang) IN ('other', 'unknown', '') THEN 'Unknown' ELSE lang END || '::' || coalesce(source, 'unknown') AS stratum FROM u LEFT JOIN labels USING (doc_id))"""
_SEATS = f"""{_POOL},
c AS (SELECT stratum, count(*) AS rows, min(doc_id) AS first_seen FROM p GROUP BY stratum),
m AS (SELECT *, rows > {FLOOR} AS large, {TARGET} - coalesce(sum(rows) FILTER (rows <= {FLOOR}) OVER (), 0) AS rest, sum(rows) FILTER (rows > {FLOOR}) OVER () AS mass FROM c),
r AS (SELECT *, CASE WHEN large AND rest > 0 THEN CAST(rows AS DOUBLE) / mass * rest END AS raw FROM m),
t AS (SELECT *, rest - coalesce(sum(floor(raw)) OVER (), 0) AS spare, row_number() OVER (ORDER BY raw - floor(raw) DESC NULLS LAST, first_seen) AS turn FROM r),
seats AS (SELECT stratum, rows, CAST(CASE WHEN NOT large THEN rows ELSE least(coalesce(floor(raw) + CASE WHEN raw IS NOT NULL AND turn <= spare THEN 1 ELSE 0 END, 0), rows) END AS BIGINT) AS seats FROM t)"""


def seat_allocation(spark, sf_dir):
    strata = _pool(spark, sf_dir).groupBy("stratum").agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("first_seen"))
    return sampling.allocate_seats(strata, TARGET, FLOOR)


def stratified_topn(spark, sf_dir):
    return sampling.stratified(_pool(spark, sf_dir), TARGET, FLOOR, "n_chars", "doc_id").select("doc_id", "stratum", "rank_in_group")


STRATIFIED = f"""WITH {_SEATS} SELECT doc_id, stratum, CAST(n AS INT) AS rank_in_group FROM
(SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY n_chars DESC, doc_id) AS n FROM p JOIN seats USING (stratum)) WHERE n <= seats"""


def balanced_selection(spark, sf_dir):
    order = [F.col("n_chars").desc(), F.col("doc_id")]
    return sampling.balanced(_pool(spark, sf_dir), "lang", QUOTAS, MINIMUMS, 220, "doc_id", order).select("doc_id", "lang")


def _fill(name: str, before: str, flag: str, least: str) -> str:
    return f"""{name} AS (SELECT doc_id FROM {before} UNION ALL SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS n FROM p
  WHERE {flag} AND doc_id NOT IN (SELECT doc_id FROM {before})) WHERE n <= {least})"""


BALANCED = f"""WITH {_POOL},
a AS (SELECT doc_id FROM p WHERE lang IN ({', '.join(f"'{k}'" for k in QUOTAS)}) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) <= CASE lang {' '.join(f"WHEN '{k}' THEN {v}" for k, v in QUOTAS.items())} END),
{_fill('b', 'a', 'good', '70 - (SELECT count(*) FROM p JOIN a USING (doc_id) WHERE good)')},
{_fill('c', 'b', 'long', '50 - (SELECT count(*) FROM p JOIN b USING (doc_id) WHERE long)')},
{_fill('d', 'c', 'true', '220 - (SELECT count(*) FROM c)')}
SELECT doc_id, lang FROM p JOIN d USING (doc_id) ORDER BY n_chars DESC, doc_id LIMIT 220"""


def gap_fill_selection(spark, sf_dir):
    pool = _pool(spark, sf_dir)
    have = pool.where("good")
    return sampling.gap_fill(pool, have, "lang", TARGETS, "doc_id", [F.col("n_chars").desc(), F.col("doc_id")]).select("doc_id", "lang")


GAP_FILL = f"""WITH {_POOL}, g AS (SELECT lang, greatest(0, want - coalesce((SELECT count(*) FROM p WHERE good AND p.lang = t.lang), 0)) AS gap
  FROM (VALUES {', '.join(f"('{k}', {v})" for k, v in TARGETS.items())}) t(lang, want))
SELECT doc_id, lang FROM (SELECT doc_id, lang, gap, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS n FROM p JOIN g USING (lang) WHERE NOT good) WHERE n <= gap"""

SHARES, FEWEST, LEAST = {"en": 0.3, "fr": 0.2, "de": 0.15, "es": 0.1}, 50, {"good": 115, "long": 115}
AMOUNTS = {lang: max(FEWEST, int(TARGET * share)) for lang, share in SHARES.items()}


def _score():
    return [(F.col("n_chars") % 100).desc(), F.col("doc_id")]


def minimums_selection(spark, sf_dir):
    """Shares of languages of at least fifty, minimums of good and long ones, the rest."""
    chosen = sampling.with_minimums(_pool(spark, sf_dir), "lang", AMOUNTS, LEAST, TARGET, "doc_id", _score())
    return chosen.select("doc_id", "lang", "phase", "turn")


def _more(i: int, name: str, label: str, served: str, where: str, need: str, order: str = "n_chars % 100 DESC, doc_id") -> str:
    """The rows of a phase, and those of all phases so far; ``need`` may use the label and the table of those so far."""
    return f"""n{i} AS (SELECT doc_id, {i} AS phase, '{name}' AS name, {served} AS served, row_number() OVER (PARTITION BY {label} ORDER BY {order}) AS n, {need.format(f's{i - 1}')} AS need
  FROM p WHERE ({where}) AND doc_id NOT IN (SELECT doc_id FROM s{i - 1})),
s{i} AS (SELECT * FROM s{i - 1} UNION ALL SELECT doc_id, phase, name, served, n FROM n{i} WHERE n <= need)"""


_NONE = "s0 AS (SELECT doc_id, 0 AS phase, '' AS name, 0 AS served, 0 AS n FROM p WHERE false)"
_CHOSEN = "SELECT doc_id, lang, name AS phase, CAST(row_number() OVER (ORDER BY phase, served, n) AS INT) AS turn FROM p JOIN {} USING (doc_id)"
_CASE = lambda column, values: f"CASE {column} {' '.join(f"WHEN '{k}' THEN {v}" for k, v in values.items())} ELSE 0 END"
_PLACES = _CASE("lang", {lang: i for i, lang in enumerate(AMOUNTS)})
MINIMUMS_SQL = f"""WITH {_POOL}, {_NONE},
{_more(1, "quota", "lang", _PLACES, "true", _CASE("lang", AMOUNTS))},
{", ".join(_more(i, flag, "1", "0", flag, f"{least} - (SELECT count(*) FROM p JOIN {{0}} USING (doc_id) WHERE {flag})") for i, (flag, least) in enumerate(LEAST.items(), 2))},
{_more(4, "rest", "1", "0", "true", f"{TARGET} - (SELECT count(*) FROM {{0}})")}
SELECT * FROM ({_CHOSEN.format("s4")}) WHERE turn <= {TARGET}"""

LANGS, SOURCES = {"en": 220, "fr": 70, "de": 60, "es": 80}, {f"src{i}": 25 for i in (3, 1, 4, 0, 5, 9, 2)}
KINDS = {"middle": ("n_chars BETWEEN 1000 AND 1500", 100), "quick": ("n_chars < 300", 40), "slow": ("n_chars > 6000", 60)}
OTHERS, TOTAL = 290, 330


def gap_phases_selection(spark, sf_dir):
    """New documents where those held (the good ones) leave gaps: languages, sources, lengths; then drawn ones, English last."""
    pool = _pool(spark, sf_dir)
    by_lot = [F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string"))), F.col("doc_id")]
    phases = [
        sampling.Phase("languages", LANGS, "lang", gap=True),
        sampling.Phase("sources", SOURCES, "source", gap=True),
        *[sampling.Phase(name, {"": n}, where=F.expr(rule), gap=True) for name, (rule, n) in KINDS.items()],
        sampling.Phase("others", {"": OTHERS}, where=F.col("lang") != "en", counted=F.lit(True), order=by_lot),
        sampling.Phase("rest", {"": TOTAL}, counted=F.lit(True), order=by_lot),
    ]
    chosen = sampling.phased(pool.where("NOT good"), phases, "doc_id", _score(), have=pool.where("good"))
    return chosen.select("doc_id", "lang", "phase", "turn")


def _gap(i: int, name: str, label: str, targets: dict) -> str:
    need = f"greatest(0, {_CASE(label, targets)} - coalesce((SELECT count(*) FROM held h WHERE h.{label} = p.{label}), 0))"
    place = _CASE(label, {k: j for j, k in enumerate(targets)})
    return _more(i, name, label, f"-({need}) * 1000 + {place}", "true", need)


_LOT = "md5('7:' || doc_id), doc_id"
GAP_PHASES = f"""WITH {_POOL.replace(", p AS", ", pool AS").replace(chr(10) + "p AS", chr(10) + "pool AS")}, held AS (SELECT * FROM pool WHERE good), p AS (SELECT * FROM pool WHERE NOT good), {_NONE},
{_gap(1, "languages", "lang", LANGS)},
{_gap(2, "sources", "source", SOURCES)},
{", ".join(_more(i, name, "1", "0", rule, f"{n} - (SELECT count(*) FROM held WHERE {rule})") for i, (name, (rule, n)) in enumerate(KINDS.items(), 3))},
{_more(6, "others", "1", "0", "lang <> 'en'", f"{OTHERS} - (SELECT count(*) FROM {{0}})", _LOT)},
{_more(7, "rest", "1", "0", "true", f"{TOTAL} - (SELECT count(*) FROM {{0}})", _LOT)}
{_CHOSEN.format("s7")}"""

QUERIES = {
    "seat_allocation": (seat_allocation, f"WITH {_SEATS} SELECT * FROM seats"),
    "stratified_topn": (stratified_topn, STRATIFIED),
    "balanced_selection": (balanced_selection, BALANCED),
    "gap_fill_selection": (gap_fill_selection, GAP_FILL),
    "minimums_selection": (minimums_selection, MINIMUMS_SQL),
    "gap_phases_selection": (gap_phases_selection, GAP_PHASES),
}
