"""Registered queries over the driver's tables, each with its DuckDB counterpart where SQL can express it.

The tables hold no business records, so operators run on stand-ins: vectors with
even ids are entities and those with odd ids pool records, a vector's label is
its partition, its first half is the address view, and a pool record's owner is
the entity of its label before it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions import similarity as sim
from ..functions import vectors
from ..functions.parsing import normalize_records, number_codes_column
from ..functions.text import fold_column, ocr_form, phonetic_column, repair_digits_column, token_count
from ..operators import blocking, decision, diagnostics, embedding, features, lexicon, model, projector, relational, topk
from ..session import plain_unions
from ..sources.tables import submission

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(run):
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLE_SQL[run.__name__] = sql
        return run

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    plain_unions(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- scans, truth, splits ------------------------------------------------------------------------


@query("SELECT CAST(c_custkey AS VARCHAR) AS entity_id, c_name AS business_name, '' AS business_address, '' AS country FROM customer")
def scan_default_columns(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("entity_id"), F.col("c_name").alias("business_name"))
    return rows.withColumns({"business_address": F.lit(""), "country": F.lit("")})


def truth(spark, sf_dir) -> DataFrame:
    """Each order's suppliers as a comma list; some orders have none."""
    lines = read(spark, sf_dir, "lineitem").where("l_quantity > 10").groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_set(F.col("l_suppkey").cast("string"))), ",").alias("ids"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey")
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select(F.col("o_orderkey").cast("string").alias("source1_entity_id"), F.coalesce("ids", F.lit("")).alias("matched_entity_ids"))


TRUTH_SQL = """t AS (SELECT o_orderkey, coalesce(ids, '') AS ids FROM orders LEFT JOIN (
  SELECT l_orderkey, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',') AS ids FROM lineitem WHERE l_quantity > 10 GROUP BY 1) ON o_orderkey = l_orderkey)"""


@query(f"WITH {TRUTH_SQL} SELECT CAST(o_orderkey AS VARCHAR) AS s1_id, unnest(string_split(ids, ',')) AS pool_id FROM t WHERE ids <> ''")
def truth_explode_links(spark, sf_dir):
    return relational.links_of(truth(spark, sf_dir))


@query(f"WITH {TRUTH_SQL} SELECT CAST(o_orderkey AS VARCHAR) AS s1_id, CAST(CASE WHEN ids = '' THEN 0 ELSE len(string_split(ids, ',')) END AS BIGINT) AS n_links FROM t")
def truth_owner_counts(spark, sf_dir):
    return relational.link_counts(truth(spark, sf_dir)).withColumn("n_links", F.col("n_links").cast("long"))


def _fraction_sql(key: str, seed: int) -> str:
    return f"(CAST(('0x' || substr(md5('{seed}:' || {key}), 1, 8)) AS BIGINT) / 4294967296.0)"


_KEY = "CAST(c_custkey AS VARCHAR)"


@query(f"""SELECT c_custkey, CASE WHEN {_fraction_sql(_KEY, 42)} < 0.2 THEN 'holdout' ELSE 'fit' END AS split,
CASE WHEN {_fraction_sql(_KEY, 42)} >= 0.2 THEN NULL WHEN {_fraction_sql(_KEY, 43)} < 0.5 THEN 'tune' ELSE 'report' END AS half FROM customer""")
def entity_split_hash(spark, sf_dir):
    return relational.entity_split(read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")


@query(f"SELECT c_custkey, c_name FROM customer ORDER BY {_fraction_sql(_KEY, 42)}, c_custkey LIMIT 100")
def exact_sample(spark, sf_dir):
    """A sampling operator: the limit is the feature."""
    return relational.exact_sample(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", 100)


@query(f"""WITH n AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS i, count(*) OVER () AS total FROM supplier)
SELECT c_custkey, s_suppkey AS negative_id FROM customer JOIN n ON i = CAST(floor({_fraction_sql(_KEY, 42)} * total) AS BIGINT)""")
def random_negatives(spark, sf_dir):
    return relational.negatives_with_replacement(read(spark, sf_dir, "customer"), read(spark, sf_dir, "supplier"), "c_custkey", "s_suppkey")


@query(f"SELECT c_custkey, CAST(floor({_fraction_sql(_KEY, 42)} * 5) AS BIGINT) AS fold FROM customer")
def group_kfold(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", relational.group_fold(F.col("c_custkey")).cast("long").alias("fold"))


@query("SELECT lang AS country, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS total, min(n_chars) AS least, max(n_chars) AS most, round(avg(n_chars), 6) AS mean, round(quantile_cont(n_chars, 0.5), 6) AS median FROM documents GROUP BY lang")
def summary_by_country(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").withColumnRenamed("lang", "country")
    n = F.col("n_chars")
    return rows.groupBy("country").agg(
        F.count("*").alias("n"), F.sum(n).alias("total"), F.min(n).alias("least"), F.max(n).alias("most"), F.round(F.avg(n), 6).alias("mean"), F.round(F.percentile(n, F.lit(0.5)), 6).alias("median")
    )


# -- text ----------------------------------------------------------------------------------------


@query("SELECT page_id, trim(regexp_replace(replace(replace(replace(lower(url), '&', ' and '), '@', ' '), '''', ''), '[^a-z0-9]+', ' ', 'g')) AS folded FROM pages")
def fold_ascii(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", fold_column(F.col("url")).alias("folded"))


_OCR_WORD = "translate(lower(p_name), 'ol', '01')"
_LETTER_0 = "regexp_replace(regexp_replace(w, '([a-z])0([a-z])', '\\1o\\2', 'g'), '([a-z])0([a-z])', '\\1o\\2', 'g')"
_LETTER_1 = "regexp_replace(regexp_replace(x, '([a-z])1([a-z])', '\\1l\\2', 'g'), '([a-z])1([a-z])', '\\1l\\2', 'g')"


@query(f"""WITH words AS (SELECT p_partkey, unnest(string_split(w, ' ')) AS w FROM (SELECT p_partkey, {_OCR_WORD} AS w FROM part)),
fixed AS (SELECT p_partkey, w, {_LETTER_0} AS x FROM words)
SELECT p_partkey, w AS word, CASE WHEN regexp_matches(w, '[a-z]') AND regexp_matches(w, '[0-9]') AND length(regexp_replace(w, '[^a-z]', '', 'g')) >= 3 THEN {_LETTER_1} ELSE w END AS repaired FROM fixed""")
def ocr_fix(spark, sf_dir):
    word = F.explode(F.split(F.translate(F.lower("p_name"), "ol", "01"), " "))
    return read(spark, sf_dir, "part").select("p_partkey", word.alias("word")).withColumn("repaired", repair_digits_column(F.col("word")))


def _collapse_sql(x: str) -> str:
    for c in "abcdefghijklmnopqrstuvwxyz":
        x = f"regexp_replace({x}, '{c}{{2,}}', '{c}', 'g')"
    return x


def _phonetic_sql(word: str) -> str:
    """The rewrites without look-around; the words here have no q after a c."""
    x = _collapse_sql(word)
    for pattern, by in [
        ("ph", "f"), ("m([kgtdcjsbp])", "n\\1"), ("ksh|x", "ks"), ("ck|q", "k"), ("c([aouklrt])", "k\\1"), ("c$", "k"), ("c", "s"), ("z", "j"), ("w", "v"), ("([kgcjtdpbs])h", "\\1"), ("ng$", "n"),
    ]:
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return x


@query(f"""WITH words AS (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS w FROM part),
keyed AS (SELECT p_partkey, w, {_phonetic_sql("w")} AS k FROM words)
SELECT p_partkey, w AS word, CASE WHEN regexp_full_match(w, '[a-z]+') THEN {_collapse_sql("k[1] || regexp_replace(k[2:], '[aeiouyh]', '', 'g')")} ELSE w END AS phonetic FROM keyed""")
def phonetic_key(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", F.explode(F.split(F.lower("p_name"), " ")).alias("word"))
    return rows.withColumn("phonetic", phonetic_column(F.col("word")))


_ENDINGS = ["Limited", "L.L.C.", "Pvt. Ltd.", "& Company", "Gallery"]
_LEGAL = ["ltd", "llc", "pvt_ltd", "co", ""]


@query(f"""SELECT p_partkey, lower(p_name) || CASE WHEN p_size % 5 = 4 THEN ' gallery' ELSE '' END AS name_core,
{[*_LEGAL]}[p_size % 5 + 1] AS legal FROM part""")
def name_legal_core(spark, sf_dir):
    ending = F.element_at(F.array(*map(F.lit, _ENDINGS)), (F.col("p_size") % 5 + 1).cast("int"))
    rows = read(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", ending).alias("business_name"), F.lit("").alias("business_address"), F.lit("US").alias("country"))
    return normalize_records(rows).select("p_partkey", "name_core", "legal")


_STATES = ["NY", "New Mexico", "Bombay", "TX", "", "Rhode Island", "district of columbia", "wy", "Puerto Rico", "Gironde"]
_CODES = ["us_ny", "us_nm", "", "us_tx", "", "us_ri", "us_dc", "us_wy", "us_pr", ""]


@query(f"SELECT c_custkey, {[*_CODES]}[c_nationkey % 10 + 1] AS state, coalesce(nullif(ltrim(regexp_extract(c_name, '[0-9]+'), '0'), ''), '0') AS house_num FROM customer")
def state_lookup(spark, sf_dir):
    state = F.element_at(F.array(*map(F.lit, _STATES)), (F.col("c_nationkey") % 10 + 1).cast("int"))
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.lit("x").alias("business_name"), F.concat_ws(", ", "c_name", state).alias("business_address"), F.lit("US").alias("country"))
    return normalize_records(rows).select("c_custkey", "state", "house_num")


_CODES_SQL = """array_to_string(list_filter(list_transform(list_transform(regexp_extract_all(lower(url), '[a-z]?[0-9][0-9a-z/#-]*'),
lambda c: regexp_replace(regexp_replace(c, '[/#-]', '', 'g'), '^0*([0-9]+)(st|nd|rd|th|eme|er|e)?$', '\\1')), lambda c: ltrim(c, '0')), lambda c: c <> ''), ' ')"""


@query(f"""WITH c AS (SELECT page_id, {_CODES_SQL} AS every FROM pages),
d AS (SELECT page_id, coalesce((SELECT string_agg(x, ' ' ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT unnest(string_split(every, ' ')) AS x, generate_subscripts(string_split(every, ' '), 1) AS i) GROUP BY x)), '') AS codes FROM c)
SELECT page_id, codes, CAST(CASE WHEN codes = '' THEN 0 WHEN list_has_any(string_split(codes, ' '), [CAST(page_id AS VARCHAR), '1', '2']) THEN 1 ELSE -1 END AS BIGINT) AS overlap FROM d""")
def number_codes_overlap(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select("page_id", number_codes_column(F.col("url")).alias("codes"))
    return rows.withColumn("overlap", sim.number_overlap(F.col("codes"), F.concat_ws(" ", F.col("page_id").cast("string"), F.lit("1"), F.lit("2"))).cast("long"))


@query("""WITH c AS (SELECT c_custkey, c_mktsegment AS a, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE lead(c_mktsegment, 1, '') OVER (ORDER BY c_custkey) END AS b, c_name FROM customer)
SELECT c_custkey, CAST(CASE WHEN a = '' OR b = '' THEN 0 WHEN a = b THEN 1 ELSE -1 END AS BIGINT) AS slot, CAST(split_part(a, ' ', 1) = split_part(b, ' ', 1) AS BIGINT) AS first_eq,
CAST(length(c_name) - length(replace(c_name, ' ', '')) + 1 AS BIGINT) AS n_tokens, replace(translate(c_name, '10v', 'lou'), 'rn', 'm') AS ocr FROM c""")
def ternary_slots(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("a"), "c_name")
    # The next customer by key: keys are numbered without gaps, so the neighbour is a join, not a global sort.
    after = rows.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("a").alias("b"))
    rows = rows.join(after, "c_custkey", "left").withColumn("b", F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.coalesce("b", F.lit(""))))
    return rows.select("c_custkey", sim.ternary(F.col("a"), F.col("b")).cast("long").alias("slot"), sim.first_token_equal(F.col("a"), F.col("b")).cast("long").alias("first_eq"), token_count(F.col("c_name")).cast("long").alias("n_tokens"), ocr_form(F.col("c_name")).alias("ocr"))


_GRAMS_SQL = """p AS (SELECT DISTINCT p_name FROM part), w AS (SELECT p_name, unnest(list_filter(regexp_split_to_array(lower(p_name), '\\s+'), lambda x: x <> '')) AS word FROM p),
padded AS (SELECT p_name, ' ' || word || ' ' AS x FROM w), sized AS (SELECT p_name, x, unnest([2, 3, 4]) AS n FROM padded),
g AS (SELECT p_name, unnest(list_transform(range(1, greatest(length(x) - n + 1, 1) + 1), lambda i: x[i:i + n - 1])) AS gram FROM sized WHERE length(x) >= n),
tf AS (SELECT p_name AS id, gram, count(*) AS tf FROM g GROUP BY 1, 2)"""


@query(f"WITH {_GRAMS_SQL} SELECT id, gram, tf FROM tf")
def char_ngrams(spark, sf_dir):
    return vectors.term_frequencies(read(spark, sf_dir, "part").select("p_name").distinct(), "p_name", "p_name")


@query(f"""WITH {_GRAMS_SQL}, df AS (SELECT gram, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n FROM p),
raw AS (SELECT id, gram, (1 + ln(tf)) * (ln((1.0 + n) / (1.0 + df)) + 1) AS r FROM tf JOIN df USING (gram), n), norm AS (SELECT id, sqrt(sum(r * r)) AS norm FROM raw GROUP BY 1)
SELECT id, gram, round(r / norm, 6) AS w FROM raw JOIN norm USING (id)""")
def tfidf_weights(spark, sf_dir):
    names = read(spark, sf_dir, "part").select("p_name").distinct()
    tf = vectors.term_frequencies(names, "p_name", "p_name")
    return vectors.tfidf(tf, vectors.document_frequencies(tf), names.count()).withColumn("w", F.round("w", 6))


# -- similarity: all pairs of the distinct names, a few dozen ------------------------------------


def _name_pairs(spark, sf_dir) -> DataFrame:
    names = read(spark, sf_dir, "part").select("p_name").distinct()
    return names.select(F.col("p_name").alias("a")).join(names.select(F.col("p_name").alias("b")), F.col("a") <= F.col("b"))


def _similarity(name: str):
    def run(spark, sf_dir):
        return _name_pairs(spark, sf_dir).select("a", "b", F.round(sim.similarity(name, F.col("a"), F.col("b")), 6).alias("score"))

    return run


_PAIRS_SQL = "WITH p AS (SELECT DISTINCT p_name FROM part), pairs AS (SELECT x.p_name AS a, y.p_name AS b FROM p x JOIN p y ON x.p_name <= y.p_name)"
QUERIES |= {f"sim_{label}": _similarity(name) for label, name in (("jaro_winkler", "jaro_winkler"), ("indel_ratio", "ratio"), ("token_set", "token_set"), ("token_sort", "token_sort"), ("partial", "partial"))}
ORACLE_SQL["sim_jaro_winkler"] = f"{_PAIRS_SQL} SELECT a, b, round(jaro_winkler_similarity(a, b), 6) AS score FROM pairs"


def _lcs_sql(a: str, b: str) -> str:
    """Longest common subsequence, a row of the table per letter of ``a``, folded over its letters."""
    row = f"""list_reduce(list_concat([[0 for _ in range(length({b}) + 1)]], [[ascii(c)] for c in string_split({a}, '')]), lambda prev, c:
list_reduce(list_concat([[0]], [[prev[j + 1], prev[j], CAST({b}[j] = chr(c[1]) AS INTEGER)] for j in range(1, length({b}) + 1)]), lambda done, x:
list_append(done, greatest(done[-1], x[1], x[2] + x[3]))))"""
    return f"({row})[-1]"


for _label, _a, _b in (("indel_ratio", "a", "b"), ("token_sort", "array_to_string(list_sort(string_split(a, ' ')), ' ')", "array_to_string(list_sort(string_split(b, ' ')), ' ')")):
    ORACLE_SQL[f"sim_{_label}"] = f"{_PAIRS_SQL}, s AS (SELECT a, b, {_a} AS x, {_b} AS y FROM pairs) SELECT a, b, round(2.0 * {_lcs_sql('x', 'y')} / (length(x) + length(y)), 6) AS score FROM s"


_REST = "array_to_string(list_sort(list_filter({0}, lambda x: NOT list_contains({1}, x))), ' ')"
ORACLE_SQL["sim_token_set"] = f"""{_PAIRS_SQL}, w AS (SELECT a, b, list_distinct(string_split(a, ' ')) AS u, list_distinct(string_split(b, ' ')) AS v FROM pairs),
r AS (SELECT a, b, {_REST.format("u", "v")} AS x, {_REST.format("v", "u")} AS y, length(array_to_string(list_sort(list_intersect(u, v)), ' ')) AS c FROM w),
g AS (SELECT *, CAST(c > 0 AS INTEGER) AS gap, length(x) AS m, length(y) AS n FROM r)
SELECT a, b, round(CASE WHEN c > 0 AND (x = '' OR y = '') THEN 1.0 ELSE greatest(1 - (m + n - 2.0 * {_lcs_sql('x', 'y')}) / (2 * (c + gap) + m + n),
CASE WHEN c > 0 THEN greatest(1 - 1.0 * (gap + m) / (2 * c + gap + m), 1 - 1.0 * (gap + n) / (2 * c + gap + n)) ELSE 0.0 END) END, 6) AS score FROM g"""


# -- retrieval on vectors ------------------------------------------------------------------------


def records(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Entities and pool: ``id, part, name_vec, addr_vec, has_addr, n`` (the vector's number)."""
    rows = read(spark, sf_dir, "embeddings")
    n = F.col("vec_id")
    prefix = F.when(n % 2 == 0, "S1-").when(n % 4 == 1, "S2-").otherwise("S3-")
    rows = rows.select(
        F.concat(prefix, F.lpad(n.cast("string"), 9, "0")).alias("id"), F.col("label").cast("string").alias("part"), F.col("embedding").alias("name_vec"),
        F.slice("embedding", 1, 32).alias("addr_vec"), (n % 7 != 0).alias("has_addr"), n.alias("n"),
    )
    return rows.where(n % 2 == 0), rows.where(n % 2 == 1)


RECORDS_SQL = """r AS (SELECT CASE WHEN vec_id % 2 = 0 THEN 'S1-' WHEN vec_id % 4 = 1 THEN 'S2-' ELSE 'S3-' END || lpad(CAST(vec_id AS VARCHAR), 9, '0') AS id, CAST(label AS VARCHAR) AS part,
CAST(embedding AS DOUBLE[]) AS nv, CAST(embedding[1:32] AS DOUBLE[]) AS av, vec_id % 7 <> 0 AS has_addr, vec_id AS n FROM embeddings),
s1 AS (SELECT * FROM r WHERE n % 2 = 0), pool AS (SELECT * FROM r WHERE n % 2 = 1)"""


def _hits_sql(name: str, vector: str, where: str, k: int = 8) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT p.id AS pool_id, s.id AS s1_id, round(list_inner_product(p.{vector}, s.{vector}), 9) AS score,
row_number() OVER (PARTITION BY p.id ORDER BY round(list_inner_product(p.{vector}, s.{vector}), 9) DESC, s.id) AS rank FROM pool p JOIN s1 s ON p.part = s.part{where}) WHERE rank <= {k})"""


_ADDR = " AND p.has_addr AND s.has_addr"


def _hits(spark, sf_dir, k: int = 8):
    s1, pool = records(spark, sf_dir)
    name = topk.topk_join(*(x.select("id", "part", F.col("name_vec").alias("v")) for x in (s1, pool)), k, digits=9)
    addr = topk.topk_join(*(x.where("has_addr").select("id", "part", F.col("addr_vec").alias("v")) for x in (s1, pool)), k, digits=9)
    return s1, pool, name, addr


@query(f"WITH {RECORDS_SQL}, {_hits_sql('h', 'nv', '')} SELECT pool_id, s1_id, score, rank FROM h")
def topk_partitioned_ip(spark, sf_dir):
    return _hits(spark, sf_dir)[2].withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {RECORDS_SQL}, {_hits_sql('h', 'nv', '')} SELECT pool_id, s1_id, score, rank FROM h")
def topk_join_sql(spark, sf_dir):
    s1, pool = (x.select("id", "part", F.col("name_vec").alias("v")) for x in records(spark, sf_dir))
    return topk.topk_join_sql(s1, pool, 8).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {RECORDS_SQL}, asked AS (SELECT * REPLACE (CASE WHEN n % 5 = 1 THEN 'nowhere' ELSE part END AS part) FROM pool), known AS (SELECT DISTINCT part FROM s1)
SELECT * FROM (SELECT p.id AS pool_id, s.id AS s1_id, round(list_inner_product(p.nv, s.nv), 9) AS score,
row_number() OVER (PARTITION BY p.id ORDER BY round(list_inner_product(p.nv, s.nv), 9) DESC, s.id) AS rank FROM asked p JOIN s1 s ON p.part = s.part OR p.part NOT IN (SELECT part FROM known)) WHERE rank <= 8""")
def topk_unknown_partition(spark, sf_dir):
    s1, pool = records(spark, sf_dir)
    pool = pool.withColumn("part", F.when(F.col("n") % 5 == 1, "nowhere").otherwise(F.col("part")))
    return topk.topk_join(*(x.select("id", "part", F.col("name_vec").alias("v")) for x in (s1, pool)), 8, digits=9).withColumn("rank", F.col("rank").cast("long"))


def _ranked_sql(kk: int, suffix: str = "") -> str:
    return f"""u{suffix} AS (SELECT pool_id, s1_id, bool_or(rank = 1) AS top_view FROM (SELECT * FROM hn UNION ALL SELECT * FROM ha) WHERE rank <= {kk} GROUP BY 1, 2),
c{suffix} AS (SELECT u.*, p.has_addr, round(list_inner_product(p.nv, s.nv), 9) AS ret_cos_name, CASE WHEN p.has_addr AND s.has_addr THEN round(list_inner_product(p.av, s.av), 9) ELSE 0 END AS ret_cos_addr, p.has_addr AND s.has_addr AS both_addr
FROM u{suffix} u JOIN pool p ON p.id = pool_id JOIN s1 s ON s.id = s1_id),
b{suffix} AS (SELECT *, round(CASE WHEN both_addr THEN 0.4::DOUBLE * ret_cos_name + 0.6::DOUBLE * ret_cos_addr ELSE ret_cos_name END, 9) AS ret_cos FROM c{suffix}),
k{suffix} AS (SELECT *, row_number() OVER (PARTITION BY pool_id ORDER BY ret_cos DESC, s1_id) - 1 AS ret_rev_rank, max(ret_cos) OVER (PARTITION BY pool_id) AS ret_rev_best FROM b{suffix})"""


def _kept_sql(k: int, kk: int, margin: float, suffix: str = "") -> str:
    return f"""kept{suffix} AS (SELECT * FROM k{suffix} WHERE top_view OR ret_rev_rank = 0 OR (ret_rev_rank < {k} AND ret_rev_best - ret_cos <= {margin}::DOUBLE + 1e-12)
OR (NOT has_addr AND ret_rev_rank < {kk} AND ret_rev_best - ret_cos <= {2 * margin}::DOUBLE + 1e-12))"""


_REVERSE_SQL = f"{RECORDS_SQL}, {_hits_sql('hn', 'nv', '')}, {_hits_sql('ha', 'av', _ADDR)}, {_ranked_sql(8)}, {_kept_sql(6, 8, 0.1)}"
CANDIDATES_SQL = f"{_REVERSE_SQL}, cands AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY ret_cos DESC, pool_id) AS ret_fwd_rank FROM kept) WHERE ret_fwd_rank <= 30)"
_COLUMNS = "s1_id, pool_id, ret_cos, ret_cos_name, CAST(ret_cos_addr AS DOUBLE) AS ret_cos_addr, ret_rev_rank, ret_rev_best, round(ret_cos - ret_rev_best, 9) AS ret_rev_margin"


def _tidy(rows: DataFrame) -> DataFrame:
    ranks = {c: F.col(c).cast("long") for c in ("ret_rev_rank", "ret_fwd_rank") if c in rows.columns}
    return rows.withColumns(ranks | {"ret_rev_margin": F.round("ret_rev_margin", 9)})


@query(f"WITH {_REVERSE_SQL} SELECT {_COLUMNS} FROM kept")
def reverse_assignment_keep(spark, sf_dir):
    s1, pool, name, addr = _hits(spark, sf_dir)
    scored = blocking.score_pairs(blocking.union_views(name, addr), s1, pool, 0.4, 9)
    kept = blocking.keep(blocking.reverse_ranks(scored), 6, 0.1)
    return _tidy(kept.select(*(c for c in blocking.RETRIEVED if c != "ret_fwd_rank")))


def candidates(spark, sf_dir) -> DataFrame:
    s1, pool = records(spark, sf_dir)
    return blocking.generate(s1, pool, digits=9)


@query(f"WITH {CANDIDATES_SQL} SELECT {_COLUMNS}, ret_fwd_rank FROM cands")
def forward_rank_cap(spark, sf_dir):
    return _tidy(candidates(spark, sf_dir))


@query(f"""WITH {CANDIDATES_SQL} SELECT s1_id, pool_id, CAST(count(*) OVER w AS BIGINT) AS grp_size, rank() OVER (w ORDER BY ret_cos DESC) AS grp_rank_cos, round(ret_cos - max(ret_cos) OVER w, 6) AS grp_margin_cos,
rank() OVER (w ORDER BY ret_cos_name DESC) AS grp_rank_name, round(ret_cos_name - max(ret_cos_name) OVER w, 6) AS grp_margin_name FROM cands WINDOW w AS (PARTITION BY s1_id)""")
def group_features(spark, sf_dir):
    rows = candidates(spark, sf_dir)
    own = Window.partitionBy("s1_id")
    out = features.group_features(rows, name="ret_cos_name")
    exact = {f"grp_margin_{a}": F.round(F.col(c) - F.max(c).over(own), 6) for a, c in (("cos", "ret_cos"), ("name", "ret_cos_name"))}
    out = out.withColumns(exact)
    return out.select("s1_id", "pool_id", *(F.col(c).cast("long").alias(c) for c in ("grp_size", "grp_rank_cos", "grp_rank_name")), *exact)


def links(spark, sf_dir) -> DataFrame:
    """``s1_id, pool_id``: two of three pool records belong to the entity of their label before them."""
    s1, pool = records(spark, sf_dir)
    pool = pool.where("n % 3 <> 0").select(F.col("id").alias("pool_id"), "part", F.col("n").alias("p"))
    both = pool.join(s1.select(F.col("id").alias("s1_id"), "part", F.col("n").alias("s")), "part").where("s < p")
    return both.groupBy("pool_id").agg(F.max("s1_id").alias("s1_id")).select("s1_id", "pool_id")


LINKS_SQL = "links AS (SELECT max(s.id) AS s1_id, p.id AS pool_id FROM pool p JOIN s1 s ON p.part = s.part AND s.n < p.n WHERE p.n % 3 <> 0 GROUP BY p.id)"


@query(f"""WITH {CANDIDATES_SQL}, {LINKS_SQL}, neg AS (SELECT c.s1_id, arg_min(c.pool_id, c.ret_fwd_rank) AS negative_id FROM cands c ANTI JOIN links l ON c.s1_id = l.s1_id AND c.pool_id = l.pool_id GROUP BY 1)
SELECT l.s1_id, l.pool_id AS positive_id, negative_id FROM links l JOIN neg ON neg.s1_id = l.s1_id""")
def triplet_mining(spark, sf_dir):
    return relational.triplets(links(spark, sf_dir), candidates(spark, sf_dir))


def scored(spark, sf_dir) -> DataFrame:
    """Candidates with a stand-in probability, label and country."""
    rows = candidates(spark, sf_dir).withColumn("prob", F.round((F.col("ret_cos") + 1) / 2, 10))
    rows = relational.with_labels(rows, relational.checked_owners(links(spark, sf_dir)))
    return rows.withColumn("country", country(F.col("s1_id"))).select("s1_id", "pool_id", "country", "prob", "label")


def country(s1_id: Column) -> Column:
    return F.when(s1_id.substr(4, 9).cast("long") % 4 == 0, "US").otherwise("India")


_COUNTRY_SQL = "CASE WHEN CAST(substr(s1_id, 4) AS BIGINT) % 4 = 0 THEN 'US' ELSE 'India' END"
SCORED_SQL = f"""{CANDIDATES_SQL}, {LINKS_SQL}, scored AS (SELECT c.s1_id, c.pool_id, {_COUNTRY_SQL.replace("s1_id", "c.s1_id")} AS country, round((ret_cos + 1) / 2, 10) AS prob, CASE WHEN l.s1_id = c.s1_id THEN 1 ELSE 0 END AS label
FROM cands c LEFT JOIN links l ON l.pool_id = c.pool_id),
excl AS (SELECT s1_id, pool_id, country, label, CASE WHEN row_number() OVER (PARTITION BY pool_id ORDER BY prob DESC, s1_id) = 1 THEN prob ELSE 0 END AS prob FROM scored),
entities AS (SELECT id AS s1_id, {_COUNTRY_SQL.replace("s1_id", "id")} AS country, coalesce(n_true, 0) AS n_true FROM s1 LEFT JOIN (SELECT s1_id, count(*) AS n_true FROM links GROUP BY 1) ON s1_id = id)"""


@query(f"WITH {SCORED_SQL} SELECT s1_id, pool_id, CAST(label AS BIGINT) AS label FROM scored")
def owner_labels(spark, sf_dir):
    return scored(spark, sf_dir).select("s1_id", "pool_id", F.col("label").cast("long").alias("label"))


@query(f"""WITH {SCORED_SQL} SELECT s1_id, pool_id, CASE WHEN CAST(substr(pool_id, 4) AS BIGINT) % 5 = 0 THEN round(prob / 2, 11) ELSE prob END AS prob FROM scored""")
def oof_override(spark, sf_dir):
    rows = scored(spark, sf_dir).select("s1_id", "pool_id", "prob")
    oof = rows.where(F.col("pool_id").substr(4, 9).cast("long") % 5 == 0).withColumn("prob", F.round(F.col("prob") / 2, 11))
    return relational.override(rows, oof)


@query(f"WITH {SCORED_SQL} SELECT s1_id, pool_id, CAST(prob AS DOUBLE) AS prob FROM excl")
def exclusive_assignment(spark, sf_dir):
    return decision.exclusive_assignment(scored(spark, sf_dir)).select("s1_id", "pool_id", "prob")


_GATE = (0.6, 0.55, 0.1)
_SELECTED_SQL = f"""{SCORED_SQL}, gated AS (SELECT *, max(prob) OVER (PARTITION BY s1_id) AS best FROM excl),
decided AS (SELECT *, best >= {_GATE[0]}::DOUBLE AND prob >= {_GATE[1]}::DOUBLE AND best - prob <= {_GATE[2]}::DOUBLE AS selected FROM gated)"""


def decided(spark, sf_dir) -> DataFrame:
    return decision.select_pairs(decision.exclusive_assignment(scored(spark, sf_dir)), *_GATE)


def entities(spark, sf_dir) -> DataFrame:
    s1, _ = records(spark, sf_dir)
    n_true = links(spark, sf_dir).groupBy("s1_id").agg(F.count("*").alias("n_true"))
    return s1.select(F.col("id").alias("s1_id")).withColumn("country", country(F.col("s1_id"))).join(n_true, "s1_id", "left").fillna(0, ["n_true"])


@query(f"WITH {_SELECTED_SQL} SELECT s1_id, pool_id, selected FROM decided")
def gate_select(spark, sf_dir):
    return decided(spark, sf_dir).select("s1_id", "pool_id", "selected")


@query(f"""WITH {SCORED_SQL}, gated AS (SELECT *, max(prob) OVER (PARTITION BY s1_id) AS best FROM excl), th(country, ts, tm, dp) AS (VALUES ('default', 0.6::DOUBLE, 0.55::DOUBLE, 0.1::DOUBLE), ('US', 0.7, 0.5, 0.05))
SELECT s1_id, pool_id, best >= coalesce(o.ts, d.ts) AND prob >= coalesce(o.tm, d.tm) AND best - prob <= coalesce(o.dp, d.dp) AS selected
FROM gated g LEFT JOIN th o ON o.country = g.country, (SELECT * FROM th WHERE country = 'default') d""")
def gate_by_country(spark, sf_dir):
    thresholds = spark.createDataFrame([("default", *_GATE), ("US", 0.7, 0.5, 0.05)], "country string, tau_singleton double, tau_match double, delta_prob double")
    return decision.select_by_country(decision.exclusive_assignment(scored(spark, sf_dir)), thresholds).select("s1_id", "pool_id", "selected")


def _fbeta_sql(source: str, keys: str = "") -> str:
    return f"""SELECT e.s1_id, e.country{keys}, CASE WHEN n_true = 0 AND coalesce(pred, 0) = 0 THEN 1.0 WHEN coalesce(tp, 0) > 0 THEN 1.25 * (tp / pred) * (tp / n_true) / (0.25 * (tp / pred) + tp / n_true) ELSE 0.0 END AS f
FROM entities e LEFT JOIN (SELECT s1_id, CAST(sum(label) AS DOUBLE) AS tp, CAST(count(*) AS DOUBLE) AS pred FROM {source} WHERE selected GROUP BY 1) d ON d.s1_id = e.s1_id"""


@query(f"WITH {_SELECTED_SQL}, f AS ({_fbeta_sql('decided')}) SELECT round(avg(f), 9) AS macro_f FROM f")
def macro_fbeta(spark, sf_dir):
    return decision.macro_fbeta(decided(spark, sf_dir), entities(spark, sf_dir)).select(F.round("macro_f", 9).alias("macro_f"))


@query(f"""WITH {_SELECTED_SQL}, f AS ({_fbeta_sql('decided')}), own AS (SELECT country, avg(f) AS m FROM f GROUP BY 1)
SELECT country, round(m, 9) AS macro_f FROM own UNION ALL SELECT 'all', round(avg(f), 9) FROM f UNION ALL SELECT 'mean', round(avg(m), 9) FROM own""")
def macro_fbeta_by_country(spark, sf_dir):
    return decision.macro_by_country(decided(spark, sf_dir), entities(spark, sf_dir)).select("country", F.round("macro_f", 9).alias("macro_f"))


_GRID_SQL = f"""points AS (SELECT row_number() OVER (ORDER BY i, j, k) - 1 AS point, ts, tm, dp FROM (SELECT unnest({fixed.TAU_SINGLETON}::DOUBLE[]) AS ts, generate_subscripts({fixed.TAU_SINGLETON}, 1) AS i) a,
(SELECT unnest({fixed.TAU_MATCH}::DOUBLE[]) AS tm, generate_subscripts({fixed.TAU_MATCH}, 1) AS j) b, (SELECT unnest({fixed.DELTA_PROB}::DOUBLE[]) AS dp, generate_subscripts({fixed.DELTA_PROB}, 1) AS k) c WHERE tm <= ts)"""


@query(f"""WITH {SCORED_SQL}, gated AS (SELECT *, max(prob) OVER (PARTITION BY s1_id) AS best FROM excl), {_GRID_SQL},
d AS (SELECT point, s1_id, CAST(sum(label) AS DOUBLE) AS tp, CAST(count(*) AS DOUBLE) AS pred FROM gated, points WHERE best >= ts AND prob >= tm AND best - prob <= dp GROUP BY 1, 2),
f AS (SELECT p.point, p.ts, p.tm, p.dp, CASE WHEN n_true = 0 AND coalesce(pred, 0) = 0 THEN 1.0 WHEN coalesce(tp, 0) > 0 THEN 1.25 * (tp / pred) * (tp / n_true) / (0.25 * (tp / pred) + tp / n_true) ELSE 0.0 END AS f
FROM entities e CROSS JOIN points p LEFT JOIN d ON d.s1_id = e.s1_id AND d.point = p.point)
SELECT point, ts AS tau_singleton, tm AS tau_match, dp AS delta_prob, round(avg(f), 9) AS score FROM f GROUP BY 1, 2, 3, 4""")
def gate_thresholds_grid(spark, sf_dir):
    return decision.grid_scores(decision.exclusive_assignment(scored(spark, sf_dir)), entities(spark, sf_dir), digits=9).withColumn("point", F.col("point").cast("long"))


@query(f"""WITH {SCORED_SQL}, sizes AS (SELECT coalesce(n, 0) AS n FROM entities e LEFT JOIN (SELECT s1_id, count(*) AS n FROM cands GROUP BY 1) c ON c.s1_id = e.s1_id),
found AS (SELECT count(*) AS total, count(c.s1_id) AS captured FROM links l LEFT JOIN cands c ON c.s1_id = l.s1_id AND c.pool_id = l.pool_id)
SELECT round(captured / total, 9) AS recall, captured, total, round(avg(n), 9) AS mean_candidates, round(quantile_cont(n, 0.95), 9) AS p95_candidates, round(1 - sum(n) / (count(*) * (SELECT count(*) FROM pool)), 9) AS reduction_ratio FROM sizes, found GROUP BY captured, total""")
def blocking_recall(spark, sf_dir):
    _, pool = records(spark, sf_dir)
    out = blocking.blocking_stats(candidates(spark, sf_dir), links(spark, sf_dir), entities(spark, sf_dir), pool.count())
    return out.withColumns({c: F.round(c, 9) for c in ("recall", "mean_candidates", "p95_candidates", "reduction_ratio")})


def _states(spark, sf_dir):
    """Records with a state that differs from the partition for some."""
    s1, pool = records(spark, sf_dir)
    state = F.when(F.col("n") % 11 == 0, "").when(F.col("part") == "3", "us_dc").when(F.col("part") == "4", "us_wa").otherwise(F.col("part"))
    s1 = s1.select(F.col("id").alias("entity_id"), state.alias("state"))
    return s1, pool.select(F.col("id").alias("entity_id"), F.when(F.col("n") % 13 == 0, "9x").otherwise(state).alias("state"))


_STATE_SQL = "CASE WHEN n % 11 = 0 THEN '' WHEN part = '3' THEN 'us_dc' WHEN part = '4' THEN 'us_wa' ELSE part END"
_PART_SQL = "CASE {0} WHEN 'us_dc' THEN 'us_wa' WHEN 'in_ts' THEN 'in_ap' ELSE {0} END"


@query(f"""WITH {CANDIDATES_SQL}, {LINKS_SQL}, ss AS (SELECT id, {_STATE_SQL} AS s FROM s1), ps AS (SELECT id, CASE WHEN n % 13 = 0 THEN '9x' ELSE {_STATE_SQL} END AS p FROM pool),
missed AS (SELECT * FROM links l ANTI JOIN cands c ON c.s1_id = l.s1_id AND c.pool_id = l.pool_id)
SELECT s1_id, pool_id, CASE WHEN s = '' THEN 'unobserved_state_s1' WHEN p = '' THEN 'unobserved_state_pool' WHEN {_PART_SQL.format("s")} <> {_PART_SQL.format("p")} THEN 'wrong_partition' ELSE 'same_partition_miss' END AS reason
FROM missed JOIN ss ON ss.id = s1_id JOIN ps ON ps.id = pool_id""")
def miss_classification(spark, sf_dir):
    return diagnostics.classify_misses(links(spark, sf_dir), candidates(spark, sf_dir), *_states(spark, sf_dir))


@query(f"""WITH {CANDIDATES_SQL}, {LINKS_SQL}, {_hits_sql('wn', 'nv', '', 30)}, {_hits_sql('wa', 'av', _ADDR, 30)}, missed AS (SELECT * FROM links l ANTI JOIN cands c ON c.s1_id = l.s1_id AND c.pool_id = l.pool_id),
bests AS (SELECT least(coalesce(wn.rank, 999), coalesce(wa.rank, 999)) AS best FROM missed m LEFT JOIN wn ON wn.s1_id = m.s1_id AND wn.pool_id = m.pool_id LEFT JOIN wa ON wa.s1_id = m.s1_id AND wa.pool_id = m.pool_id)
SELECT CASE WHEN best <= 5 THEN 'top_5' WHEN best <= 10 THEN 'top_6_10' WHEN best <= 20 THEN 'top_11_20' WHEN best <= 30 THEN 'top_21_30' ELSE 'beyond_30' END AS bucket, count(*) AS n FROM bests GROUP BY 1""")
def miss_rank_buckets(spark, sf_dir):
    _, _, name, addr = _hits(spark, sf_dir, 30)
    return diagnostics.rank_buckets(relational.missed_links(links(spark, sf_dir), candidates(spark, sf_dir)), name, addr)


def _sweep_sql() -> str:
    parts, rows = [], []
    for i, (k, kk, margin) in enumerate(diagnostics.SWEEP):
        parts += [_ranked_sql(kk, str(i)), _kept_sql(k, kk, margin, str(i))]
        rows.append(f"""SELECT {k} AS k, {kk} AS kk, {margin}::DOUBLE AS margin, (SELECT count(*) FROM links) AS linked, count(DISTINCT CASE WHEN l.s1_id = x.s1_id THEN x.pool_id END) AS captured, count(*) AS pairs
FROM kept{i} x LEFT JOIN links l ON l.pool_id = x.pool_id""")
    return f"WITH {RECORDS_SQL}, {LINKS_SQL}, {_hits_sql('hn', 'nv', '', 15)}, {_hits_sql('ha', 'av', _ADDR, 15)}, {', '.join(parts)} {' UNION ALL '.join(rows)}"


@query(_sweep_sql())
def retrieval_sweep(spark, sf_dir):
    s1, pool, name, addr = _hits(spark, sf_dir, 15)
    return diagnostics.retrieval_sweep(name, addr, s1, pool, relational.checked_owners(links(spark, sf_dir)), digits=9)


@query(f"""WITH {CANDIDATES_SQL}, {LINKS_SQL}, x AS (SELECT round(list_inner_product(s.nv, p.nv), 9) AS n, round(list_inner_product(s.av, p.av), 9) AS a FROM links l JOIN s1 s ON s.id = s1_id JOIN pool p ON p.id = pool_id)
SELECT 'name' AS view, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS median, round(quantile_cont(n, 0.1), 6) AS p10 FROM x UNION ALL SELECT 'addr', round(avg(a), 6), round(quantile_cont(a, 0.5), 6), round(quantile_cont(a, 0.1), 6) FROM x""")
def true_pair_similarity(spark, sf_dir):
    s1, pool = records(spark, sf_dir)
    left = s1.select(F.col("id").alias("s1_id"), F.col("name_vec").alias("sn"), F.col("addr_vec").alias("sa"))
    right = pool.select(F.col("id").alias("pool_id"), F.col("name_vec").alias("pn"), F.col("addr_vec").alias("pa"))
    pairs = links(spark, sf_dir).join(left, "s1_id").join(right, "pool_id")
    pairs = pairs.select(F.round(vectors.dot(F.col("sn"), F.col("pn")), 9).alias("name"), F.round(vectors.dot(F.col("sa"), F.col("pa")), 9).alias("addr"))
    return diagnostics.similarity_stats(pairs, ["name", "addr"]).withColumns({c: F.round(c, 6) for c in ("mean", "median", "p10")})


@query(f"""WITH {_SELECTED_SQL} SELECT * FROM (SELECT s1_id, pool_id, prob::DOUBLE AS prob, 'false_positive' AS kind FROM decided WHERE selected AND label = 0 ORDER BY prob DESC, s1_id, pool_id LIMIT 20)
UNION ALL SELECT * FROM (SELECT s1_id, pool_id, prob::DOUBLE, 'false_negative' FROM decided WHERE NOT selected AND label = 1 ORDER BY prob DESC, s1_id, pool_id LIMIT 20)""")
def error_samples(spark, sf_dir):
    """A report of the surest errors: the limit is the feature."""
    return diagnostics.error_samples(decided(spark, sf_dir)).select("s1_id", "pool_id", "prob", "kind")


@query(f"""WITH {_SELECTED_SQL}, lists AS (SELECT s1_id, string_agg(pool_id, ',' ORDER BY pool_id) AS ids FROM decided WHERE selected GROUP BY 1)
SELECT id AS source1_entity_id, coalesce(ids, '') AS matched_entity_ids FROM s1 LEFT JOIN lists ON s1_id = id""")
def submission_lists(spark, sf_dir):
    s1, _ = records(spark, sf_dir)
    return submission(s1.select(F.col("id").alias("entity_id")), decided(spark, sf_dir).where("selected"), "matched_entity_ids")


@query(f"""WITH {CANDIDATES_SQL}, x AS (SELECT s1_id, pool_id, substr(pool_id, 1, 2) AS source, ret_cos AS sim, nv, CAST(n % 3 AS VARCHAR) AS postal FROM cands JOIN pool ON pool.id = pool_id),
o AS (SELECT a.s1_id, a.pool_id, greatest(max(round(list_inner_product(a.nv, b.nv), 9)), -1) AS m, max(CAST(a.postal = b.postal AS INTEGER)) AS agree FROM x a JOIN x b ON a.s1_id = b.s1_id AND a.source <> b.source GROUP BY 1, 2)
SELECT x.s1_id, x.pool_id, row_number() OVER (PARTITION BY x.s1_id, source ORDER BY sim DESC, x.pool_id) - 1 AS cand_src_rank, round(sim - max(sim) OVER (PARTITION BY x.s1_id, source), 9) AS cand_src_margin,
coalesce(m, 0) AS cross_src_max_sim, CAST(coalesce(m, 0) >= 0.8 AS BIGINT) AS cross_src_has_partner, CAST(coalesce(agree, 0) AS BIGINT) AS cross_src_postal_agree FROM x LEFT JOIN o ON o.s1_id = x.s1_id AND o.pool_id = x.pool_id""")
def cross_source_triangulation(spark, sf_dir):
    _, pool = records(spark, sf_dir)
    own = pool.select(F.col("id").alias("pool_id"), F.col("name_vec").alias("name"), (F.col("n") % 3).cast("string").alias("postal"))
    rows = candidates(spark, sf_dir).select("s1_id", "pool_id", F.substring("pool_id", 1, 2).alias("source"), F.col("ret_cos").alias("sim")).join(own, "pool_id")
    out = features.cross_source(rows, lambda a, b: F.round(vectors.dot(a, b), 9))
    longs = [F.col(c).cast("long").alias(c) for c in ("cand_src_rank", "cross_src_has_partner", "cross_src_postal_agree")]
    return out.select("s1_id", "pool_id", F.round("cand_src_margin", 9).alias("cand_src_margin"), "cross_src_max_sim", *longs)


@query("""WITH q AS (SELECT DISTINCT 'q' || item_id AS id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: length(w) >= 3)) AS word FROM benchmark),
d AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: length(w) >= 3)) AS word FROM documents),
rare AS (SELECT word FROM d GROUP BY 1 HAVING count(*) <= 1500), h AS (SELECT d.id AS s1_id, q.id AS pool_id, count(*) AS hits FROM q JOIN d USING (word) JOIN rare USING (word) GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pool_id ORDER BY hits DESC, s1_id) AS rank FROM h) WHERE rank <= 50""")
def inverted_index_blocking(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.lit("all").alias("country"), "text")
    items = read(spark, sf_dir, "benchmark").select(F.concat(F.lit("q"), "item_id").alias("id"), F.lit("all").alias("country"), "text")
    return blocking.inverted_index(docs, items).withColumn("rank", F.col("rank").cast("long"))


# -- the forty features --------------------------------------------------------------------------


def _business_records(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The vectors' records with names of parts and addresses from their numbers; a pool record writes them a little differently."""
    names = read(spark, sf_dir, "part").select("p_name").distinct()
    # A few dozen names, numbered in order.
    names = names.select((F.row_number().over(Window.orderBy("p_name")) - 1).alias("k"), "p_name")
    out = []
    for rows, ending, road in zip(records(spark, sf_dir), ("Inc", "Limited"), ("Street", "ST")):
        k = F.pmod(F.col("n"), F.lit(64)) if ending == "Inc" else F.pmod(F.col("n") - 1, F.lit(64))
        named = rows.withColumn("k", k.cast("int")).join(F.broadcast(names), "k", "left")
        address = F.concat_ws(", ", F.concat_ws(" ", F.floor(F.col("n") / 10).cast("string"), F.lit("Quarry"), F.lit(road)), F.element_at(F.array(*map(F.lit, _STATES)), (F.col("part").cast("int") % 10 + 1)))
        out.append(named.select(F.col("id").alias("entity_id"), F.concat_ws(" ", F.coalesce("p_name", F.lit("Plain")), F.lit(ending)).alias("business_name"), F.when(F.col("n") % 7 != 0, address).otherwise("").alias("business_address"), F.lit("US").alias("country")))
    return out[0], out[1]


@query()
def pair_features(spark, sf_dir):
    """All forty features of all stand-in candidates; tests hold them against the scorers one by one."""
    s1, pool = (normalize_records(x) for x in _business_records(spark, sf_dir))
    rows = features.build(s1, pool, candidates(spark, sf_dir))
    return rows.select("s1_id", "pool_id", *(F.round(F.col(c).cast("double"), 4).alias(c) for c in fixed.FEATURES))


@query(f"""WITH {CANDIDATES_SQL}, x AS (SELECT s1_id, pool_id, ret_cos, CAST(substr(s1_id, 4) AS BIGINT) AS n, CAST(substr(pool_id, 4) AS BIGINT) AS m FROM cands),
f AS (SELECT s1_id, pool_id, CAST(n // 10 AS VARCHAR) AS h, CAST(m // 10 AS VARCHAR) AS g, n % 7 = 0 AS se, m % 7 = 0 AS ce FROM x)
SELECT s1_id, pool_id, CAST(se AS BIGINT) AS addr_s1_empty, CAST(ce AS BIGINT) AS addr_cand_empty, CAST(NOT se AND NOT ce AS BIGINT) AS addr_both_present, CAST(CASE WHEN se OR ce THEN 0 WHEN h = g THEN 1 ELSE -1 END AS BIGINT) AS addr_house_state,
CAST(CASE WHEN se OR ce OR h = '0' OR g = '0' THEN 0 WHEN h = g THEN 1 ELSE -1 END AS BIGINT) AS addr_nums_overlap, -1::BIGINT AS name_legal_state, CAST(substr(pool_id, 1, 2) = 'S2' AS BIGINT) AS cand_is_s2, 0::BIGINT AS cand_has_indic FROM f""")
def pair_features_native(spark, sf_dir):
    """Those of the features that SQL can tell from the records' numbers."""
    names = ["addr_s1_empty", "addr_cand_empty", "addr_both_present", "addr_house_state", "addr_nums_overlap", "name_legal_state", "cand_is_s2", "cand_has_indic"]
    return pair_features(spark, sf_dir).select("s1_id", "pool_id", *(F.col(c).cast("long").alias(c) for c in names))


# -- parsing, learning: no SQL form --------------------------------------------------------------

#: Invented records: an alias, a domain, a post box and a padded number, a state before the end, an Indic script, a department.
_SAMPLES = [
    ("x-1", "Harbor Lane Bakery Inc d/b/a Sunrise Buns", "17 Quarry Street, Dover, DE", "US"), ("x-2", "harborlanebakery.com", "17 QUARRY STREET, DOVER, DE", "US"),
    ("x-3", "The Tin Whistle Company LLC", "000218 WILLOW AVE, PO BOX 77, BOISE, Idaho", "US"), ("x-4", "Lotus Paper Mills Private Limited", "7-3-12/4/B, Karnataka, Mysuru", "India"),
    ("x-5", "లోటస్ పేపర్ మిల్స్ ప్రైవేట్ లిమిటెడ్", "7-3-12/4/B, Mysuru, KA", "India"), ("x-6", "Les Ateliers du Moulin SARL", "3 bis Rue de la Gare, Vendée", "France"),
]


@query()
def name_address_parse(spark, sf_dir):
    """All customers and suppliers, with endings, states and countries dealt to them, and samples of the scripts."""
    shape = "entity_id string, business_name string, business_address string, country string"
    rows = spark.createDataFrame(_SAMPLES, shape)
    deal = lambda values, key: F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))
    for table, at in (("customer", "c"), ("supplier", "s")):
        key, nation = f"{at}_{table[:4]}key", f"{at}_nationkey"
        own = read(spark, sf_dir, table)
        name = F.concat_ws(" ", f"{at}_name", deal(_ENDINGS, key))
        address = F.concat_ws(", ", F.concat_ws(" ", F.col(key).cast("string"), F.lit("Main Road")), deal(_STATES, nation))
        rows = rows.unionByName(own.select(F.concat(F.lit(f"{at}-"), F.col(key).cast("string")).alias("entity_id"), name.alias("business_name"), address.alias("business_address"), deal(["US", "India", "France"], nation).alias("country")))
    return normalize_records(rows)


@query()
def lexicon_learn(spark, sf_dir):
    rows = [(f"Lotus Paper {i}", "12 Lake Road, Warangal, Telangana", f"లోటస్ పేపర్ {i}", "12 Lake Road, Warangal, తెలంగాణ") for i in "abcd"]
    return lexicon.choose(lexicon.alignments(spark.createDataFrame(rows, "name1 string, addr1 string, name2 string, addr2 string")))


@query()
def svd_embedding(spark, sf_dir):
    """Whole documents, with the dimensions and buckets of production."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return embedding.embed(docs, "text", embedding.fit(docs, "text"), "v").select("doc_id", "v")


@query()
def projector_forward(spark, sf_dir):
    """All vectors by a projector trained on the stand-in triplets."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    s1, pool = records(spark, sf_dir)
    found = relational.triplets(links(spark, sf_dir), candidates(spark, sf_dir))
    for role, side in (("s1", s1), ("positive", pool), ("negative", pool)):
        found = found.join(side.select(F.col("id").alias(f"{role}_id"), F.col("name_vec").alias(role)), f"{role}_id")
    # At most as many as any projector is fitted on.
    sample = found.orderBy("s1_id", "positive_id").limit(projector.MOST_TRIPLETS).select("s1", "positive", "negative").toArrow()
    own = projector.train(*(np.array(sample[c].to_pylist(), np.float32) for c in sample.column_names), seed=42)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            v = own.transform(np.array(batch.column("embedding").to_pylist(), np.float32).reshape(batch.num_rows, 64))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(v.tolist(), pa.list_(pa.float32()))], names=["vec_id", "embedding"])

    return rows.mapInArrow(run, "vec_id long, embedding array<float>")


@query()
def gbt_score(spark, sf_dir):
    """A small cross-validated model over the stand-in candidates' retrieval features."""
    columns = ["ret_cos", "ret_cos_name", "ret_cos_addr", "ret_fwd_rank", "ret_rev_rank", "ret_rev_margin", "ret_rev_best"]
    rows = relational.with_labels(candidates(spark, sf_dir), relational.checked_owners(links(spark, sf_dir))).select("s1_id", "pool_id", "label", *columns)
    return model.cross_validate(rows, columns, folds=2, settings=model.Boosting(depth=3, rounds=5))[1].select("s1_id", "pool_id", F.round("prob", 6).alias("prob"))
