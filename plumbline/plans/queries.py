"""Named queries over the tables, each with the SQL that states its result where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import pii, text
from plumbline.operators import contamination, controls, extraction, frequency, order_test, ranks, replicates, sampling, scoring, stats
from plumbline.sources import readers
from plumbline.sources.kept import keep

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Replicates of resampling queries; the operators' callers choose their own.
REPLICATES = 200
SEED = 7


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _r(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return readers.table(spark, sf, name)


def _docs(spark, sf):
    return _table(spark, sf, "documents")


def _analysis(spark, sf) -> DataFrame:
    """One row a labelled document: the inputs of ranks and statistics."""
    d = text.with_word_counts(_docs(spark, sf), ["doc_id", "lang", "source", "n_chars"])
    return keep(d.join(_table(spark, sf, "labels"), "doc_id"), "analysis")


def _arms(spark, sf) -> DataFrame:
    return sampling.split(_docs(spark, sf), SEED, "doc_id")


W = r"list_filter(string_split_regex({t}, '\s+'), lambda x: x <> '')"
WORDS = W.format(t="text")
AN = rf"""an AS (SELECT doc_id, lang, source, n_chars, len(w) AS n_words, CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w) ELSE 0.0 END AS ttr, quality, toxic
  FROM (SELECT *, {WORDS} AS w FROM documents) JOIN labels USING (doc_id))"""
ARMS = "arms AS (SELECT *, CASE WHEN ('0x' || substr(md5('7|' || doc_id), 1, 1))::INT < 8 THEN 1 ELSE 0 END AS member FROM documents)"
HASH = "md5('7|' || doc_id)"


def RANK(c: str, by: str = "", table: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    both = f"{by}, {c}" if by else c
    return f"(rank() OVER ({part}ORDER BY {c}) + (count(*) OVER (PARTITION BY {both}) - 1) / 2.0)"


def CORR(x: str, y: str) -> str:
    return f"CASE WHEN stddev_pop({x}) * stddev_pop({y}) > 0 THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) ELSE 0.0 END"


# Sources


@query("SELECT doc_id, text, quality AS label FROM documents JOIN labels USING (doc_id)")
def s1_labelled_scan(spark, sf):
    return _docs(spark, sf).join(_table(spark, sf, "labels"), "doc_id").select("doc_id", "text", F.col("quality").alias("label"))


@query("SELECT doc_id, text, source AS domain FROM documents")
def s2_corpus_scan(spark, sf):
    return _docs(spark, sf).select("doc_id", "text", F.col("source").alias("domain"))


@query("SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 200")
def s3_bounded_scan(spark, sf):
    return sampling.bounded(_docs(spark, sf), "doc_id", 200).select("doc_id", "text")


@query("SELECT p_partkey, trim(concat_ws(' ', p_name, array_to_string([p_brand, p_type], ' '))) AS text FROM part")
def s5_question_with_choices(spark, sf):
    return _table(spark, sf, "part").select("p_partkey", readers.question_text(F.col("p_name"), F.array("p_brand", "p_type")).alias("text"))


@query("SELECT item_id, trim(text) AS text FROM benchmark")
def s6_prompt_scan(spark, sf):
    return _table(spark, sf, "benchmark").select("item_id", F.trim("text").alias("text"))


@query("SELECT doc_id, i AS line_no, string_split(text, chr(10))[i] AS line FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS t(i) WHERE trim(string_split(text, chr(10))[i]) <> ''")
def s7_line_scan(spark, sf):
    lines = _docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).filter(F.trim("line") != "")
    return lines.select("doc_id", (F.col("p") + 1).cast("long").alias("line_no"), "line")


@query()
def s9_synthetic_items(spark, sf):
    return readers.synthetic_items(spark)


# Sinks' data


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def k3_last_wins_compaction(spark, sf):
    return sampling.last_wins(_table(spark, sf, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id").select("user_id", "event_id", "event_type", "value")


@query(f"""WITH {AN}, e AS (SELECT min(n_chars)::DOUBLE lo, (max(n_chars) - min(n_chars)) / 30.0::DOUBLE AS w FROM an),
b AS (SELECT quality, least(29, floor((n_chars - lo) / w)::INT) AS bin, count(*) AS n, any_value(lo) AS lo, any_value(w) AS w FROM an, e GROUP BY ALL)
SELECT quality, bin, n, round(lo + bin * w, 6) AS low, round(n / (sum(n) OVER (PARTITION BY quality) * w), 12) AS density FROM b""")
def k5_density_by_class(spark, sf):
    return _r(_r(ranks.histogram(_analysis(spark, sf), "n_chars", 30, ["quality"]), "low", digits=6), "density", digits=12)


@query(f"""WITH {AN}, g AS (SELECT n_words AS t, sum(quality) AS p, sum(1 - quality) AS n FROM an GROUP BY 1), c AS (SELECT sum(p) OVER (ORDER BY t DESC) AS tp, sum(n) OVER (ORDER BY t DESC) AS fp FROM g UNION ALL SELECT 0, 0),
s AS (SELECT sum(quality) AS pos, sum(1 - quality) AS neg FROM an) SELECT round(greatest(0.001, fp / neg), 9) AS x, round(max(greatest(0.001, tp / pos)), 9) AS y FROM c, s GROUP BY 1""")
def k5_roc_points(spark, sf):
    return _r(ranks.roc_points(ranks.roc(_analysis(spark, sf), "n_words", "quality"), 1e-3), "x", "y")


@query(f"""WITH {AN}, e AS (SELECT min(n_chars)::DOUBLE lo, max(n_chars)::DOUBLE hi FROM an)
SELECT least(24, floor((n_chars - lo) / ((hi - lo) / 25))::INT) AS bin, count(*) AS n, round(any_value(lo + least(24, floor((n_chars - lo) / ((hi - lo) / 25))::INT) * ((hi - lo) / 25)), 6) AS low FROM an, e GROUP BY 1""")
def m11_score_histogram(spark, sf):
    return _r(ranks.histogram(_analysis(spark, sf), "n_chars", 25).drop("density"), "low", digits=6)


# Projections and filters


@query(f"SELECT doc_id, array_to_string(({WORDS})[1:32], ' ') AS text FROM documents")
def p1_truncate_words(spark, sf):
    return _docs(spark, sf).select("doc_id", text.truncate_words(F.col("text"), 32).alias("text"))


@query(f"SELECT doc_id, least(64, len({WORDS})) AS n_words FROM documents WHERE least(64, len({WORDS})) >= 40")
def p2_minimum_words(spark, sf):
    n = F.size(text.words(text.truncate_words(F.col("text"), 64))).cast("long")
    return _docs(spark, sf).select("doc_id", n.alias("n_words")).filter("n_words >= 40")


@query(f"SELECT doc_id, array_to_string(w[1:15], ' ') AS token_window FROM (SELECT doc_id, {WORDS} AS w FROM documents) WHERE len(w) >= greatest(12, 10 + 1)")
def p3_p4_token_floor_and_window(spark, sf):
    d = _docs(spark, sf).select("doc_id", text.words(F.col("text")).alias("w")).filter(F.size("w") >= max(12, 10 + 1))
    return d.select("doc_id", F.array_join(F.slice("w", 1, 15), " ").alias("token_window"))


@query("SELECT doc_id, n_chars FROM documents WHERE source = 'src1'")
def p5_domain_filter(spark, sf):
    return _docs(spark, sf).filter("source = 'src1'").select("doc_id", "n_chars")


@query("SELECT doc_id FROM documents WHERE length(text) >= 2")
def p6_scorable_rows(spark, sf):
    return _docs(spark, sf).filter(F.size(text.characters(F.col("text"))) >= 2).select("doc_id")


@query(f"SELECT doc_id, array_to_string(w[1:10], ' ') AS prefix, array_to_string(w[11:15], ' ') AS suffix FROM (SELECT doc_id, {WORDS} AS w FROM documents) WHERE len(w) > 10")
def p7_prefix_suffix(spark, sf):
    d = _docs(spark, sf).select("doc_id", text.words(F.col("text")).alias("w")).filter("size(w) > 10")
    prefix, suffix = extraction.split_at(F.col("w"), 10, 5)
    return d.select("doc_id", F.array_join(prefix, " ").alias("prefix"), F.array_join(suffix, " ").alias("suffix"))


@query("SELECT item_id, text FROM benchmark ORDER BY item_id LIMIT 25")
def p9_head_limit(spark, sf):
    return sampling.bounded(_table(spark, sf, "benchmark"), "item_id", 25).select("item_id", "text")


@query(f"SELECT doc_id, len({WORDS}) AS n_words, ({WORDS})[1] AS first_word FROM documents")
def p10_whitespace_words(spark, sf):
    w = text.words(F.col("text"))
    return _docs(spark, sf).select("doc_id", F.size(w).cast("long").alias("n_words"), F.get(w, 0).alias("first_word"))


@query(r"SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}\p{Pc}]+')) AS n_tokens, len(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}\p{Pc}]+'))) AS n_distinct FROM documents")
def p11_word_tokens(spark, sf):
    w = text.word_tokens(F.col("text"))
    return _docs(spark, sf).select("doc_id", F.size(w).cast("long").alias("n_tokens"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"))


# Joins, sets and samples


@query("SELECT doc_id, lang, quality, toxic, n_chars FROM documents JOIN labels USING (doc_id)")
def j1_join_by_id(spark, sf):
    return _docs(spark, sf).join(_table(spark, sf, "labels"), "doc_id").select("doc_id", "lang", "quality", "toxic", "n_chars")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def j2_membership_probe(spark, sf):
    return _docs(spark, sf).join(_table(spark, sf, "labels").filter("toxic = 1"), "doc_id", "left_semi").select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j3_resume_anti_join(spark, sf):
    return sampling.not_done(_docs(spark, sf).select("doc_id"), _table(spark, sf, "labels"), "doc_id")


@query(f"WITH {ARMS} SELECT DISTINCT source FROM arms WHERE member = 1 INTERSECT SELECT source FROM arms WHERE member = 0")
def j5_shared_domains(spark, sf):
    return sampling.shared_domains(_arms(spark, sf), "source")


@query("SELECT doc_id, text, 1 AS label FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, text, 0 FROM documents WHERE lang = 'fr'")
def j6_labelled_union(spark, sf):
    d = _docs(spark, sf)
    return sampling.labelled_union(d.filter("lang = 'en'").select("doc_id", "text"), d.filter("lang = 'fr'").select("doc_id", "text"))


@query(f"WITH {AN} SELECT count(*) AS pairs, sum(CASE WHEN a.ttr < b.ttr THEN 1 ELSE 0 END)::BIGINT AS rising FROM an a JOIN an b ON a.doc_id < b.doc_id AND a.lang = b.lang")
def j8_ordered_pairs(spark, sf):
    out = stats.ordered_pairs(_analysis(spark, sf), "doc_id", "ttr", ["lang"])
    return out.agg(F.sum("pairs").cast("long").alias("pairs"), F.sum("rising").cast("long").alias("rising"))


@query(f"SELECT doc_id FROM documents ORDER BY {HASH}, doc_id LIMIT 100")
def a1_sample(spark, sf):
    return sampling.sample(_docs(spark, sf), 100, SEED, "doc_id").select("doc_id")


@query(f"""WITH {ARMS}, k AS (SELECT source, sum(member) AS m, sum(1 - member) AS n FROM arms GROUP BY source HAVING m > 0 AND n > 0),
q AS (SELECT source, least(greatest(1, floor(200 / (SELECT count(*) FROM k))), m, n) AS q FROM k),
r AS (SELECT doc_id, source, member, row_number() OVER (PARTITION BY source, member ORDER BY {HASH}, doc_id) AS rn FROM arms)
SELECT doc_id, source, member FROM r JOIN q USING (source) WHERE rn <= q""")
def a2_two_arm_sample(spark, sf):
    return sampling.two_arms(_arms(spark, sf).select("doc_id", "source", "member"), "source", 200, SEED, "doc_id").select("doc_id", "source", "member")


@query(f"""WITH r AS (SELECT doc_id, source, {HASH} AS h, row_number() OVER (PARTITION BY source ORDER BY {HASH}, doc_id) AS rn FROM documents)
SELECT doc_id, source FROM r ORDER BY CASE WHEN rn <= 3 THEN 0 ELSE 1 END, h, doc_id LIMIT 150""")
def a3_j4_sample_with_top_up(spark, sf):
    return sampling.with_top_up(_docs(spark, sf).select("doc_id", "source"), "source", 3, 150, SEED, "doc_id").select("doc_id", "source")


_QUOTA = "q AS (SELECT source, count(*) AS quota FROM documents WHERE lang = 'es' GROUP BY source)"


@query(f"""WITH {_QUOTA}, r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {HASH}, doc_id) AS rn FROM documents WHERE lang = 'de')
SELECT doc_id, source FROM r JOIN q USING (source) WHERE rn <= quota""")
def a4_quota_sample(spark, sf):
    d = _docs(spark, sf)
    return sampling.by_quota(d.filter("lang = 'de'").select("doc_id", "source"), sampling.quotas(d.filter("lang = 'es'"), "source"), "source", SEED, "doc_id")[0].select("doc_id", "source")


@query(f"""WITH q AS (SELECT source, count(*) AS quota FROM documents WHERE lang = 'fr' GROUP BY source), h AS (SELECT source, count(*) AS have FROM documents WHERE lang = 'es' GROUP BY source)
SELECT source, quota AS wanted, coalesce(have, 0) AS got FROM q LEFT JOIN h USING (source) WHERE coalesce(have, 0) < quota""")
def a4_quota_shortfall(spark, sf):
    d = _docs(spark, sf)
    return sampling.by_quota(d.filter("lang = 'es'").select("doc_id", "source"), sampling.quotas(d.filter("lang = 'fr'"), "source"), "source", SEED, "doc_id")[1]


@query("SELECT source, count(*) AS quota FROM documents GROUP BY source")
def a5_quotas(spark, sf):
    return sampling.quotas(_docs(spark, sf), "source")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 15")
def a6_pool_by_domain(spark, sf):
    return sampling.ranked(_docs(spark, sf).select("doc_id", "source"), ["source"], ["doc_id"]).filter("rank <= 15").select("doc_id", "source")


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {HASH}, doc_id) AS place FROM benchmark_ids".replace("benchmark_ids", "(SELECT item_id AS doc_id FROM benchmark)"))
def a7_shuffle(spark, sf):
    return sampling.places(_table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id")), SEED, "doc_id")


# Token statistics and detectors


def _model(spark, sf) -> tuple[scoring.BigramModel, DataFrame]:
    arms = _arms(spark, sf)
    return scoring.BigramModel.train(arms.filter("member = 1")), arms


_CHARS = "list_filter(string_split(text, ''), lambda x: x <> '')"
_LM = f"""{ARMS},
pairs AS (SELECT doc_id, i - 1 AS pos, c[i] AS prev, c[i + 1] AS cur FROM (SELECT doc_id, {_CHARS} AS c FROM documents), unnest(range(1, len(c))) AS t(i)),
cnt AS (SELECT prev, cur, count(*) AS c FROM pairs JOIN arms USING (doc_id) WHERE member = 1 GROUP BY ALL),
voc AS (SELECT count(DISTINCT t) AS v FROM (SELECT prev AS t FROM cnt UNION ALL SELECT cur FROM cnt)),
tot AS (SELECT prev, sum(c) AS n, count(*) AS types FROM cnt GROUP BY prev),
seen AS (SELECT prev, cur, n, types, v, ln((c + 0.5::DOUBLE) / (n + 0.5::DOUBLE * v)) AS lp FROM cnt JOIN tot USING (prev), voc),
ctx AS (SELECT prev, ln(0.5::DOUBLE / (n + 0.5::DOUBLE * v)) AS floor, (s + (v - types) * ln(0.5::DOUBLE / (n + 0.5::DOUBLE * v))) / v AS mu,
  sqrt(greatest(0, (ss + (v - types) * ln(0.5::DOUBLE / (n + 0.5::DOUBLE * v)) ^ 2 - v * ((s + (v - types) * ln(0.5::DOUBLE / (n + 0.5::DOUBLE * v))) / v) ^ 2) / (v - 1))) AS sigma
  FROM (SELECT prev, any_value(n)::DOUBLE AS n, any_value(types) AS types, any_value(v) AS v, sum(lp) AS s, sum(lp * lp) AS ss FROM seen GROUP BY prev)),
tok AS (SELECT p.doc_id, p.pos, coalesce(s.lp, c.floor, -ln(voc.v::DOUBLE)) AS lp, coalesce(c.mu, -ln(voc.v::DOUBLE)) AS mu, coalesce(c.sigma, 0) AS sigma
  FROM pairs p LEFT JOIN seen s ON p.prev = s.prev AND p.cur = s.cur LEFT JOIN ctx c ON p.prev = c.prev, voc),
z AS (SELECT doc_id, lp, mu, sigma, (lp - mu) / (sigma + 1e-6) AS z, row_number() OVER (PARTITION BY doc_id ORDER BY lp) AS rl,
  row_number() OVER (PARTITION BY doc_id ORDER BY (lp - mu) / (sigma + 1e-6)) AS rz, count(*) OVER (PARTITION BY doc_id) AS n FROM tok),
score AS (SELECT doc_id, any_value(n) AS n_tokens, avg(lp) AS loss, avg(lp) FILTER (rl <= greatest(1, ceil(20.0 / 100 * n))) AS min_20_prob, avg(lp) FILTER (rl <= greatest(1, ceil(10.0 / 100 * n))) AS min_10_prob,
  avg(z) FILTER (rz <= greatest(1, ceil(20.0 / 100 * n))) AS min_20_plusplus FROM z GROUP BY doc_id)"""


def _scores(spark, sf) -> DataFrame:
    model, arms = _model(spark, sf)
    return model.scores(arms, ("loss", "perplexity", "min_20_prob", "min_20_plusplus"), keep=("member", "source"))


@query(f"WITH {_LM} SELECT doc_id, n_tokens::INT AS n_tokens, round(loss, 6) AS loss, round(-exp(-loss), 5) AS perplexity, round(min_20_prob, 6) AS min_20_prob, round(min_20_plusplus, 5) AS min_20_plusplus FROM score")
def t4_t8_membership_scores(spark, sf):
    s = _scores(spark, sf).select("doc_id", "n_tokens", "loss", "perplexity", "min_20_prob", "min_20_plusplus")
    return _r(_r(s, "loss", "min_20_prob", digits=6), "perplexity", "min_20_plusplus", digits=5)


@query(f"WITH {_LM} SELECT doc_id, round(any_value(mu_mean), 6) AS mu_mean, round(any_value(sigma_mean), 5) AS sigma_mean FROM (SELECT doc_id, avg(mu) OVER (PARTITION BY doc_id) AS mu_mean, avg(sigma) OVER (PARTITION BY doc_id) AS sigma_mean FROM tok) GROUP BY doc_id")
def t1_token_statistics(spark, sf):
    model, arms = _model(spark, sf)
    s = model.scores(arms, ("mu_mean", "sigma_mean")).select("doc_id", "mu_mean", "sigma_mean")
    return _r(_r(s, "mu_mean", digits=6), "sigma_mean", digits=5)


@query()
def t3_mock_scores(spark, sf):
    items = readers.synthetic_items(spark)
    s = items.withColumn("s", scoring.mock_stats(member_col="label", signal=1.5)).select("item_id", "label", "text", "s.*")
    return scoring.scores(s, scoring.DEFAULT_SUITE, ("item_id", "label"))


@query()
def t9_t10_zlib_scores(spark, sf):
    model, arms = _model(spark, sf)
    # Bits come first: rows that wait for a Python function should not hold their token statistics.
    stat = model.scores(arms.select("doc_id", "text", text.zlib_bits(F.col("text")).alias("bits")), ("loglik",), keep=("bits",))
    return stat.select("doc_id", "bits", (F.col("loglik") / F.greatest(F.lit(1), "bits")).alias("zlib_ratio"))


@query(f"WITH {_LM} SELECT doc_id, count(*)::INT AS n_tokens, round(avg(lp), 6) AS prefix_loss FROM tok WHERE pos < 31 GROUP BY doc_id")
def t14_prefix_only_scores(spark, sf):
    model, arms = _model(spark, sf)
    return _r(model.scores(arms, ("loss",), most=32).withColumnRenamed("loss", "prefix_loss"), "prefix_loss", digits=6)


@query(f"""WITH {_LM}, long AS (UNPIVOT (SELECT doc_id, member, round(loss, 9) AS loss, round(min_20_prob, 9) AS min_20_prob FROM score JOIN arms USING (doc_id)) ON loss, min_20_prob INTO NAME detector VALUE s),
r AS (SELECT *, {RANK('s', 'detector')} AS rk FROM long)
SELECT detector, round((sum(rk) FILTER (member = 1) - count(*) FILTER (member = 1) * (count(*) FILTER (member = 1) + 1) / 2.0) / (count(*) FILTER (member = 1) * count(*) FILTER (member = 0)), 6) AS auc,
  count(*) FILTER (member = 1) AS n_pos, count(*) FILTER (member = 0) AS n_neg FROM r GROUP BY detector""")
def e1_score_report(spark, sf):
    s = _r(_scores(spark, sf), "loss", "min_20_prob")
    long = s.select("doc_id", F.col("member").cast("long").alias("member"), F.expr("stack(2, 'loss', loss, 'min_20_prob', min_20_prob) as (detector, s)"))
    return _r(ranks.report(long, "s", "member", ["detector"]).select("detector", "auc", "n_pos", "n_neg"), "auc", digits=6)


# Contamination


def _grams(n: int, table: str, key: str) -> str:
    return f"(SELECT {key}, array_to_string(w[i : i + {n - 1}], ' ') AS g FROM (SELECT {key}, {WORDS} AS w FROM {table}), unnest(range(1, len(w) - {n - 2})) AS t(i))"


def _overlap(n: int) -> str:
    return f"""(SELECT b.item_id, coalesce(s.score, 0.0) AS score FROM benchmark b LEFT JOIN (SELECT item_id, avg(CASE WHEN c.g IS NOT NULL THEN 1.0 ELSE 0.0 END) AS score
  FROM {_grams(n, 'benchmark', 'item_id')} i LEFT JOIN (SELECT DISTINCT g FROM {_grams(n, 'documents', 'doc_id')}) c ON i.g = c.g GROUP BY item_id) s USING (item_id))"""


@query(f"SELECT doc_id, count(*) AS n_grams, count(DISTINCT g) AS n_distinct FROM {_grams(13, 'documents', 'doc_id')} GROUP BY doc_id")
def n1_ngrams(spark, sf):
    return contamination.gram_counts(_docs(spark, sf), "doc_id", 13)


@query(f"SELECT DISTINCT g AS gram FROM {_grams(13, 'benchmark', 'item_id')}")
def n2_build_index(spark, sf):
    b = _table(spark, sf, "benchmark")
    return contamination.build_index([b.filter("item_id % 2 = 0"), b.filter("item_id % 2 = 1")], 13)


@query(f"SELECT count(DISTINCT g) AS n_grams FROM {_grams(13, 'documents', 'doc_id')}")
def n3_index_size(spark, sf):
    return contamination.index_size(_docs(spark, sf), 13)


@query(f"SELECT item_id, round(score, 9) AS score FROM {_overlap(13)}")
def n4_overlap_score(spark, sf):
    return _r(contamination.overlap(_table(spark, sf, "benchmark"), _docs(spark, sf), 13), "score")


@query(f"SELECT item_id, score > 0.5 AS contaminated FROM {_overlap(8)}")
def n5_contains_overlap(spark, sf):
    return contamination.contains_overlap(contamination.overlap(_table(spark, sf, "benchmark"), _docs(spark, sf), 8), 0.5).select("item_id", "contaminated")


@query("""WITH d AS (SELECT item_id, list_filter(string_split(text, ''), lambda x: x <> '') AS c FROM benchmark)
SELECT item_id, count(DISTINCT c[i] || chr(1) || c[i + 1] || chr(1) || c[i + 2]) AS n_distinct FROM d, unnest(range(1, len(c) - 1)) AS t(i) GROUP BY item_id""")
def n6_character_ngrams(spark, sf):
    g = contamination.grams_of(_table(spark, sf, "benchmark"), "item_id", 3, tokenizer=text.characters, separator="\x01")
    return g.groupBy("item_id").agg(F.count_distinct("gram").alias("n_distinct"))


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT 'benchmark_' || (item_id % 3) AS benchmark, count(*) AS n_items, sum((score > 0)::INT)::BIGINT AS n_flagged, round(avg((score > 0)::INT), 9) AS rate, round(avg(score), 9) AS mean_score, round(max(score), 9) AS max_score, {n} AS n FROM {_overlap(n)} GROUP BY 1" for n in (13, 8)) + ")")
def n7_contamination_matrix(spark, sf):
    items = _table(spark, sf, "benchmark").withColumn("benchmark", F.concat(F.lit("benchmark_"), (F.col("item_id") % 3).cast("string")))
    return _r(contamination.matrix(items, _docs(spark, sf)), "rate", "mean_score", "max_score")


@query(f"""WITH s AS (SELECT score, CASE WHEN item_id % 2 = 0 THEN 1 ELSE 0 END AS member FROM {_overlap(13)})
SELECT round(avg(score) FILTER (member = 1), 9) AS member_mean, round(min(score) FILTER (member = 1), 9) AS member_min, round(max(score) FILTER (member = 1), 9) AS member_max,
 round(avg(score) FILTER (member = 0), 9) AS other_mean, round(min(score) FILTER (member = 0), 9) AS other_min, round(max(score) FILTER (member = 0), 9) AS other_max,
 round(avg(score) FILTER (member = 1) - avg(score) FILTER (member = 0), 9) AS separation, (count(*) FILTER (member = 0 AND score > 0))::BIGINT AS other_flagged FROM s""")
def n8_separation(spark, sf):
    s = contamination.overlap(_table(spark, sf, "benchmark"), _docs(spark, sf), 13).withColumn("member", (1 - F.col("item_id") % 2))
    out = contamination.separation(s)
    return _r(out, *[c for c in out.columns if c != "other_flagged"])


# Order-permutation test

#: Permutations of the queries, as in the reference.
ORDER_PERMUTATIONS = 1000


def _order() -> str:
    """Whole turns, joined by line feeds. An ordering's log-likelihood is the sum over its turns of what they have inside, and over its joints of (last character, line feed, first character)."""
    return f"""{_LM}, lp AS (SELECT prev, cur, lp FROM seen), turn AS (SELECT conv_id, turn, text AS t, list_filter(string_split(text, ''), lambda x: x <> '') AS c FROM conversations),
big AS (SELECT conv_id FROM turn GROUP BY conv_id HAVING count(*) >= 2),
inn AS (SELECT conv_id, sum(coalesce(s.lp, x.floor, -ln(voc.v::DOUBLE))) AS inside FROM (SELECT conv_id, c[i] AS prev, c[i + 1] AS cur FROM turn, unnest(range(1, len(c))) AS u(i)) p LEFT JOIN seen s USING (prev, cur) LEFT JOIN ctx x ON x.prev = p.prev, voc GROUP BY conv_id),
many AS (SELECT conv_id, c[1] AS a, c[len(c)] AS z, r, row_number() OVER (PARTITION BY conv_id, r ORDER BY CASE WHEN r = 0 THEN lpad(turn::VARCHAR, 20, '0') ELSE md5('7|' || r || '|' || conv_id || '|' || turn) END, turn) AS k
  FROM turn JOIN big USING (conv_id), unnest(range(0, {ORDER_PERMUTATIONS} + 1)) AS u(r)),
joint AS (SELECT x.conv_id, x.r, x.z AS prev, y.a AS cur FROM many x JOIN many y ON x.conv_id = y.conv_id AND x.r = y.r AND y.k = x.k + 1),
edge AS (SELECT conv_id, r, prev, chr(10) AS cur FROM joint UNION ALL SELECT conv_id, r, chr(10), cur FROM joint),
ll AS (SELECT e.conv_id, r, round(any_value(inside) + sum(coalesce(s.lp, x.floor, -ln(voc.v::DOUBLE))), 6) AS loglik FROM edge e LEFT JOIN seen s USING (prev, cur) LEFT JOIN ctx x ON x.prev = e.prev JOIN inn ON inn.conv_id = e.conv_id, voc GROUP BY e.conv_id, r),
res AS (SELECT n.conv_id, (1 + sum((n.loglik >= c.loglik)::INT)) / (count(*) + 1) AS p_value, any_value(c.loglik) AS canonical_loglik, avg(n.loglik) AS null_mean, stddev_pop(n.loglik) AS null_std
  FROM ll n JOIN ll c ON n.conv_id = c.conv_id AND c.r = 0 WHERE n.r > 0 GROUP BY n.conv_id)"""


def _order_result(spark, sf) -> DataFrame:
    model, _ = _model(spark, sf)
    turns = _table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return order_test.bigram_permutation_test(turns, model, "conv_id", "turn", permutations=ORDER_PERMUTATIONS, seed=SEED)


@query(f"WITH {_order()} SELECT conv_id, round(p_value, 6) AS p_value, round(canonical_loglik, 4) AS canonical_loglik, round(null_mean, 4) AS null_mean, round(null_std, 4) AS null_std FROM res")
def o1_o3_order_test(spark, sf):
    return _r(_r(_order_result(spark, sf), "p_value", digits=6), "canonical_loglik", "null_mean", "null_std", digits=4)


@query(f"WITH {_order()} SELECT CASE WHEN conv_id % 2 = 0 THEN 'contaminated' ELSE 'control' END AS arm, count(*) AS n_groups, round(avg(p_value), 6) AS mean_p, (count(*) FILTER (p_value < 0.1))::BIGINT AS n_small FROM res GROUP BY 1")
def o4_order_test_by_arm(spark, sf):
    arm = F.when(F.col("conv_id") % 2 == 0, "contaminated").otherwise("control")
    out = _order_result(spark, sf).groupBy(arm.alias("arm")).agg(F.count("*").alias("n_groups"), F.avg("p_value").alias("mean_p"), F.sum((F.col("p_value") < 0.1).cast("long")).alias("n_small"))
    return _r(out, "mean_p", digits=6)


# Extraction


def _extracted(spark, sf) -> DataFrame:
    arms = _arms(spark, sf)
    table = keep(extraction.most_likely_next(arms.filter("member = 1")), "next")
    items = keep(extraction.items(arms, 10, 5, 15, ("doc_id", "source", "member")), "items")
    found = extraction.outcomes(extraction.generate(items, table, 5))
    return keep(found.select("doc_id", "source", "member", "matched_tokens", "extracted", "frac_extracted"), "extracted")


_EX = f"""{ARMS}, w AS (SELECT doc_id, source, member, {WORDS} AS w FROM arms),
nxt AS (SELECT prev, next FROM (SELECT w[i] AS prev, w[i + 1] AS next, count(*) AS n FROM w, unnest(range(1, len(w))) AS t(i) WHERE member = 1 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY prev ORDER BY n DESC, next) = 1),
item AS (SELECT doc_id, source, member, w[10] AS g0, w[11:15] AS suffix FROM w WHERE len(w) >= 15),
gen AS (SELECT item.*, n1.next AS g1, n2.next AS g2, n3.next AS g3, n4.next AS g4, n5.next AS g5 FROM item LEFT JOIN nxt n1 ON n1.prev = g0 LEFT JOIN nxt n2 ON n2.prev = n1.next LEFT JOIN nxt n3 ON n3.prev = n2.next LEFT JOIN nxt n4 ON n4.prev = n3.next LEFT JOIN nxt n5 ON n5.prev = n4.next),
ex AS (SELECT *, CASE WHEN g1 IS DISTINCT FROM suffix[1] THEN 0 WHEN g2 IS DISTINCT FROM suffix[2] THEN 1 WHEN g3 IS DISTINCT FROM suffix[3] THEN 2 WHEN g4 IS DISTINCT FROM suffix[4] THEN 3 WHEN g5 IS DISTINCT FROM suffix[5] THEN 4 ELSE 5 END AS matched_tokens FROM gen)"""


@query(f"WITH {_EX} SELECT doc_id, source, matched_tokens, matched_tokens = 5 AS extracted, round(matched_tokens / 5, 9) AS frac_extracted FROM ex")
def e3_e5_extraction(spark, sf):
    return _r(_extracted(spark, sf).select("doc_id", "source", "matched_tokens", "extracted", "frac_extracted"), "frac_extracted")


@query(f"WITH {_EX} SELECT count(*) AS n_items, round(avg((matched_tokens = 5)::INT), 9) AS rate, round(avg(matched_tokens / 5), 9) AS mean_fraction, round(median(matched_tokens / 5), 9) AS median_fraction FROM ex")
def e4_e6_extraction_summary(spark, sf):
    return _r(extraction.summary(_extracted(spark, sf)), "rate", "mean_fraction", "median_fraction")


@query(f"WITH {_EX} SELECT len(list_filter([0.1, 0.25, 0.5, 0.75, 0.9, 1.0, 1.0001]::DOUBLE[], lambda e: e <= matched_tokens / 5)) AS bucket, count(*) AS n FROM ex GROUP BY 1")
def e6_fraction_histogram(spark, sf):
    return _extracted(spark, sf).groupBy(extraction.fraction_bucket(F.col("frac_extracted")).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


@query(f"WITH {_EX} SELECT member, CASE WHEN matched_tokens <= 2 THEN matched_tokens::VARCHAR WHEN matched_tokens <= 4 THEN '3-4' ELSE '5-9' END AS bucket, count(*) AS n FROM ex GROUP BY ALL")
def m12_matched_histogram(spark, sf):
    return _extracted(spark, sf).groupBy("member", extraction.match_bucket(F.col("matched_tokens")).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"""WITH {_EX}, r AS (SELECT member, matched_tokens, {RANK('matched_tokens')} AS rk FROM ex)
SELECT member, count(*) AS n, (count(*) FILTER (matched_tokens >= 5))::BIGINT AS exact, round(avg(matched_tokens), 9) AS mean_tokens, round(median(matched_tokens), 9) AS median_tokens, round(avg(matched_tokens / 5), 9) AS mean_fraction,
(count(*) FILTER (matched_tokens >= 5))::BIGINT AS at_least_5, (count(*) FILTER (matched_tokens >= 3))::BIGINT AS at_least_3, round(avg(rk), 6) AS mean_rank FROM r GROUP BY member""")
def c17_two_arm_comparison(spark, sf):
    m = F.col("matched_tokens")
    reached = lambda n: F.sum((m >= n).cast("long"))
    out = ranks.average_rank(_extracted(spark, sf), "matched_tokens", "rk").groupBy("member").agg(
        F.count("*").alias("n"), F.sum(F.col("extracted").cast("long")).alias("exact"), F.avg(m).alias("mean_tokens"), F.median(m).alias("median_tokens"), F.avg("frac_extracted").alias("mean_fraction"),
        reached(3).alias("at_least_3"), reached(5).alias("at_least_5"), F.avg("rk").alias("mean_rank"))
    return _r(_r(out, "mean_tokens", "median_tokens", "mean_fraction"), "mean_rank", digits=6)


@query(f"WITH {_EX} SELECT source, count(*) FILTER (member = 1) AS n_members, round(avg(matched_tokens) FILTER (member = 1), 9) AS member_mean, round(avg(matched_tokens) FILTER (member = 0), 9) AS other_mean, round(avg(matched_tokens) FILTER (member = 1) - avg(matched_tokens) FILTER (member = 0), 9) AS delta FROM ex GROUP BY source HAVING count(*) FILTER (member = 1) >= 8 AND count(*) FILTER (member = 0) > 0")
def c17_domain_delta(spark, sf):
    return _r(controls.domain_delta(_extracted(spark, sf), "source", "matched_tokens", "member"), "member_mean", "other_mean", "delta")


@query(f"WITH {_EX}, m AS (SELECT source, count(*) AS n, avg(matched_tokens) AS mean FROM ex WHERE member = 1 GROUP BY source HAVING count(*) >= 8), o AS (SELECT source, avg(matched_tokens) AS mean FROM ex WHERE member = 0 GROUP BY source) SELECT source, n, round(m.mean, 9) AS member_mean, round(coalesce(o.mean, 0), 9) AS other_mean FROM m LEFT JOIN o USING (source)")
def c26_domain_means(spark, sf):
    x = _extracted(spark, sf)
    m = x.filter("member = 1").groupBy("source").agg(F.count("*").alias("n"), F.avg("matched_tokens").alias("member_mean")).filter("n >= 8")
    o = x.filter("member = 0").groupBy("source").agg(F.avg("matched_tokens").alias("other_mean"))
    return _r(m.join(o, "source", "left").withColumn("other_mean", F.coalesce("other_mean", F.lit(0.0))), "member_mean", "other_mean")


# Personal data

_EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
_PHONE = r"(^|[^0-9])(\+?1[\s.\-]?)?(\([0-9]{3}\)|[0-9]{3})[\s.\-][0-9]{3}[\s.\-][0-9]{4}($|[^0-9])"
_SSN = r"(^|[^0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}($|[^0-9])"


def _types(t: str) -> str:
    return f"list_filter([CASE WHEN regexp_matches({t}, '{_EMAIL}') THEN 'email' END, CASE WHEN regexp_matches({t}, '{_PHONE}') THEN 'phone' END, CASE WHEN regexp_matches({t}, '{_SSN}') THEN 'ssn' END], lambda x: x IS NOT NULL)"


@query(f"SELECT doc_id, array_to_string({_types('text')}, ',') AS pii_types FROM documents WHERE len({_types('text')}) > 0")
def i1_i3_pii_types(spark, sf):
    d = _docs(spark, sf).select("doc_id", pii.types(F.col("text")).alias("t")).filter("size(t) > 0")
    return d.select("doc_id", F.array_join("t", ",").alias("pii_types"))


@query()
def i2_pii_spans(spark, sf):
    return _docs(spark, sf).select("doc_id", F.explode(pii.spans(F.col("text"))).alias("s")).select("doc_id", "s.pii_type", "s.start", "s.end")


@query(f"SELECT t AS pii_type, count(*) AS n_docs FROM documents, unnest({_types('text')}) AS u(t) GROUP BY t")
def i5_pii_type_counts(spark, sf):
    return _docs(spark, sf).select(F.explode(pii.types(F.col("text"))).alias("pii_type")).groupBy("pii_type").agg(F.count("*").alias("n_docs"))


#: Words of the prefix that is given, and of the continuation that is generated and compared.
_GIVEN, _CONTINUED = 10, 12
_SSN_VALUE, _PHONE_VALUE = r"(?:^|[^0-9])([0-9]{3}-[0-9]{2}-[0-9]{4})(?:$|[^0-9])", r"(?:^|[^0-9])((?:\+?1[\s.\-]?)?(?:\([0-9]{3}\)|[0-9]{3})[\s.\-][0-9]{3}[\s.\-][0-9]{4})(?:$|[^0-9])"
_VALUES = f"list_concat(regexp_extract_all({{t}}, '{_EMAIL}'), regexp_extract_all({{t}}, '{_SSN_VALUE}', 1), regexp_extract_all({{t}}, '{_PHONE_VALUE}', 1))".replace("{3}", "{{3}}").replace("{2}", "{{2}}").replace("{4}", "{{4}}").replace("{2,}", "{{2,}}")
_GENERATED = " ".join(f"LEFT JOIN nxt n{k} ON n{k}.prev = {'g0' if k == 1 else f'n{k - 1}.next'}" for k in range(1, _CONTINUED + 1))
_LEAK = f"""{ARMS}, w AS (SELECT doc_id, member, {WORDS} AS w FROM arms),
nxt AS (SELECT prev, next FROM (SELECT w[i] AS prev, w[i + 1] AS next, count(*) AS n FROM w, unnest(range(1, len(w))) AS t(i) WHERE member = 1 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY prev ORDER BY n DESC, next) = 1),
item AS (SELECT doc_id, w[{_GIVEN}] AS g0, array_to_string(w[{_GIVEN + 1} : {_GIVEN + _CONTINUED}], ' ') AS suffix FROM w WHERE len(w) > {_GIVEN}),
gen AS (SELECT item.*, concat_ws(' ', {', '.join(f'n{k}.next' for k in range(1, _CONTINUED + 1))}) AS gen FROM item {_GENERATED}),
leak AS (SELECT doc_id, {_types('suffix')} AS types, len({_types('suffix')}) > 0 AS has, len(list_intersect({_VALUES.format(t='suffix')}, {_VALUES.format(t='gen')})) > 0 AS leaked FROM gen)"""


def _leaks(spark, sf) -> DataFrame:
    """Items with the kinds of personal data in their true continuation, and whether the generated one holds one of its values."""
    arms = _arms(spark, sf)
    table = keep(extraction.most_likely_next(arms.filter("member = 1")), "next")
    items = extraction.items(arms, _GIVEN, _CONTINUED, _GIVEN + 1, ("doc_id",)).withColumn("suffix", text.detokenise(F.col("suffix")))
    made = extraction.generate(keep(items.filter(F.size(pii.types(F.col("suffix"))) > 0), "items"), table, _CONTINUED)
    return made.select("doc_id", pii.types(F.col("suffix")).alias("types"), pii.leaked(F.col("suffix"), text.detokenise(F.col("generated"))).alias("leaked"))


@query(f"WITH {_LEAK} SELECT doc_id, array_to_string(types, ',') AS pii_types, leaked FROM leak WHERE has")
def i4_j7_leaks(spark, sf):
    return _leaks(spark, sf).select("doc_id", F.array_join("types", ",").alias("pii_types"), "leaked")


@query(f"WITH {_LEAK} SELECT (count(*) FILTER (has))::BIGINT AS n_with_pii, (count(*) FILTER (has AND leaked))::BIGINT AS n_leaked, round(CASE WHEN count(*) FILTER (has) > 0 THEN count(*) FILTER (has AND leaked) / count(*) FILTER (has) ELSE 0.0 END, 9) AS leak_rate FROM leak")
def i5_leak_rate(spark, sf):
    one = _leaks(spark, sf).agg(F.count("*").alias("n_with_pii"), F.coalesce(F.sum(F.col("leaked").cast("long")), F.lit(0)).alias("n_leaked"))
    return one.select("n_with_pii", "n_leaked", F.round(F.when(F.col("n_with_pii") > 0, F.col("n_leaked") / F.col("n_with_pii")).otherwise(F.lit(0.0)), 9).alias("leak_rate"))


# Features


@query()
def f1_compressibility(spark, sf):
    return _docs(spark, sf).select("doc_id", text.compressibility(F.col("text")).alias("compressibility"))


@query(rf"""SELECT doc_id, round(CASE WHEN len(l) > 0 THEN 1 - len(list_distinct(l)) / len(l) ELSE 0.0 END, 9) AS repeated_lines, round(len(regexp_extract_all(text, '\p{{Nd}}')) / greatest(1, length(text)), 9) AS digit_frac,
 round(len(regexp_extract_all(text, '[^\p{{L}}\p{{N}}\s]')) / greatest(1, length(text)), 9) AS punct_frac, round(len(list_distinct(w)) / greatest(1, len(w)), 9) AS type_token_ratio
FROM (SELECT doc_id, text, list_filter(list_transform(string_split_regex(text, '\r\n|[\n\r\x0b\x0c]'), lambda x: trim(x, chr(32) || chr(9))), lambda x: x <> '') AS l, {WORDS} AS w FROM documents)""")
def f2_f5_text_features(spark, sf):
    t = F.col("text")
    d = _docs(spark, sf).select("doc_id", text.repeated_lines(t).alias("repeated_lines"), text.digit_share(t).alias("digit_frac"), text.punctuation_share(t).alias("punct_frac"), text.type_token_ratio(t).alias("type_token_ratio"))
    return _r(d, "repeated_lines", "digit_frac", "punct_frac", "type_token_ratio")


#: Words, the most frequent ones, that are broadcast to the texts; tokens of others meet their counts in a shuffle.
_FREQUENT = 200_000


def _commonness(df: DataFrame, tokens) -> DataFrame:
    return frequency.commonness(df.select("doc_id", tokens.alias("tokens")), "doc_id", _FREQUENT)


def _common_sql(tokens: str) -> str:
    return f"""WITH t AS (SELECT doc_id, x FROM (SELECT doc_id, unnest({tokens}) AS x FROM documents)), c AS (SELECT x, count(*) AS c FROM t GROUP BY x), a AS (SELECT sum(c) AS a FROM c)
SELECT d.doc_id, round(coalesce(m, 0.0), 6) AS commonness FROM documents d LEFT JOIN (SELECT doc_id, avg(ln(c / a)) AS m FROM t JOIN c USING (x), a GROUP BY doc_id) USING (doc_id)"""


@query(_common_sql(r"regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}\p{Pc}]+')"))
def f6_word_commonness(spark, sf):
    return _r(_commonness(_docs(spark, sf), text.word_tokens(F.col("text"))), "commonness", digits=6)


@query(_common_sql(WORDS))
def f7_frequency_proxy(spark, sf):
    d = _docs(spark, sf)
    return _r(frequency.commonness(text.with_words(d, ["doc_id"]), "doc_id", _FREQUENT, d), "commonness", digits=6)


def _base_features(spark, sf, compressed: bool = False) -> DataFrame:
    t, held = F.col("text"), ["doc_id", "digit_frac", "punct_frac"]
    d = _docs(spark, sf).select("doc_id", "text", text.digit_share(t).alias("digit_frac"), text.punctuation_share(t).alias("punct_frac"))
    return keep(text.with_word_counts(d, held, lines=True, compressed=compressed).drop("n_words").withColumnRenamed("ttr", "type_token_ratio"), "features")


@query()
def f8_feature_table(spark, sf):
    base = _base_features(spark, sf, True).select("doc_id", "compressibility", "repeated_lines", "digit_frac", "punct_frac", "type_token_ratio")
    return base.join(t14_prefix_only_scores(spark, sf), "doc_id").join(f6_word_commonness(spark, sf), "doc_id").join(_extracted(spark, sf).select("doc_id", "member", "matched_tokens"), "doc_id")


# Evaluation metrics


@query(f"WITH {AN} SELECT doc_id, round({RANK('n_words')}, 6) AS rank FROM an")
def m1_average_rank(spark, sf):
    return ranks.average_rank(_analysis(spark, sf), "n_words", "rank").select("doc_id", F.round("rank", 6).alias("rank"))


@query(f"WITH {AN} SELECT count(*) AS n, (count(*) FILTER (quality = 1))::BIGINT AS n_pos, (count(*) FILTER (quality = 0))::BIGINT AS n_neg, bool_and(quality IN (0, 1)) AND n_pos > 0 AND n_neg > 0 AS usable FROM an")
def m2_input_check(spark, sf):
    a = _analysis(spark, sf).agg(F.count("*").alias("n"), F.sum((F.col("quality") == 1).cast("long")).alias("n_pos"), F.sum((F.col("quality") == 0).cast("long")).alias("n_neg"), F.bool_and(F.col("quality").isin(0, 1)).alias("ok"))
    return a.select("n", "n_pos", "n_neg", (F.col("ok") & (F.col("n_pos") > 0) & (F.col("n_neg") > 0)).alias("usable"))


_ROC = f"""{AN}, g AS (SELECT n_words AS t, sum(quality) AS p, sum(1 - quality) AS n FROM an GROUP BY 1), c AS (SELECT t::DOUBLE AS threshold, (sum(p) OVER (ORDER BY t DESC))::BIGINT AS tp, (sum(n) OVER (ORDER BY t DESC))::BIGINT AS fp FROM g
UNION ALL SELECT 'infinity'::DOUBLE, 0, 0), s AS (SELECT sum(quality) AS pos, sum(1 - quality) AS neg FROM an)"""


@query(f"WITH {_ROC} SELECT threshold, tp, fp, round(tp / pos, 9) AS tpr, round(fp / neg, 9) AS fpr FROM c, s")
def m3_roc_curve(spark, sf):
    return _r(ranks.roc(_analysis(spark, sf), "n_words", "quality"), "tpr", "fpr")


@query(f"""WITH {_ROC}, r AS (SELECT quality, {RANK('n_words')} AS rk FROM an)
SELECT round((SELECT (sum(rk) FILTER (quality = 1) - pos * (pos + 1) / 2) / (pos * neg) FROM r), 9) AS auc, round((SELECT max(tp / pos) FROM c WHERE fp / neg <= 0.001 + 1e-12), 9) AS tpr_at_0p1,
round((SELECT max(tp / pos) FROM c WHERE fp / neg <= 0.01 + 1e-12), 9) AS tpr_at_1, pos::BIGINT AS n_pos, neg::BIGINT AS n_neg FROM s""")
def m4_m6_membership_report(spark, sf):
    return _r(ranks.report(_analysis(spark, sf), "n_words", "quality"), "auc", "tpr_at_0p1", "tpr_at_1")


_DRAWS = "('0x' || substr(md5('7|' || {by}r || '|' || j), 1, 8))::BIGINT"


def _resampled_sql(by: str | None, table: str = "an") -> str:
    part, key = (f"PARTITION BY {by} ", f"{by}, ") if by else ("", "")
    draw = _DRAWS.format(by=f"{by} || '|' || " if by else "")
    return f"""ix AS (SELECT *, row_number() OVER ({part}ORDER BY doc_id) - 1 AS i FROM {table}), sz AS (SELECT {key}count(*) AS n FROM ix {'GROUP BY ' + by if by else ''}),
dr AS (SELECT {key}r, {draw} % n AS i FROM sz, unnest(range(0, {REPLICATES})) AS a(r), unnest(range(0, n)) AS b(j)), rs AS (SELECT r, ix.* FROM dr JOIN ix USING ({key}i))"""


@query(f"""WITH {AN}, {_resampled_sql('quality')}, k AS (SELECT r, quality, {RANK('n_words', 'r')} AS rk FROM rs),
a AS (SELECT r, (sum(rk) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2.0) / (count(*) FILTER (quality = 1) * count(*) FILTER (quality = 0)) AS v FROM k GROUP BY r)
SELECT round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM a""")
def m7_stratified_bootstrap_auc(spark, sf):
    a = _analysis(spark, sf).select("doc_id", "quality", "n_words")
    stat = lambda df: ranks.auc(df, "n_words", "quality", ["r"]).withColumnRenamed("auc", "value")
    return _r(stats.bootstrap(a, stat, REPLICATES, SEED, by=["quality"], order="doc_id", measure=replicates.auc("n_words", "quality")), "low", "high", digits=6)


@query(f"""WITH {AN}, r AS (SELECT {RANK('ttr')} AS x, {RANK('n_words')} AS y FROM an) SELECT round({CORR('x', 'y')}, 6) AS rho FROM r""")
def m8_spearman(spark, sf):
    return _r(stats.with_ranks(_analysis(spark, sf), ["ttr", "n_words"]).agg(stats.pearson("r_ttr", "r_n_words").alias("rho")), "rho", digits=6)


def _spearman_by(df: DataFrame, by: list[str], x: str = "ttr", y: str = "n_words") -> DataFrame:
    return stats.with_ranks(df, [x, y], by).groupBy(*by).agg(stats.pearson(f"r_{x}", f"r_{y}").alias("value"))


@query(f"""WITH {AN}, {_resampled_sql(None)}, k AS (SELECT r, {RANK('ttr', 'r')} AS x, {RANK('n_words', 'r')} AS y FROM rs), a AS (SELECT r, {CORR('x', 'y')} AS v FROM k GROUP BY r)
SELECT round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM a""")
def m9_m10_paired_bootstrap(spark, sf):
    a = _analysis(spark, sf).select("doc_id", "ttr", "n_words")
    return _r(stats.bootstrap(a, lambda df: _spearman_by(df, ["r"]), REPLICATES, SEED, order="doc_id", measure=replicates.rank_correlations(["ttr"], "n_words")), "low", "high", digits=6)


# Statistics

_R3 = f"{AN}, r AS (SELECT *, {RANK('ttr')} AS rx, {RANK('n_words')} AS ry, {RANK('n_chars')} AS rz FROM an)"
_C3 = f"c AS (SELECT {CORR('ttr', 'n_words')} AS p, {CORR('ttr', 'n_chars')} AS pxz, {CORR('rx', 'ry')} AS xy, {CORR('rx', 'rz')} AS xz, {CORR('ry', 'rz')} AS yz FROM r)"


@query(f"""WITH {_R3}, {_C3} SELECT round(p, 6) AS pearson, round(xy, 6) AS spearman, round((xy - xz * yz) / sqrt(greatest(0, (1 - xz * xz) * (1 - yz * yz))), 6) AS partial, round((xy - xz * yz) / sqrt(greatest(0, 1 - xz * xz)), 6) AS semipartial,
round(1 / (1 - pxz * pxz), 6) AS vif, round(sqrt((1 + abs(pxz)) / (1 - abs(pxz))), 6) AS condition FROM c""")
def c1_c3_c19_correlations(spark, sf):
    out = stats.correlations(_analysis(spark, sf), "ttr", "n_words", "n_chars")
    return _r(out, *out.columns, digits=6)


@query(f"""WITH {AN}, p AS (SELECT sum(sign(a.ttr - b.ttr) * sign(a.n_words - b.n_words)) AS s, count(*) AS n, sum((a.ttr = b.ttr)::INT) AS tx, sum((a.n_words = b.n_words)::INT) AS ty FROM an a JOIN an b ON a.doc_id < b.doc_id)
SELECT round(s / sqrt((n - tx)::DOUBLE * (n - ty)::DOUBLE), 6) AS tau FROM p""")
def c4_kendall(spark, sf):
    return _r(stats.kendall(_analysis(spark, sf), "doc_id", "ttr", "n_words"), "tau", digits=6)


def _permuted_sql(column: str, source: str, by: str | None = None) -> str:
    part = f"r, {by}" if by else "r"
    join = f"AND a.{by} = b.{by}" if by else ""
    return f"""ix AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM {source}), mr AS (SELECT ix.*, r FROM ix, unnest(range(0, {REPLICATES})) AS u(r)),
pa AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY i) AS at FROM mr), pb AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY md5('7|' || r || '|' || i), i) AS at FROM mr),
pm AS (SELECT a.* EXCLUDE ({column}), b.{column} FROM pa a JOIN pb b ON a.r = b.r AND a.at = b.at {join})"""


@query(f"""WITH {_R3}, {_permuted_sql('ry', 'r')}, o AS (SELECT {CORR('rx', 'ry')} AS v FROM r), n AS (SELECT r, {CORR('rx', 'ry')} AS v FROM pm GROUP BY r)
SELECT round(any_value(o.v), 6) AS observed, round((1 + sum((abs(n.v) >= abs(o.v) - 1e-12)::INT)) / (count(*) + 1), 6) AS p FROM n, o""")
def c6_permutation_spearman(spark, sf):
    a = stats.indexed(stats.with_ranks(_analysis(spark, sf), ["ttr", "n_words"]).select("doc_id", "r_ttr", "r_n_words"), "doc_id")
    value = stats.pearson("r_ttr", "r_n_words").alias("value")
    null = stats.null_of(a, "r_n_words", ["r_ttr"], lambda rows: rows.groupBy("r").agg(value), replicates.correlations(["r_ttr"]), REPLICATES, SEED)
    return _r(stats.p_value(a.agg(value), null, "value"), "observed", "p", digits=6)


_PART = f"({CORR('rx', 'ry')} - {CORR('rx', 'rz')} * {CORR('ry', 'rz')}) / sqrt(greatest(0, (1 - ({CORR('rx', 'rz')}) ^ 2) * (1 - ({CORR('ry', 'rz')}) ^ 2)))".replace("CASE", "(CASE").replace("END", "END)")


@query(f"""WITH {_R3}, {_permuted_sql('ry', 'r')}, o AS (SELECT {_PART} AS v FROM r), n AS (SELECT r, {_PART} AS v FROM pm GROUP BY r)
SELECT round(any_value(o.v), 6) AS observed, round((1 + sum((abs(n.v) >= abs(o.v) - 1e-12)::INT)) / (count(*) + 1), 6) AS p FROM n, o""")
def c5_permutation_partial(spark, sf):
    a = stats.indexed(stats.with_ranks(_analysis(spark, sf), ["ttr", "n_words", "n_chars"]).select("doc_id", "r_ttr", "r_n_words", "r_n_chars"), "doc_id")
    value = stats.partial(stats.pearson("r_ttr", "r_n_words"), stats.pearson("r_ttr", "r_n_chars"), stats.pearson("r_n_words", "r_n_chars")).alias("value")
    null = stats.null_of(a, "r_n_words", ["r_ttr", "r_n_chars"], lambda rows: rows.groupBy("r").agg(value), replicates.correlations(["r_ttr"], "r_n_chars"), REPLICATES, SEED)
    return _r(stats.p_value(a.agg(value), null, "value"), "observed", "p", digits=6)


@query("""WITH t AS (SELECT source, (1 + count(*) FILTER (lang = 'en')) / (1 + count(*))::DOUBLE AS p FROM documents GROUP BY source), r AS (SELECT source, p, row_number() OVER (ORDER BY p, source) AS k, count(*) OVER () AS m FROM t),
q AS (SELECT source, p, least(1, greatest(0, min(p * m / k) OVER (ORDER BY p DESC, source DESC ROWS UNBOUNDED PRECEDING))) AS q FROM r) SELECT source, round(p, 9) AS p, round(q, 9) AS q, q <= 0.6 AS reject FROM q""")
def c7_false_discovery(spark, sf):
    tests = _docs(spark, sf).groupBy("source").agg(((1 + F.sum((F.col("lang") == "en").cast("long"))) / (1 + F.count("*"))).alias("p"))
    return _r(stats.benjamini_hochberg(tests, "p", "source", alpha=0.6), "p", "q")


_BINS = f"""{AN}, rr AS (SELECT *, {RANK('n_chars')} AS rk FROM an), ed AS (SELECT quantile_cont(rk, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM rr),
bn AS (SELECT rr.* EXCLUDE (rk), len(list_filter(e, lambda x: x <= rk)) AS bin FROM rr, ed)"""


@query(f"WITH {_BINS} SELECT doc_id, bin::INT AS bin FROM bn")
def c8_equal_count_bins(spark, sf):
    return stats.bins(_analysis(spark, sf), "n_chars").select("doc_id", "bin")


_STRAT = f"SELECT coalesce(sum(n * rho) / sum(n), 0.0) AS v FROM (SELECT bin, count(*) AS n, {CORR('x', 'y')} AS rho, stddev_pop(x) * stddev_pop(y) AS s FROM (SELECT bin, {RANK('ttr', 'bin')} AS x, {RANK('n_words', 'bin')} AS y FROM bn) GROUP BY bin HAVING count(*) >= 3 AND s > 0)"


@query(f"WITH {_BINS} SELECT round(v, 6) AS rho FROM ({_STRAT})")
def c9_stratified_spearman(spark, sf):
    return _r(stats.stratified_spearman(stats.bins(_analysis(spark, sf), "n_chars"), "ttr", "n_words"), "rho", digits=6)


@query(f"""WITH {_BINS}, kk AS (SELECT doc_id, bin, {RANK('ttr', 'bin')} AS x, {RANK('n_words', 'bin')} AS y FROM bn), {_permuted_sql('y', 'kk', 'bin')},
o AS ({_STRAT}), b AS (SELECT r, bin, count(*) AS n, {CORR('x', 'y')} AS rho FROM pm GROUP BY r, bin HAVING count(*) >= 3 AND stddev_pop(x) * stddev_pop(y) > 0), n AS (SELECT r, sum(n * rho) / sum(n) AS v FROM b GROUP BY r)
SELECT round(any_value(o.v), 6) AS observed, round((1 + sum((abs(n.v) >= abs(o.v) - 1e-12)::INT)) / (count(*) + 1), 6) AS p FROM n, o""")
def c10_stratified_permutation(spark, sf):
    b = stats.bins(_analysis(spark, sf), "n_chars")
    seen = stats.stratified_spearman(b, "ttr", "n_words").withColumnRenamed("rho", "value")
    a = stats.indexed(stats.with_ranks(b, ["ttr", "n_words"], ["bin"]).select("doc_id", "bin", "r_ttr", "r_n_words"), "doc_id")

    def joined(rows):
        many = rows.groupBy("r", "bin").agg(F.count("*").alias("n"), stats.pearson("r_ttr", "r_n_words").alias("rho"), (F.stddev_pop("r_ttr") * F.stddev_pop("r_n_words")).alias("v"))
        return many.filter("n >= 3 and v > 0").groupBy("r").agg((F.sum(F.col("n") * F.col("rho")) / F.sum("n")).alias("value"))

    null = stats.null_of(a, "r_n_words", ["r_ttr"], joined, replicates.stratified("r_ttr", "bin", 3), REPLICATES, SEED, "bin")
    return _r(stats.p_value(seen, null, "value"), "observed", "p", digits=6)


_GS = f"""{AN}, mo AS (SELECT avg(n_words) AS m, stddev_pop(n_words) AS s FROM an), z0 AS (SELECT doc_id, ttr, n_chars::DOUBLE AS nc, (n_words - m) / s AS z FROM an, mo),
z1 AS (SELECT *, z - (SELECT avg(z) FROM z0) AS b1, z * z AS c2, z * z * z AS c3 FROM z0),
z2 AS (SELECT *, c2 - (SELECT avg(c2) FROM z1) - b1 * (SELECT sum((c2 - (SELECT avg(c2) FROM z1)) * b1) / sum(b1 * b1) FROM z1) AS b2 FROM z1),
z3 AS (SELECT *, c3 - (SELECT avg(c3) FROM z2) - b1 * (SELECT sum((c3 - (SELECT avg(c3) FROM z2)) * b1) / sum(b1 * b1) FROM z2) - b2 * (SELECT sum(c3 * b2) / sum(b2 * b2) FROM z2) AS b3 FROM z2),
k AS (SELECT avg(ttr) AS t0, sum(ttr * b1) / sum(b1 * b1) AS t1, sum(ttr * b2) / sum(b2 * b2) AS t2, sum(ttr * b3) / sum(b3 * b3) AS t3, avg(nc) AS n0, sum(nc * b1) / sum(b1 * b1) AS n1, sum(nc * b2) / sum(b2 * b2) AS n2, sum(nc * b3) / sum(b3 * b3) AS n3 FROM z3),
res AS (SELECT doc_id, ttr - t0 - t1 * b1 - t2 * b2 - t3 * b3 AS e1, nc - n0 - n1 * b1 - n2 * b2 - n3 * b3 AS e2 FROM z3, k)"""


def _residuals(spark, sf) -> DataFrame:
    return stats.cubic_residuals(_analysis(spark, sf).select("doc_id", "ttr", "n_chars", "n_words"), ["ttr", "n_chars"], "n_words", ["e1", "e2"])


def _cubic_sql(source: str, ys: dict[str, str], control: str, out: str, by: str = "") -> str:
    """Residuals ``e_<name>`` of each y on a cubic of the control, by orthogonal steps (1, then z, z^2, z^3), inside ``by``."""
    w = f"OVER (PARTITION BY {by})" if by else "OVER ()"
    off = lambda y, k: f"{y} - avg({y}) {w}" + "".join(f" - b{i} * coalesce(sum({y} * b{i}) {w} / nullif(sum(b{i} * b{i}) {w}, 0), 0)" for i in range(1, k))
    return f"""{out}0 AS (SELECT *, ({control} - avg({control}) {w}) / coalesce(nullif(stddev_pop({control}) {w}, 0), 1) AS z FROM {source}), {out}1 AS (SELECT *, {off('z', 1)} AS b1, z * z AS c2, z * z * z AS c3 FROM {out}0),
{out}2 AS (SELECT *, {off('c2', 2)} AS b2 FROM {out}1), {out}3 AS (SELECT *, {off('c3', 3)} AS b3 FROM {out}2), {out} AS (SELECT *, {', '.join(f'{off(y, 4)} AS e_{name}' for name, y in ys.items())} FROM {out}3)"""


@query(f"WITH {_GS} SELECT doc_id, round(e1, 6) AS residual FROM res")
def c11_cubic_residuals(spark, sf):
    return _r(_residuals(spark, sf).select("doc_id", F.col("e1").alias("residual")), "residual", digits=6)


@query(f"WITH {_GS}, r AS (SELECT {RANK('round(e1, 7)')} AS x, {RANK('round(e2, 4)')} AS y FROM res) SELECT round({CORR('x', 'y')}, 5) AS rho FROM r")
def c12_cubic_residual_spearman(spark, sf):
    e = _r(_r(_residuals(spark, sf), "e1", digits=7), "e2", digits=4)
    return _r(stats.with_ranks(e, ["e1", "e2"]).agg(stats.pearson("r_e1", "r_e2").alias("rho")), "rho", digits=5)


_C13 = f"""{AN}, ab AS (SELECT doc_id, ttr, n_chars::DOUBLE AS nc, n_words::DOUBLE AS cw FROM an), {_permuted_sql('nc', 'ab')}, {_cubic_sql('ab', {'x': 'ttr', 'y': 'nc'}, 'cw', 'so')}, {_cubic_sql('pm', {'x': 'ttr', 'y': 'nc'}, 'cw', 'sn', 'r')},
o AS (SELECT {CORR('x', 'y')} AS v FROM (SELECT {RANK('round(e_x, 7)')} AS x, {RANK('round(e_y, 4)')} AS y FROM so)), n AS (SELECT r, {CORR('x', 'y')} AS v FROM (SELECT r, {RANK('round(e_x, 7)', 'r')} AS x, {RANK('round(e_y, 4)', 'r')} AS y FROM sn) GROUP BY r)"""


@query(f"WITH {_C13} SELECT round(any_value(o.v), 5) AS observed, round((1 + sum((abs(n.v) >= abs(o.v) - 1e-12)::INT)) / (count(*) + 1), 6) AS p FROM n, o")
def c13_cubic_residual_permutation(spark, sf):
    """The outcome itself is permuted and its cubic fitted again in every replicate."""
    out = stats.cubic_permutation(_analysis(spark, sf), "ttr", "n_chars", "n_words", REPLICATES, SEED, "doc_id", (7, 4))
    return _r(_r(out, "observed", digits=5), "p", digits=6)


@query(f"WITH {AN} SELECT doc_id, round((n_chars - avg(n_chars) OVER ()) / stddev_pop(n_chars) OVER (), 6) AS z FROM an")
def c14_standardise(spark, sf):
    a = _analysis(spark, sf)
    one = a.agg(F.avg("n_chars").alias("m"), F.stddev_pop("n_chars").alias("s"))
    return _r(a.crossJoin(F.broadcast(one)).select("doc_id", ((F.col("n_chars") - F.col("m")) / F.when(F.col("s") > 0, F.col("s")).otherwise(F.lit(1.0))).alias("z")), "z", digits=6)


@query(f"""WITH {_R3}, c AS (SELECT {CORR('rx', 'rz')} AS a, {CORR('rx', 'ry')} AS dy, {CORR('rz', 'ry')} AS my FROM r), m AS (SELECT a, (my - a * dy) / (1 - a * a) AS b, (dy - a * my) / (1 - a * a) AS direct FROM c)
SELECT round(a, 6) AS a, round(b, 6) AS b, round(direct, 6) AS direct, round(a * b, 6) AS indirect, round(direct + a * b, 6) AS total, round(a * b / (direct + a * b), 5) AS prop_mediated FROM m""")
def c15_rank_mediation(spark, sf):
    out = stats.mediation(_analysis(spark, sf), "ttr", "n_chars", "n_words")
    return _r(_r(out, "a", "b", "direct", "indirect", "total", digits=6), "prop_mediated", digits=5)


@query(f"""WITH {AN}, rr AS (SELECT doc_id, quality, {RANK('n_words')} AS rk FROM an), {_permuted_sql('quality', 'rr')}, o AS (SELECT avg(rk) FILTER (quality = 1) - avg(rk) FILTER (quality = 0) AS v FROM rr),
n AS (SELECT r, avg(rk) FILTER (quality = 1) - avg(rk) FILTER (quality = 0) AS v FROM pm GROUP BY r) SELECT round(any_value(o.v), 5) AS observed, round((1 + sum((n.v >= o.v)::INT)) / (count(*) + 1), 6) AS p FROM n, o""")
def c16_rank_sum_permutation(spark, sf):
    a = stats.indexed(ranks.average_rank(_analysis(spark, sf), "n_words", "rk").select("doc_id", "quality", "rk"), "doc_id")
    value = (F.avg(F.when(F.col("quality") == 1, F.col("rk"))) - F.avg(F.when(F.col("quality") == 0, F.col("rk")))).alias("value")
    null = stats.null_of(a, "quality", ["rk"], lambda rows: rows.groupBy("r").agg(value), replicates.mean_difference("rk"), REPLICATES, SEED)
    return _r(_r(stats.p_value(a.agg(value), null, "value", two_sided=False, tolerance=0.0), "observed", digits=5), "p", digits=6)


@query(f"WITH {AN}, e AS (SELECT quantile_cont(n_words, 1 / 3.0) AS lo, quantile_cont(n_words, 2 / 3.0) AS hi FROM an) SELECT doc_id, n_words FROM an, e WHERE n_words BETWEEN lo - 1e-9 AND hi + 1e-9")
def c20_frequency_matched(spark, sf):
    a = _analysis(spark, sf)
    e = a.agg(F.percentile("n_words", F.lit(1 / 3)).alias("lo"), F.percentile("n_words", F.lit(2 / 3)).alias("hi"))
    return a.crossJoin(F.broadcast(e)).filter((F.col("n_words") >= F.col("lo") - 1e-9) & (F.col("n_words") <= F.col("hi") + 1e-9)).select("doc_id", "n_words")


@query(f"WITH {AN}, r AS (SELECT source, {RANK('ttr', 'source')} AS x, {RANK('n_words', 'source')} AS y FROM an) SELECT source, count(*) AS n, round({CORR('x', 'y')}, 6) AS rho FROM r GROUP BY source HAVING count(*) >= 5")
def c23_domain_spearman(spark, sf):
    r = stats.with_ranks(_analysis(spark, sf), ["ttr", "n_words"], ["source"])
    return _r(r.groupBy("source").agg(F.count("*").alias("n"), stats.pearson("r_ttr", "r_n_words").alias("rho")).filter("n >= 5"), "rho", digits=6)


# Report tables: detectors against the extraction outcome, over members

#: Detectors of the report; those after the first are calibrated against loss.
_DETECTORS = ("loss", "min_20_prob", "min_20_plusplus", "min_10_prob")
_CALIBRATED = _DETECTORS[1:]
#: Scores and features are ranked after rounding to so many digits: equal ones tie on every engine.
_DIGITS = 6


def _outcomes(spark, sf) -> DataFrame:
    """One row a member with an outcome: detectors on its whole text and on its first 32 characters, and what was extracted."""
    model, arms = _model(spark, sf)
    whole = _r(model.scores(arms.filter("member = 1"), _DETECTORS).drop("n_tokens"), *_DETECTORS, digits=_DIGITS)
    prefix = model.scores(arms.filter("member = 1"), _DETECTORS, most=32).drop("n_tokens")
    prefix = _r(prefix, *_DETECTORS, digits=_DIGITS).withColumnsRenamed({d: f"prefix_{d}" for d in _DETECTORS})
    out = _extracted(spark, sf).select("doc_id", F.col("frac_extracted").alias("frac"), F.col("extracted").cast("int").alias("extracted"))
    return keep(whole.join(prefix, "doc_id").join(out, "doc_id"), "outcomes")


_LOWEST = "avg({v}) FILTER ({r} <= greatest(1, ceil({k}.0 / 100 * n)))"
_MEM = f"""{_LM}, {_EX.removeprefix(ARMS + ', ')},
pz AS (SELECT doc_id, lp, (lp - mu) / (sigma + 1e-6) AS z, row_number() OVER (PARTITION BY doc_id ORDER BY lp) AS rl, row_number() OVER (PARTITION BY doc_id ORDER BY (lp - mu) / (sigma + 1e-6)) AS rz, count(*) OVER (PARTITION BY doc_id) AS n FROM tok WHERE pos < 31),
pre AS (SELECT doc_id, avg(lp) AS p_loss, {_LOWEST.format(v='lp', r='rl', k=20)} AS p_20, {_LOWEST.format(v='z', r='rz', k=20)} AS p_pp, {_LOWEST.format(v='lp', r='rl', k=10)} AS p_10 FROM pz GROUP BY doc_id),
mem AS MATERIALIZED (SELECT doc_id, round(loss, 6) AS loss, round(min_20_prob, 6) AS min_20_prob, round(min_20_plusplus, 6) AS min_20_plusplus, round(min_10_prob, 6) AS min_10_prob,
  round(p_loss, 6) AS prefix_loss, round(p_20, 6) AS prefix_min_20_prob, round(p_pp, 6) AS prefix_min_20_plusplus, round(p_10, 6) AS prefix_min_10_prob, matched_tokens / 5 AS frac, (matched_tokens = 5)::INT AS extracted
  FROM ex JOIN score USING (doc_id) JOIN pre USING (doc_id) WHERE member = 1)"""


def _paren(case: str) -> str:
    return f"({case})"


def _partial_sql(x: str, y: str, z: str) -> str:
    a, b, c = (_paren(CORR(*p)) for p in ((x, y), (x, z), (y, z)))
    scale = f"sqrt(greatest(0, (1 - {b} ^ 2) * (1 - {c} ^ 2)))"
    return f"(CASE WHEN {scale} > 0 THEN ({a} - {b} * {c}) / {scale} ELSE 0.0 END)"


def _each(of, detectors=_DETECTORS) -> str:
    return " UNION ALL ".join(f"SELECT '{d}' AS detector, {of(d)}" for d in detectors)


_MEM_DRAWS = f"{_MEM}, {_resampled_sql(None, 'mem')}"
_RANKED = "rr AS MATERIALIZED (SELECT doc_id, " + ", ".join(f"{RANK(c)} AS r_{c}" for c in (*_DETECTORS, "frac", "extracted", *(f"prefix_{d}" for d in _DETECTORS))) + " FROM mem)"
_MEM_NULL = f"{_RANKED}, {_permuted_sql('r_frac', 'rr').replace('ix AS', 'iy AS').replace('FROM ix', 'FROM iy').replace('ix.*', 'iy.*')}"


def _rho_sql(d: str, y: str = "frac") -> str:
    return f"(SELECT {CORR(f'r_{d}', f'r_{y}')} FROM rr)"


def _ends_sql(value: str, columns: dict[str, str]) -> str:
    inner = ", ".join(f"{RANK(c, 'r')} AS {name}" for name, c in columns.items())
    boot = f"(SELECT quantile_cont(v, {{q}}) FROM (SELECT {value} AS v FROM (SELECT r, {inner} FROM rs) GROUP BY r))"
    return f"round({boot.format(q=0.025)}, 6) AS low, round({boot.format(q=0.975)}, 6) AS high"


def _perm_sql(value: str) -> str:
    return f"(SELECT (1 + sum((abs(v) >= abs((SELECT {value} FROM rr)) - 1e-12)::INT)) / (count(*) + 1) FROM (SELECT {value} AS v FROM pm GROUP BY r))"


def _raw_sql(d: str) -> str:
    tau = f"(SELECT s / sqrt((n - tx)::DOUBLE * (n - ty)::DOUBLE) FROM (SELECT sum(sign(a.{d} - b.{d}) * sign(a.frac - b.frac)) AS s, count(*) AS n, sum((a.{d} = b.{d})::INT) AS tx, sum((a.frac = b.frac)::INT) AS ty FROM mem a JOIN mem b ON a.doc_id < b.doc_id))"
    return f"round({_rho_sql(d)}, 6) AS rho, {_ends_sql(CORR('x', 'y'), {'x': d, 'y': 'frac'})}, round({tau}, 6) AS tau, round({_perm_sql(CORR(f'r_{d}', 'r_frac'))}, 6) AS p"


@query(f"WITH {_MEM_DRAWS}, {_MEM_NULL} {_each(_raw_sql)}")
def c21_raw_correlations(spark, sf):
    out = controls.raw_table(_outcomes(spark, sf), list(_DETECTORS), "frac", "doc_id", REPLICATES, SEED)
    return _r(out, "rho", "low", "high", "tau", "p", digits=6)


def _r6_sql(d: str) -> str:
    part = _partial_sql(f"r_{d}", "r_frac", "r_loss")
    a, b, c = (_paren(CORR(*p)) for p in ((f"r_{d}", "r_frac"), (f"r_{d}", "r_loss"), ("r_frac", "r_loss")))
    semi = f"(SELECT CASE WHEN 1 - {b} ^ 2 > 0 THEN ({a} - {b} * {c}) / sqrt(greatest(0, 1 - {b} ^ 2)) ELSE 0.0 END FROM rr)"
    return f"round((SELECT {part} FROM rr), 6) AS partial, {_ends_sql(_partial_sql('x', 'y', 'l'), {'x': d, 'y': 'frac', 'l': 'loss'})}, {_perm_sql(part)} AS p0, round({semi}, 6) AS semipartial"


def _fdr_sql(family: str, name: str = "detector") -> str:
    return f"fam AS ({family}), fk AS (SELECT *, row_number() OVER (ORDER BY p0, {name}) AS k, count(*) OVER () AS m FROM fam), fq AS (SELECT *, least(1, greatest(0, min(p0 * m / k) OVER (ORDER BY p0 DESC, {name} DESC ROWS UNBOUNDED PRECEDING))) AS q0 FROM fk)"


@query(f"WITH {_MEM_DRAWS}, {_MEM_NULL}, {_fdr_sql(_each(_r6_sql, _CALIBRATED))} SELECT detector, partial, low, high, round(p0, 6) AS p, semipartial, round(q0, 6) AS q, q0 <= 0.05 AS reject FROM fq")
def c22_partial_family(spark, sf):
    out = controls.partial_family(_outcomes(spark, sf), list(_CALIBRATED), "frac", "loss", "doc_id", REPLICATES, SEED)
    return _r(out, "partial", "low", "high", "p", "semipartial", "q", digits=6)


def _prefix_sql(d: str) -> str:
    part = "NULL::DOUBLE" if d == "loss" else f"round((SELECT {_partial_sql(f'r_prefix_{d}', 'r_frac', 'r_prefix_loss')} FROM rr), 6)"
    return f"round({_rho_sql(d)}, 6) AS rho_full, round({_rho_sql(f'prefix_{d}')}, 6) AS rho_prefix, round({_rho_sql(f'prefix_{d}')} - {_rho_sql(d)}, 6) AS change, {part} AS partial_given_prefix_loss"


@query(f"WITH {_MEM}, {_RANKED} {_each(_prefix_sql)}")
def c18_prefix_control(spark, sf):
    out = controls.prefix_control(_outcomes(spark, sf), list(_DETECTORS), "frac")
    return _r(out, "rho_full", "rho_prefix", "change", "partial_given_prefix_loss", digits=6)


def _headline_sql(d: str) -> str:
    return f"round({_rho_sql(d)}, 6) AS rho, {_ends_sql(CORR('x', 'y'), {'x': d, 'y': 'frac'})}, round({_rho_sql(d, 'extracted')}, 6) AS rho_extracted"


@query(f"WITH {_MEM_DRAWS}, {_RANKED} SELECT *, NOT (low <= 0 AND high >= 0) AS excludes_zero FROM ({_each(_headline_sql)})")
def c25_headline(spark, sf):
    out = controls.headline(_outcomes(spark, sf), list(_DETECTORS), "frac", "extracted", "doc_id", REPLICATES, SEED)
    return _r(out, "rho", "low", "high", "rho_extracted", digits=6)


def _hard_sql() -> str:
    """For each detector: its cubic residuals over the items, over draws (rs) and over permutations of the outcome (pm), and their rank correlations."""
    ranked = lambda source, by: f"SELECT {by + ', ' if by else ''}{CORR('x', 'y')} AS v FROM (SELECT {by + ', ' if by else ''}{RANK('round(e_x, 6)', by)} AS x, {RANK('round(e_y, 6)', by)} AS y FROM {source}) {'GROUP BY ' + by if by else ''}"
    tables, rows = [], []
    for k, d in enumerate(_CALIBRATED):
        ys = {"x": d, "y": "frac"}
        tables += [_cubic_sql("mem", ys, "loss", f"ho{k}_"), _cubic_sql("rs", ys, "loss", f"hb{k}_", "r"), _cubic_sql("pm", ys, "loss", f"hp{k}_", "r")]
        tables += [f"o{k} AS MATERIALIZED ({ranked(f'ho{k}_', '')})", f"b{k} AS ({ranked(f'hb{k}_', 'r')})", f"n{k} AS ({ranked(f'hp{k}_', 'r')})"]
        p = f"(SELECT (1 + sum((abs(n{k}.v) >= abs(o{k}.v) - 1e-12)::INT)) / (count(*) + 1) FROM n{k}, o{k})"
        rows.append(f"SELECT '{d}' AS detector, (SELECT v FROM o{k}) AS rho, (SELECT quantile_cont(v, 0.025) FROM b{k}) AS low, (SELECT quantile_cont(v, 0.975) FROM b{k}) AS high, {p} AS p0")
    return f"{', '.join(tables)}, {_fdr_sql(' UNION ALL '.join(rows))}"


_HARD_NULL = _permuted_sql("frac", "mem").replace("ix AS", "iy AS").replace("FROM ix", "FROM iy").replace("ix.*", "iy.*")


@query(f"WITH {_MEM_DRAWS}, {_HARD_NULL}, {_hard_sql()} SELECT detector, round(rho, 4) AS rho, round(low, 4) AS low, round(high, 4) AS high, round(p0, 6) AS p, round(q0, 6) AS q, low > 0 AND q0 < 0.05 AS revived FROM fq")
def c24_hardening_decision(spark, sf):
    out = controls.hardening(_outcomes(spark, sf), list(_CALIBRATED), "frac", "loss", "doc_id", REPLICATES, SEED, (6, 6))
    return _r(_r(out, "rho", "low", "high", digits=4), "p", "q", digits=6)


@query(f"""WITH {_EX}, rr AS (SELECT doc_id, member, {RANK('matched_tokens')} AS rk FROM ex), {_permuted_sql('member', 'rr')}, o AS (SELECT avg(rk) FILTER (member = 1) - avg(rk) FILTER (member = 0) AS v FROM rr),
n AS (SELECT r, avg(rk) FILTER (member = 1) - avg(rk) FILTER (member = 0) AS v FROM pm GROUP BY r) SELECT round(any_value(o.v), 5) AS observed, round((1 + sum((n.v >= o.v)::INT)) / (count(*) + 1), 6) AS p FROM n, o""")
def c17_rank_difference(spark, sf):
    out = controls.rank_difference(_extracted(spark, sf), "matched_tokens", "member", "doc_id", REPLICATES, SEED)
    return _r(_r(out, "observed", digits=5), "p", digits=6)


_FEATURES = ("repeated_lines", "digit_frac", "punct_frac", "type_token_ratio", "prefix_loss", "word_commonness")


def _arm_features(spark, sf) -> DataFrame:
    out = _base_features(spark, sf).join(t14_prefix_only_scores(spark, sf).select("doc_id", "prefix_loss"), "doc_id").join(f6_word_commonness(spark, sf).withColumnRenamed("commonness", "word_commonness"), "doc_id")
    return _r(out.join(_extracted(spark, sf).select("doc_id", "member", "matched_tokens"), "doc_id"), *_FEATURES, digits=_DIGITS)


def _reading_sql() -> str:
    feature = rf"""fd AS (SELECT doc_id, round(CASE WHEN len(l) > 0 THEN 1 - len(list_distinct(l)) / len(l) ELSE 0.0 END, 6) AS repeated_lines, round(len(regexp_extract_all(text, '\p{{Nd}}')) / greatest(1, length(text)), 6) AS digit_frac,
 round(len(regexp_extract_all(text, '[^\p{{L}}\p{{N}}\s]')) / greatest(1, length(text)), 6) AS punct_frac, round(len(list_distinct(w)) / greatest(1, len(w)), 6) AS type_token_ratio
FROM (SELECT doc_id, text, list_filter(list_transform(string_split_regex(text, '\r\n|[\n\r\x0b\x0c]'), lambda x: trim(x, chr(32) || chr(9))), lambda x: x <> '') AS l, {WORDS} AS w FROM documents)),
ct AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}\p{{M}}\p{{Pc}}]+')) AS x FROM documents), cc AS (SELECT x, count(*) AS c FROM ct GROUP BY x), ca AS (SELECT sum(c) AS a FROM cc),
cm AS (SELECT doc_id, round(coalesce(m, 0.0), 6) AS word_commonness FROM documents LEFT JOIN (SELECT doc_id, avg(ln(c / a)) AS m FROM ct JOIN cc USING (x), ca GROUP BY doc_id) USING (doc_id)),
pl AS (SELECT doc_id, round(avg(lp), 6) AS prefix_loss FROM tok WHERE pos < 31 GROUP BY doc_id),
ft AS MATERIALIZED (SELECT doc_id, member, matched_tokens, {', '.join(_FEATURES)} FROM ex JOIN fd USING (doc_id) JOIN cm USING (doc_id) JOIN pl USING (doc_id)),
rr AS MATERIALIZED (SELECT doc_id, member, {', '.join(f"{RANK(f, 'member')} AS r_{f}" for f in _FEATURES)}, {RANK('matched_tokens', 'member')} AS ry FROM ft), {_permuted_sql('ry', 'rr', 'member')}"""
    arm = lambda f, k: f"(SELECT round({CORR(f'r_{f}', 'ry')}, 12) FROM rr WHERE member = {k})"
    p = lambda f, k: f"(SELECT (1 + sum((abs(v) >= abs({arm(f, k)}))::INT)) / (count(*) + 1) FROM (SELECT round({CORR(f'r_{f}', 'ry')}, 12) AS v FROM pm WHERE member = {k} GROUP BY r))"
    rows = " UNION ALL ".join(f"SELECT '{f}' AS feature, {arm(f, 1)} AS mr, {p(f, 1)} AS mp, {arm(f, 0)} AS nr, {p(f, 0)} AS np" for f in _FEATURES)
    reading = " ".join(f"WHEN {'' if m else 'NOT '}(mp < 0.05) AND {'' if o else 'NOT '}(np < 0.05) THEN '{said}'" for (m, o), said in controls.READINGS.items())
    return f"WITH {_LM}, {_EX.removeprefix(ARMS + ', ')}, {feature} SELECT feature, round(mr, 6) AS members_rho, round(mp, 6) AS members_p, round(nr, 6) AS others_rho, round(np, 6) AS others_p, CASE {reading} END AS reading FROM ({rows})"


@query(_reading_sql())
def f9_c6b_two_arm_reading(spark, sf):
    out = controls.two_arm_reading(_arm_features(spark, sf), list(_FEATURES), "matched_tokens", "member", "doc_id", REPLICATES, SEED)
    return _r(out, "members_rho", "members_p", "others_rho", "others_p", digits=6)
