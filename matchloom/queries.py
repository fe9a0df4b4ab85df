"""Every operator over the driver's tables.

documents are the records (doc_id the id, lang the country, the whole text the name); those whose id is divisible by 3 are
queries, all others the pool, so every row has a part. embeddings are vectors with label as the country. Distinct part names
that share a word or their first letter are the string pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions import similarity as S
from matchloom.functions import text as T
from matchloom.operators import blocking, cache, evaluation, features, modeling, quality, ranking, training
from matchloom.plans import pipelines
from matchloom.sources import scratch, tables
from matchloom.streaming import ownership

CAP, TOP = 40, 10
GRID = evaluation.grid(0.05, 0.95, 0.01)


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents over as many tasks as there are cores. A table of fewer partitions than that is small, so dealing its rows
    out anew costs little; larger ones stay as they are scanned."""
    df = _t(spark, sf, "documents")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores, "doc_id") if df.rdd.getNumPartitions() < cores else df


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select(F.col("doc_id").alias("id"), F.col("lang").alias("country"), T.clean_lexical(F.col("text")).alias("name"))


def _sides(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where("id % 3 = 0"), df.where("id % 3 <> 0")


def _tokens(df: DataFrame) -> DataFrame:
    return blocking.exploded(df, "id", "country", T.tokens(F.col("name")))


def entity_clean_rules(spark, sf):
    return _documents(spark, sf).select("doc_id", T.clean_text(F.col("text")).alias("clean"))


def entity_clean_lexical(spark, sf):
    clean = T.clean_lexical(F.col("text"))
    return _documents(spark, sf).select("doc_id", clean.alias("clean")).select("doc_id", "clean", T.skeleton(F.col("clean")).alias("skeleton"), F.size(T.tokens(F.col("clean"))).cast("long").alias("n_tokens"))


def extract_pin_house_state(spark, sf):
    df = _documents(spark, sf).select("doc_id", T.ascii_only(F.col("text")).alias("raw"), T.clean_lexical(F.col("text")).alias("clean"))
    return df.select("doc_id", T.pin_code(F.col("raw")).alias("pin"), T.first_number(F.col("raw")).alias("number"), T.house_number(F.col("clean")).alias("house"), T.pin_code(F.col("clean")).alias("clean_pin"), T.state_phrase(F.col("clean")).alias("state"))


def record_text(spark, sf):
    c = F.col
    return _t(spark, sf, "part").select("p_partkey", T.entity_string(c("p_name"), c("p_type"), c("p_brand")).alias("entity"), T.labelled_text(c("p_name"), c("p_type"), F.lit(None).cast("string"), F.lit(""), c("p_brand")).alias("labelled"), T.encoder_text("query", T.clean_lexical(c("p_name")), T.clean_lexical(c("p_type")), T.clean_lexical(c("p_brand")), T.skeleton(T.clean_lexical(c("p_name"))), F.lit(""), T.pin_code(c("p_type"))).alias("encoder"))


def null_token_clean(spark, sf):
    value = F.when(F.expr("doc_id % 7 = 0"), " NaN ").when(F.expr("doc_id % 11 = 0"), None).when(F.expr("doc_id % 13 = 0"), "None").otherwise(F.col("text"))
    df = _t(spark, sf, "documents").select("doc_id", value.alias("v"), "source")
    return df.select("doc_id", T.without_null_words(F.col("v")).alias("value"), T.raw_text(F.col("v")).alias("raw"), T.first_filled(F.col("v"), F.col("source")).alias("filled"))


def pool_union(spark, sf):
    s2 = _t(spark, sf, "customer").select(F.concat(F.lit("S2-"), "c_custkey").alias("entity_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    s3 = _t(spark, sf, "supplier").select(F.concat(F.lit("S3-"), "s_suppkey").alias("entity_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return s2.unionByName(s3).withColumn("is_s2", T.from_source(F.col("entity_id"), 2))


def token_df_cap(spark, sf):
    return blocking.frequencies(_tokens(_records(spark, sf))).where(F.col("df") <= CAP)


def _blocked(spark, sf) -> DataFrame:
    q, p = _sides(_records(spark, sf))
    return blocking.block_pairs(_tokens(q), _tokens(p), CAP)


def block_token(spark, sf):
    return _blocked(spark, sf)


def block_house(spark, sf):
    df = _records(spark, sf).select("id", "country", T.house_number(F.col("name")).alias("token")).where("token <> ''")
    q, p = _sides(df)
    return blocking.block_pairs(q, p, CAP).select("query", "candidate")


def block_prefix_fallback(spark, sf):
    q, p = _sides(_records(spark, sf))
    return blocking.prefix_fallback(q, p, blocking.block_pairs(_tokens(q), _tokens(p), 2), CAP)


def block_topk_shared_tokens(spark, sf):
    """The flagship: clean, tokens, frequency cap, token join, shared count, top k, lists for every query."""
    q, p = _sides(_records(spark, sf))
    sizes = lambda d, k, n: d.select(F.col("id").alias(k), F.size(F.array_distinct(T.tokens(F.col("name")))).alias(n))
    pairs = _blocked(spark, sf)
    best = blocking.top_k(pairs, TOP, F.desc("shared"), F.asc("candidate"))
    lists = ranking.listed(q.select(F.col("id").alias("query")), best, [F.col("rank")], "candidates")
    return lists.join(sizes(q, "query", "n_tokens"), "query").select("query", F.col("n_tokens").cast("long").alias("n_tokens"), "candidates")


def block_union(spark, sf):
    """Pairs that either kind of block finds, each once."""
    return _blocked(spark, sf).select("query", "candidate").unionByName(block_house(spark, sf)).distinct()


def lexical_candidates(spark, sf):
    """The whole lexical stage over parts as records: brand the country, size and type the address."""
    p = F.col
    n = _t(spark, sf, "part").select(p("p_partkey").alias("id"), p("p_name").alias("business_name"), F.concat_ws(" ", p("p_size").cast("string"), "p_type").alias("business_address"), p("p_brand").alias("country"))
    q, pool = _sides(tables.enrich(n))
    return pipelines.lexical_candidates(q, pool, pipelines.Settings(top_k=TOP, cap=CAP)).select("query", "candidate", "score", "rank")


def pair_attributes(spark, sf):
    """Both records' fields beside each pair; missing ones are empty."""
    c = _t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("kind"))
    p = _t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 9, F.col("p_name")).alias("name"), F.col("p_type").alias("kind"))
    return features.with_fields(_orders(spark, sf), c, p)


def block_state_compat(spark, sf):
    state = _records(spark, sf).select("id", T.state_phrase(F.col("name")).alias("state"))
    pairs = _blocked(spark, sf).join(state.toDF("query", "qs"), "query").join(state.toDF("candidate", "cs"), "candidate")
    return pairs.where(blocking.compatible(F.col("qs"), F.col("cs"))).select("query", "candidate")


def _vectors(spark, sf) -> DataFrame:
    return _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def knn_partitioned(spark, sf):
    v = _vectors(spark, sf)
    return blocking.nearest_blocked(v, v, TOP, "label").select("query", "candidate", "sim", "rank")


def knn_global(spark, sf):
    v = _vectors(spark, sf)
    return blocking.nearest_blocked(v, v, TOP).select("query", "candidate", "sim", "rank")


def rank_gap_features(spark, sf):
    return ranking.rank_and_gaps(knn_partitioned(spark, sf).drop("rank"))


def cascade_prune(spark, sf):
    pairs = knn_partitioned(spark, sf).select("query", "candidate", F.round(F.col("sim") * 2 - 1, 6).alias("retrieval"), F.expr("(query + candidate) % 10 / 10.0D").alias("jaccard"), F.expr("query * candidate % 10 / 10.0D").alias("sort_ratio"), F.col("rank").alias("position"))
    a = blocking.cascade(pairs, 4, legacy_scale=True).select("query", "candidate", F.col("score").alias("legacy"), F.col("rank").alias("legacy_rank"))
    b = blocking.cascade(pairs, 4).select("query", "candidate", "score", "rank")
    return a.join(b, ["query", "candidate"], "full").fillna({"legacy": -1.0, "score": -1.0, "legacy_rank": 0, "rank": 0})


def _names(spark, sf) -> DataFrame:
    """Pairs of distinct part names that share a word, or their first letter; of words and letters that at most 64 names have."""
    n = _t(spark, sf, "part").select("p_name").distinct()
    keys = F.array_union(F.split("p_name", " "), F.array(F.concat(F.lit("^"), F.substring("p_name", 1, 1))))
    k = n.select(F.lit("").alias("country"), F.explode(F.array_distinct(keys)).alias("token"), F.col("p_name").alias("id"))
    return blocking.block_pairs(k, k, 64).select(F.col("query").alias("a"), F.col("candidate").alias("b"))


def _sim(f):
    return lambda spark, sf: _names(spark, sf).select("a", "b", F.round(f(F.col("a"), F.col("b")), 6).alias("value"))


sim_token_jaccard, sim_ngram_jaccard, sim_regex_jaccard = _sim(S.token_jaccard), _sim(S.ngram_jaccard), _sim(S.regex_jaccard)
sim_jaro_winkler_gated, sim_jaro_winkler_classic = _sim(S.jaro_winkler_gated_column), _sim(S.jaro_winkler_column)
sim_indel_ratio, sim_token_set, sim_token_sort, sim_partial = _sim(S.ratio_column), _sim(S.token_set_column), _sim(S.token_sort_column), _sim(S.partial_column)


def sim_tristate(spark, sf):
    a, b = F.when(F.length("a") % 3 == 0, "").otherwise(F.col("a")), F.col("b")
    return _names(spark, sf).select("a", "b", S.tri_state(a, b).alias("tri"), S.both_equal(a, b).alias("same"), S.any_empty(a, b).alias("empty"))


def sim_len_ratio(spark, sf):
    return _names(spark, sf).select("a", "b", F.round(S.length_ratio(F.col("a"), F.col("b")), 6).alias("value"))


def sim_cosine(spark, sf):
    """Of each vector to its label's mean vector."""
    v = _vectors(spark, sf)
    mean = v.select("label", F.posexplode("vector")).groupBy("label", "pos").agg(F.avg(F.col("col").cast("double")).alias("m"))
    mean = mean.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("x")).select("label", F.col("x.m").alias("mean"))
    return v.join(mean, "label").select("id", F.round(S.cosine(F.col("vector"), F.col("mean")), 6).alias("value"))


def _fielded(spark, sf) -> DataFrame:
    n = _names(spark, sf)
    side = lambda c, p: [F.col(c).alias(f"{p}_name"), F.reverse(F.col(c)).alias(f"{p}_address"), F.regexp_extract(c, "^(.)", 1).alias(f"{p}_pin"), F.substring(c, 2, 1).alias(f"{p}_house"), T.skeleton(F.col(c)).alias(f"{p}_skeleton"), (F.length(c) % 2).alias(f"{p}_source")]
    sim = F.round(S.ngram_jaccard(F.col("a"), F.col("b")), 6)
    return n.select(F.col("a").alias("query"), F.col("b").alias("candidate"), *side("a", "left"), *side("b", "right"), sim.alias("sim"), sim.alias("cosine"))


def pair_features_8(spark, sf):
    return features.features_8(_fielded(spark, sf))


def pair_features_11(spark, sf):
    return features.features_11(_fielded(spark, sf).drop("cosine"))


def pair_features_12(spark, sf):
    return features.features_12(_fielded(spark, sf))


def pair_features_19(spark, sf):
    return features.features_19(_fielded(spark, sf))


def context_features(spark, sf):
    return features.with_context(_fielded(spark, sf).select("query", "candidate", F.col("sim").alias("prob")))


def _truth(spark, sf) -> DataFrame:
    """(query, candidate) with the same country and clean text."""
    q, p = _sides(_records(spark, sf).withColumn("key", F.sha2("name", 256)))
    return q.select("country", "key", F.col("id").alias("query")).join(p.select("country", "key", F.col("id").alias("candidate")), ["country", "key"]).select("query", "candidate")


def label_pairs(spark, sf):
    return evaluation.label_pairs(_blocked(spark, sf), _truth(spark, sf)).select("query", "candidate", "label")


def blocking_recall(spark, sf):
    return evaluation.blocking_recall(_blocked(spark, sf), _truth(spark, sf))


def _scored(spark, sf) -> DataFrame:
    """Sources as queries, their labelled documents as candidates, a probability that leans on the label."""
    d = _t(spark, sf, "documents").join(_t(spark, sf, "labels"), "doc_id")
    return d.select(F.col("source").alias("query"), F.col("doc_id").alias("candidate"), F.expr("(doc_id * 37 % 71 + 30 * quality) / 100.0D").alias("prob"), F.col("quality").alias("label"))


def _true_counts(spark, sf) -> DataFrame:
    s = _t(spark, sf, "documents").select(F.col("source").alias("query")).distinct()
    n = _scored(spark, sf).where("label = 1").groupBy("query").agg(F.count("*").alias("n_true"))
    return s.join(n, "query", "left").select("query", F.coalesce("n_true", F.lit(0)).alias("n_true"))


def macro_f05(spark, sf):
    s = _scored(spark, sf)
    return evaluation.macro_f_beta(_true_counts(spark, sf), ranking.decide_threshold(s, 0.5), s.where("label = 1"))


def f05_threshold_sweep(spark, sf):
    return evaluation.sweep(_scored(spark, sf), _true_counts(spark, sf), GRID)


def best_threshold(spark, sf):
    return evaluation.best_threshold(f05_threshold_sweep(spark, sf))


def _orders(spark, sf) -> DataFrame:
    """Order lines as scored pairs: customers want parts."""
    o = _t(spark, sf, "orders").join(_t(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    pairs = o.groupBy(F.col("o_custkey").alias("query"), F.col("l_partkey").alias("candidate")).agg(F.count("*").alias("lines"))
    return pairs.select("query", "candidate", F.expr("(query * 31 + candidate * 17) % 101 / 100.0D").alias("prob"))


def decide_threshold(spark, sf):
    return ranking.decide_threshold(_orders(spark, sf), 0.8)


def decide_ownership(spark, sf):
    return ranking.decide_ownership(_orders(spark, sf), 0.8)


def match_lists(spark, sf):
    q = _t(spark, sf, "customer").select(F.col("c_custkey").alias("query"))
    return ranking.listed(q, decide_ownership(spark, sf), [(-F.col("prob")).alias("p")])


def candidate_lists(spark, sf):
    v = _vectors(spark, sf).select(F.col("id").alias("query"))
    return ranking.listed(v, knn_partitioned(spark, sf), [F.col("rank")], "candidates")


def validator_issues(spark, sf):
    """Lists made from orders with every kind of mistake among them."""
    o = _t(spark, sf, "orders")
    member = F.when(F.expr("o_orderkey % 50 = 0"), F.concat(F.lit("S2-"), "o_custkey", F.lit(",S2-"), "o_custkey")).when(F.expr("o_orderkey % 51 = 0"), F.concat(F.lit("S1-"), "o_custkey")).when(F.expr("o_orderkey % 52 = 0"), F.concat(F.lit("S2-"), "o_custkey", F.lit(",,S3-1"))).when(F.expr("o_orderkey % 53 = 0"), "").otherwise(F.concat(F.lit("S3-"), "o_custkey"))
    lists = o.select(F.col("o_orderkey").alias("row"), F.concat(F.lit("S1-"), F.expr("o_orderkey - o_orderkey % 2")).alias("id"), member.alias("members"))
    required = o.select(F.concat(F.lit("S1-"), F.expr("o_orderkey + 2")).alias("id"))
    valid = _t(spark, sf, "customer").where("c_custkey % 10 <> 3").select(F.explode(F.array(F.concat(F.lit("S2-"), "c_custkey"), F.concat(F.lit("S3-"), "c_custkey"))).alias("id"))
    return quality.issues(lists, required, valid)


def matches_outside_candidates(spark, sf):
    return quality.outside_candidates(_orders(spark, sf).where("prob >= 0.5"), _orders(spark, sf).where("prob >= 0.6"))


def audit_profile(spark, sf):
    d = _t(spark, sf, "documents").withColumn("text", F.when(F.expr("doc_id % 9 = 0"), " ").otherwise(F.col("text")))
    return quality.profile(d, ["doc_id", "text", "lang", "source"])


def _customer_lists(spark, sf) -> DataFrame:
    o = _t(spark, sf, "orders")
    lists = o.groupBy("o_custkey").agg(F.collect_list(F.concat(F.when(F.expr("o_orderkey % 2 = 0"), "S2-").otherwise("S3-"), F.col("o_orderkey").cast("string"))).alias("members"))
    c = _t(spark, sf, "customer")
    return c.join(lists, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("query"), F.coalesce("members", F.array().cast("array<string>")).alias("members"))


def gt_summary(spark, sf):
    return quality.truth_summary(_customer_lists(spark, sf))


def gt_size_histogram(spark, sf):
    return quality.size_histogram(_customer_lists(spark, sf))


def country_distribution(spark, sf):
    return quality.distribution(_t(spark, sf, "documents"), "lang")


def dedupe_encode_join(spark, sf):
    return cache.once_per_value(_documents(spark, sf).select("doc_id", "text"), "text", "code", lambda c: F.sha2(T.clean_lexical(c), 256)).select("doc_id", "code")


def embedding_cache_join(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", "text")
    kept = d.where("doc_id % 4 <> 0").select(F.col("doc_id").alias("id"), F.sha2(F.when(F.expr("doc_id % 6 = 1"), "old").otherwise(F.col("text")), 256).alias("content"))
    return cache.missing_from(d, kept, "doc_id", "text").select("doc_id", "content")


def encoded_records(spark, sf):
    v = cache.encoded(_documents(spark, sf), "doc_id", "text", cache.hashing_encoder())
    return v.select("id", F.round(S.norm(F.col("vector")), 6).alias("norm"))


def train_positives(spark, sf):
    q, p = _sides(_records(spark, sf))
    return training.positives(_truth(spark, sf), q, p)


def train_text_pairs(spark, sf):
    d = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.when(F.expr("doc_id % 9 = 0"), " ").otherwise(F.col("source")).alias("text"))
    return training.text_pairs(_truth(spark, sf).distinct(), *_sides(d))


def train_triplets(spark, sf):
    _, p = _sides(_records(spark, sf).select("id", "country"))
    return training.triplets(_blocked(spark, sf).select("query", "candidate"), p)


def holdout_split(spark, sf):
    return training.holdout(_t(spark, sf, "documents").select("doc_id"), "doc_id")


def sample_rows(spark, sf):
    return training.sample(_t(spark, sf, "orders").select("o_orderkey"), 250, "o_orderkey")


def split_loader(spark, sf):
    """Row counts of a proportional split by loaders' limits."""
    q, p = _sides(_records(spark, sf).select("id"))
    parts = tables.split_sizes(q, p, _truth(spark, sf), 20, 5)
    out = [x.agg(F.count("*").alias("n")).withColumn("part", F.lit(k)) for k, x in zip(("queries", "pool", "truth"), parts, strict=True)]
    return out[0].unionByName(out[1]).unionByName(out[2]).select("part", "n")


def dummy_subset(spark, sf):
    q, p = _sides(_records(spark, sf).select("id"))
    return training.subset(q, p, _truth(spark, sf), 50, 100)[1]


def row_numbers(spark, sf):
    return tables.numbered(_t(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey").select("o_orderkey", "position")


def _ml(spark, sf) -> DataFrame:
    """Feature rows with labels, written once, as each fit and the scoring read them."""
    f = pair_features_8(spark, sf)
    label = ((F.substring("query", 1, 3) == F.substring("candidate", 1, 3)) | (F.col("addr_grams") > 0.4)).cast("int")
    f = f.withColumn("label", label).withColumn("split", F.pmod(F.xxhash64("query"), F.lit(4)).cast("int"))
    path = scratch.folder(spark, "features")
    f.write.parquet(path)
    return spark.read.schema(f.schema).parquet(path)


_ML = ["name_tokens", "name_jw", "pin", "is_s2"]


def gbt_rerank(spark, sf):
    """Queries in three parts: those the trees are fitted on, those that stop them, and those that a threshold may be chosen on."""
    d = _ml(spark, sf).withColumn("part", F.when(F.col("split") == 0, "stop").when(F.col("split") == 1, "tune").otherwise("fit"))
    seen = d.where("part <> 'tune'").withColumn("valid", F.col("part") == "stop")
    model = modeling.fit_reranker(seen, _ML, iterations=8, subsample=0.85, features="0.85", validation="valid")
    return model.transform(d).select("query", "candidate", "part", "label", F.round("prob", 4).alias("prob"))


def two_stage_stack(spark, sf):
    d = modeling.out_of_fold(_ml(spark, sf), _ML, "split", 4, iterations=3)
    d = features.with_context(d.drop("relative_rank", "best_gap", "support"))
    model = modeling.fit_reranker(d.withColumnRenamed("prob", "stage1"), [*_ML, "stage1", "relative_rank", "best_gap", "support"], iterations=3)
    return model.transform(d.withColumnRenamed("prob", "stage1")).select("query", "candidate", F.round("stage1", 4).alias("stage1"), F.round("prob", 4).alias("prob"))


def isotonic_calibrate(spark, sf):
    s = _scored(spark, sf)
    return modeling.calibrated(modeling.fit_calibration(s), s).select("candidate", "prob", F.round("calibrated", 6).alias("calibrated"))


def _told(c: str, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.col(c).cast("string")).alias(c)


def decide_ownership_ids(spark, sf):
    """Ownership over string ids."""
    return ranking.decide_ownership(_orders(spark, sf).select(_told("query", "S1-"), _told("candidate", "S2-"), "prob"), 0.8)


def holdout_split_ids(spark, sf):
    return training.holdout(_t(spark, sf, "documents").select(_told("doc_id", "S1-")), "doc_id")


def train_triplets_ids(spark, sf):
    """Over string ids; single records of a country get a negative from the country en."""
    p = _sides(_records(spark, sf).select("id", "country"))[1].select(_told("id", "S2-"), "country")
    pairs = _truth(spark, sf).select(_told("query", "S1-"), _told("candidate", "S2-")).distinct()
    return training.triplets(pairs, p, fallback="en")


def knn_partitioned_ids(spark, sf):
    v = _vectors(spark, sf).select(_told("id", "S2-"), "vector", "label")
    return blocking.nearest_blocked(v, v, TOP, "label").select("query", "candidate", "sim", "rank")


def stream_ownership_ids(spark, sf):
    return ownership.owners(_event_pairs(_t(spark, sf, "events").select("event_id", "user_id")).select(_told("query", "S1-"), _told("candidate", "S3-"), "prob"), 0.3)


def transliterated_names(spark, sf):
    """Names of several scripts, one for each part by its key."""
    names = F.array(*map(F.lit, SCRIPTS))
    name = F.concat(names[(F.col("p_partkey") % len(SCRIPTS)).cast("int")], F.lit(" "), F.col("p_partkey").cast("string"))
    return _t(spark, sf, "part").select("p_partkey", T.clean_lexical(name).alias("lexical"), T.clean_text(name).alias("rules"))


#: Names as they stand in records.
SCRIPTS = ("Ærøskøbing Łódź", "Москва щука", "नमस्ते", "Ελλάδα", "தமிழ்", "Đorđe Pvtltd", "Straße 2nd fl", "東京 Limited")


def short_names(spark, sf):
    """Prefix fallback with names shorter than the prefix, and plain agreement of skeletons, empty ones among them."""
    n = _t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.lit("x").alias("country"), F.substring("p_brand", 7, 1).alias("digit"))
    n = n.select("id", "country", F.concat(F.lit("aei"), F.when(F.col("digit") > "2", F.concat("digit", F.lit("bm ltd"))).otherwise("")).alias("name"))
    n = n.withColumn("skeleton", T.skeleton(F.col("name")))
    q, p = n.where("id % 20 = 0"), n.where("id % 20 between 1 and 2")
    pairs = blocking.prefix_fallback(q, p, spark.createDataFrame([], "query long, candidate long"), 10**6, fields=("skeleton",))
    rows = pairs.withColumns({f"{s}_{c}": F.lit("") for s in ("left", "right") for c in ("name", "address", "pin", "house")})
    return features.features_11(rows).select("query", "candidate", "skeleton", "pin", "house")


def nonblank_text(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", F.when(F.expr("doc_id % 9 = 0"), "  ").when(F.expr("doc_id % 10 = 0"), None).otherwise(F.col("source")).alias("text"))
    return training.filled_texts(d, "text")


def pair_cap(spark, sf):
    return training.first_pairs(_orders(spark, sf), 200).select("query", "candidate")


def positive_cap(spark, sf):
    return training.sampled_pairs(_orders(spark, sf).where("prob >= 0.5").select("query", "candidate"), 300)


def ownership_f05(spark, sf):
    o = _orders(spark, sf)
    return evaluation.ownership_f_beta(_t(spark, sf, "customer").select(F.col("c_custkey").alias("query")), o, o.where("query % 3 = candidate % 3").select("query", "candidate"), 0.6)


def dummy_subset_test(spark, sf):
    """The second half of the subset: other queries, other extra records."""
    q, p = _sides(_records(spark, sf).select("id"))
    return training.subset(q, p, _truth(spark, sf), 20, 50, 50, 100)[1]


def file_rules(spark, sf):
    """A written list file with a comma header and a row without a tab, as the validator sees its lines."""
    path = scratch.folder(spark, "file")
    o = _t(spark, sf, "orders").select(F.concat(F.lit("S1-"), "o_orderkey", F.when(F.expr("o_orderkey % 10 = 0"), " ").otherwise("\t"), F.lit("S2-1")).alias("value"))
    o.write.text(path)
    lines = spark.read.text(path).select("value", F.lit(1).alias("number"))
    head = spark.createDataFrame([("source1_entity_id,matched_entity_ids", 0)], "value string, number int")
    return quality.file_problems(lines.unionByName(head), ("source1_entity_id", "matched_entity_ids"))


def embedding_cache_append(spark, sf):
    """A cache filled in two calls, the second with texts that changed: as many vectors as records, of the texts as they are."""
    path = scratch.folder(spark, "cache")
    d = _t(spark, sf, "documents").select("doc_id", "text")
    cache.cached_vectors(d.where("doc_id % 4 <> 0"), path, "doc_id", "text", cache.hashing_encoder(16))
    now = d.withColumn("text", F.when(F.expr("doc_id % 6 = 1"), "new").otherwise(F.col("text")))
    v = cache.cached_vectors(now, path, "doc_id", "text", cache.patient(cache.hashing_encoder(16)))
    kept = spark.read.parquet(path).groupBy("id").agg(F.count("*").alias("versions"))
    return v.join(kept, "id").select(F.col("id").alias("doc_id"), "versions", F.size("vector").alias("dim"))


def audit_output(spark, sf):
    """The profile written as CSV and JSON, and read back from both."""
    path = scratch.folder(spark, "audit")
    quality.write_profile(_t(spark, sf, "customer"), ["c_custkey", "c_name", "c_mktsegment"], path)
    a = spark.read.option("header", True).csv(f"{path}/csv").select("column", F.col("n_rows").cast("long"), F.col("n_blank").cast("long"))
    return a.join(spark.read.json(f"{path}/json").select("column", F.col("n_rows").alias("json_rows")), "column")


def _overlap(left: list[str], right: list[str]) -> list[float]:
    pairs = [(set(a.split()), set(b.split())) for a, b in zip(left, right, strict=True)]
    return [len(a & b) / max(1, len(a | b)) for a, b in pairs]


def pair_scorer(spark, sf):
    """A plugged scorer in the cross-encoder's place."""
    n = _names(spark, sf).select(F.col("a").alias("query"), F.col("b").alias("candidate"), F.col("a").alias("left"), F.col("b").alias("right"))
    return modeling.scored_pairs(n, _overlap).select("query", "candidate", F.round("prob", 6).alias("prob"))


def _event_pairs(df: DataFrame) -> DataFrame:
    return df.select(F.col("user_id").alias("query"), F.expr("event_id % 97").alias("candidate"), F.expr("event_id * 31 % 101 / 100.0D").alias("prob"))


def stream_ownership(spark, sf):
    """Events replayed as a file stream; the last state of each candidate."""
    events = _t(spark, sf, "events").select("event_id", "user_id")
    source, out, marks = (scratch.folder(spark, x) for x in ("events", "owners", "marks"))
    events.repartition(4).write.parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    ownership.start(_event_pairs(stream), 0.3, out, marks).awaitTermination()
    return ownership.latest(spark.read.parquet(out))


def tsv_round_trip(spark, sf):
    """Records written as tab-separated text and read with the guard and the enrichment."""
    path = scratch.folder(spark, "tsv")
    d = _t(spark, sf, "part").select(F.concat(F.lit("S1-"), "p_partkey").alias("entity_id"), F.concat(F.lit('"'), "p_name").alias("business_name"), F.concat_ws(" ", F.col("p_size").cast("string"), F.col("p_type")).alias("business_address"), F.when(F.expr("p_partkey % 5 = 0"), "").otherwise(F.col("p_brand")).alias("country"))
    d.repartition(3).write.option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)
    back = tables.guarded(spark, tables.read_tsv(spark, path), [path])
    e = tables.enrich(back, "US")
    return e.select("entity_id", "business_name", "country_n", "name_n", "skeleton", "house", "state")


def limited_scan(spark, sf):
    """A scan's row limit: as many rows as asked for, or as there are."""
    path = scratch.folder(spark, "limit")
    _t(spark, sf, "supplier").select("s_suppkey", "s_name").write.option("sep", "\t").option("header", True).csv(path)
    count = lambda n: tables.read_tsv(spark, path, ("s_suppkey", "s_name"), limit=n).agg(F.count("*").alias("n"))
    return count(7).select(F.lit("7").alias("asked"), "n").unionByName(count(10**6).select(F.lit("all").alias("asked"), "n"))


def candidate_file_pairs(spark, sf):
    """A written file of lists read back as pairs."""
    path = scratch.folder(spark, "candidates")
    tables.write_lists(match_lists(spark, sf), path, "source1_entity_id", "matched_entity_ids")
    back = tables.read_lists(tables.read_tsv(spark, path, ("source1_entity_id", "matched_entity_ids")), "source1_entity_id", "matched_entity_ids")
    return tables.long_pairs(back)


def list_file_round_trip(spark, sf):
    path = scratch.folder(spark, "lists")
    lists = match_lists(spark, sf)
    tables.write_lists(lists, path, "source1_entity_id", "matched_entity_ids")
    back = tables.read_lists(tables.read_tsv(spark, path, ("source1_entity_id", "matched_entity_ids")), "source1_entity_id", "matched_entity_ids")
    return back.select(F.col("query").cast("long").alias("query"), F.size("members").cast("long").alias("n"))


QUERIES = {f.__name__: f for f in (
    entity_clean_rules, entity_clean_lexical, extract_pin_house_state, record_text, null_token_clean, pool_union, token_df_cap,
    block_token, block_house, block_prefix_fallback, block_topk_shared_tokens, block_state_compat, knn_partitioned, knn_global,
    rank_gap_features, cascade_prune, sim_tristate, sim_len_ratio, sim_cosine, pair_features_8, pair_features_11,
    pair_features_12, pair_features_19, context_features, label_pairs, blocking_recall, macro_f05, f05_threshold_sweep,
    best_threshold, decide_threshold, decide_ownership, match_lists, candidate_lists, validator_issues,
    matches_outside_candidates, audit_profile, gt_summary, gt_size_histogram, country_distribution, dedupe_encode_join,
    embedding_cache_join, encoded_records, train_positives, train_triplets, holdout_split, sample_rows, split_loader,
    dummy_subset, row_numbers, gbt_rerank, two_stage_stack, isotonic_calibrate, stream_ownership, tsv_round_trip,
    list_file_round_trip, decide_ownership_ids, holdout_split_ids, train_triplets_ids, knn_partitioned_ids, stream_ownership_ids,
    transliterated_names, short_names, nonblank_text, pair_cap, positive_cap, ownership_f05, dummy_subset_test, file_rules,
    embedding_cache_append, audit_output, pair_scorer, block_union, lexical_candidates, pair_attributes, candidate_file_pairs,
    train_text_pairs, limited_scan,
)} | {
    "sim_token_jaccard": sim_token_jaccard, "sim_ngram_jaccard": sim_ngram_jaccard, "sim_regex_jaccard": sim_regex_jaccard,
    "sim_jaro_winkler_gated": sim_jaro_winkler_gated, "sim_jaro_winkler_classic": sim_jaro_winkler_classic,
    "sim_indel_ratio": sim_indel_ratio, "sim_token_set": sim_token_set, "sim_token_sort": sim_token_sort, "sim_partial": sim_partial,
}
