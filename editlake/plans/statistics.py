"""Queries for metrics, clusters, models, files and streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from editlake.functions import metrics as M
from editlake.functions import sequence as Q
from editlake.operators import clustering as C
from editlake.operators import models as L
from editlake.operators.aggregates import frequency
from editlake.operators.ordering import equal_width_bins, quantile_bins
from editlake.operators.pairs import bit_similarity_join, set_similarity_join
from editlake.operators.relational import top_per_group
from editlake.operators.shared import checkpointed, scratch_path
from editlake.operators.splits import group_split, member_split
from editlake.plans.pairs import _genes
from editlake.plans.registry import Tables, query
from editlake.plans.splits import _grouped
from editlake.sources import tables as IO
from editlake.streaming import incremental as I

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_K = ", ".join(KEY)


def _metrics_sql(source: str, group: str, p: str = "y_pred", digits: int = 4) -> str:
    e = f"({p} - y_true)"
    cols = {"mse": f"avg({e} * {e})", "rmse": f"sqrt(avg({e} * {e}))", "mae": f"avg(abs({e}))", "mape": f"100 * avg(abs({e} / nullif(y_true, 0)))", "r2": f"1 - sum({e} * {e}) / nullif(var_pop(y_true) * count(*), 0)", "max_error": f"max(abs({e}))", "mean_residual": f"avg({e})", "std_residual": f"stddev_pop({e})", "y_mean": "avg(y_true)", "y_std": "stddev_pop(y_true)", "y_range": "max(y_true) - min(y_true)"}
    return f"select {group}, count(*) n, " + ", ".join(f"round({v}, {digits}) {k}" for k, v in cols.items()) + f" from {source} group by {group}"


_W = "(1.0::double + l_linenumber)"
_E = "(y_pred - y_true)"


@query(f"select task, count(*) n, round(sum({_W} * {_E} * {_E}) / sum({_W}), 4) mse, round(sqrt(sum({_W} * {_E} * {_E}) / sum({_W})), 4) rmse, round(sum({_W} * abs({_E})) / sum({_W}), 4) mae, round(100 * sum({_W} * abs({_E} / y_true)) / sum({_W}), 4) mape, round(1 - sum({_W} * {_E} * {_E}) / (sum({_W} * y_true * y_true) - sum({_W} * y_true) * sum({_W} * y_true) / sum({_W})), 4) r2 from preds group by 1")
def weighted_metrics(t: Tables):
    rows = t("preds").withColumn("w", 1.0 + F.col("l_linenumber"))
    return M.regression_metrics(rows, ["task"], digits=4, weight="w").select("task", "n", "mse", "rmse", "mae", "mape", "r2")


@query()
def correlation_tests(t: Tables):
    """Correlations of each task with their p-values; SQL has no beta function, tests compare with known values."""
    both = M.correlations(t("preds"), ["task"]).join(M.kendall_tau(t("preds"), ["task"]).select("task", "kendall"), "task")
    return M.with_p_values(both, {"pearson": "pearson", "spearman": "spearman", "kendall": "kendall"})


@query(_metrics_sql("preds", "task"))
def regression_metrics(t: Tables):
    return M.regression_metrics(t("preds"), ["task"], digits=4)


_RANKS = "select *, rank() over (partition by task order by y_true) + (count(*) over (partition by task, y_true) - 1) / 2.0 ry, rank() over (partition by task order by y_pred) + (count(*) over (partition by task, y_pred) - 1) / 2.0 rp from preds"


@query(f"select task, count(*) n, round(corr(y_true, y_pred), 6) pearson, round(corr(ry, rp), 6) spearman from ({_RANKS}) group by 1")
def correlations(t: Tables):
    return M.correlations(t("preds"), ["task"])


@query("with p as (select l_suppkey, y_true y, y_pred p, row_number() over () i from preds), q as (select a.l_suppkey, sum(sign(a.y - b.y) * sign(a.p - b.p)) s, count(*) filter (a.y <> b.y) ny, count(*) filter (a.p <> b.p) np from p a join p b on a.l_suppkey = b.l_suppkey and a.i < b.i group by 1) select l_suppkey, n, round(s / (sqrt(ny::double * np)), 6) kendall from q join (select l_suppkey, count(*) n from p group by 1) using (l_suppkey)")
def kendall_tau(t: Tables):
    return M.kendall_tau(t("preds"), ["l_suppkey"])


_B4 = "select p.*, (select len(list_filter(quantile_cont(y_true, [0.25, 0.5, 0.75]), lambda e: p.y_true >= e)) from preds) bin from preds p"


@query(_metrics_sql(f"({_B4})", "bin"))
def metrics_per_bin(t: Tables):
    return M.regression_metrics(quantile_bins(t("preds"), "y_true", 4).withColumn("bin", F.col("bin").cast("long")), ["bin"], digits=4)


_SPARSE = "(select task || '_' || l_suppkey % 3 task, case when l_partkey % 4 > 0 then y_true end y_true, y_pred from preds)"


def _sparse(t: Tables):
    return t("preds").select(F.concat("task", F.lit("_"), (F.col("l_suppkey") % 3).cast("string")).alias("task"), F.when(F.col("l_partkey") % 4 > 0, F.col("y_true")).alias("y_true"), "y_pred")


@query(_metrics_sql(f"(select * from {_SPARSE} where y_true is not null)", "task"))
def multitask_metrics(t: Tables):
    return M.regression_metrics(_sparse(t), ["task"], digits=4)


@query(f"with m as ({_metrics_sql(f'(select * from {_SPARSE} where y_true is not null)', 'task')}) select round(avg(mse), 4) mse, round(avg(mae), 4) mae, round(avg(r2), 4) r2, sum(n)::bigint n from m")
def macro_metrics(t: Tables):
    m = M.regression_metrics(_sparse(t), ["task"], digits=4)
    return m.agg(*(F.round(F.avg(c), 4).alias(c) for c in ("mse", "mae", "r2")), F.sum("n").alias("n"))


@query("select task, round(avg(case when sign(y_true - 25) = sign(y_pred - 25) then 1.0 else 0 end), 6) direction from preds group by 1")
def direction_accuracy(t: Tables):
    same = F.signum(F.col("y_true") - 25) == F.signum(F.col("y_pred") - 25)
    return t("preds").groupBy("task").agg(F.round(F.avg(same.cast("double")), 6).alias("direction"))


@query(f"select {_K}, (select len(list_filter(quantile_cont(l_extendedprice, [0.2, 0.4, 0.6, 0.8]), lambda e: l.l_extendedprice >= e)) from lineitem) bin from lineitem l", name="quantile_bins")
def quantile_bins_query(t: Tables):
    return quantile_bins(t("lineitem").select(*KEY, "l_extendedprice"), "l_extendedprice", 5).drop("l_extendedprice")


@query(f"with e as (select min(l_quantity) lo, max(l_quantity) hi from lineitem) select {_K}, least(6, floor((l_quantity - lo) / ((hi - lo) / 7)))::int bin from lineitem, e", name="equal_width_bins")
def equal_width_bins_query(t: Tables):
    return equal_width_bins(t("lineitem").select(*KEY, "l_quantity"), "l_quantity", 7).drop("l_quantity")


_TOP = f"select *, row_number() over (partition by task order by y_true desc, {_K}, y_pred) ty, row_number() over (partition by task order by y_pred desc, {_K}, y_true) tp, count(*) over (partition by task) n from preds"


@query(f"select task, count(*) filter (ty <= 100 and tp <= 100) hits, round(count(*) filter (ty <= 100 and tp <= 100) / 100.0::double, 6) top_k from ({_TOP}) group by 1")
def top_k_accuracy(t: Tables):
    both = F.count_if((F.col("__ty") <= 100) & (F.col("__tp") <= 100))
    return M.top_ranks(t("preds"), ["task"], "y_true", "y_pred", KEY).groupBy("task").agg(both.alias("hits"), F.round(both / 100, 6).alias("top_k"))


@query(f"select task, round((count(*) filter (tp <= n * 5 // 100 and y_true >= 45) / max(n * 5 // 100)::double) / (count(*) filter (y_true >= 45) / max(n)::double), 6) ef from ({_TOP}) group by 1")
def enrichment_factor(t: Tables):
    ranked = M.top_ranks(t("preds"), ["task"], "y_true", "y_pred", KEY)
    sized = ranked.join(ranked.groupBy("task").agg(F.count("*").alias("n")), "task")
    active = F.col("y_true") >= 45
    top = F.expr("n * 5 div 100")
    rate = F.count_if(active & (F.col("__tp") <= top)) / F.max(top)
    return sized.groupBy("task").agg(F.round(F.try_divide(rate, F.count_if(active) / F.count("*")), 6).alias("ef"))


@query(f"select task, round(sum(case when tp <= 50 then (pow(2, y_true / 10) - 1) / log2(tp + 1) end) / sum(case when ty <= 50 then (pow(2, y_true / 10) - 1) / log2(ty + 1) end), 6) ndcg from ({_TOP}) group by 1")
def ndcg(t: Tables):
    gain = F.pow(F.lit(2.0), F.col("y_true") / 10) - 1
    at = lambda c: F.sum(F.when(F.col(c) <= 50, gain / F.log2(F.col(c) + 1)))
    return M.top_ranks(t("preds"), ["task"], "y_true", "y_pred", KEY).groupBy("task").agg(F.round(F.coalesce(F.try_divide(at("__tp"), at("__ty")), F.lit(0.0)), 6).alias("ndcg"))


@query("select task, round(avg(case when abs(y_true - y_pred) <= 1.96::double * 2 then 1.0 else 0 end), 6) coverage from preds group by 1")
def interval_coverage(t: Tables):
    inside = F.abs(F.col("y_true") - F.col("y_pred")) <= 1.96 * 2
    return t("preds").groupBy("task").agg(F.round(F.avg(inside.cast("double")), 6).alias("coverage"))


_BIN = "select quality y, case when n_chars % 1000 >= 500 then 1 else 0 end p, n_chars % 1000 s from labels join documents using (doc_id)"


@query(f"with b as ({_BIN}), r as (select *, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0 r from b), c as (select count(*) filter (y = 1 and p = 1) tp, count(*) filter (y <> 1 and p = 1) fp, count(*) filter (y = 1 and p <> 1) fn, count(*) filter (y = p) ok, count(*) n, count(*) filter (y = 1) pos, sum(r) filter (y = 1) rs from r) select round(ok / n::double, 6) accuracy, round(tp / (tp + fp)::double, 6) \"precision\", round(tp / (tp + fn)::double, 6) recall, round(2 * tp / (2 * tp + fp + fn)::double, 6) f1, round((rs - pos * (pos + 1) / 2) / (pos * (n - pos))::double, 6) auroc from c")
def binary_metrics(t: Tables):
    rows = t("labels").join(t("documents").select("doc_id", "n_chars"), "doc_id").select(F.col("quality").alias("y"), (F.col("n_chars") % 1000).alias("s")).withColumn("p", (F.col("s") >= 500).cast("int"))
    counts = rows.agg(*M.binary_counts(F.col("y"), F.col("p")))
    area = M.auroc(rows.withColumn("g", F.lit(1)), ["g"], "y", "s").select("auroc")
    return counts.crossJoin(area).select(*(F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1", "auroc")))


_METHODS = "select 'one' method, task, y_true, y_pred from preds union all select 'two', task, y_true, y_pred2 from preds"


def _methods(t: Tables):
    p = t("preds")
    both = p.select(F.lit("one").alias("method"), "task", "y_true", "y_pred").unionByName(p.select(F.lit("two").alias("method"), "task", "y_true", F.col("y_pred2").alias("y_pred")))
    return both.groupBy("method", "task").agg(F.avg(F.abs(F.col("y_pred") - F.col("y_true"))).alias("mae"), F.corr("y_pred", "y_true").alias("r"))


@query(f"with m as (select method, task, avg(abs(y_pred - y_true)) mae, corr(y_pred, y_true) r from ({_METHODS}) group by 1, 2), a as (select method, avg(mae) mae, avg(r) r from m group by 1) select method, round(mae, 6) mae, round(r, 6) r, mae = min(mae) over () best_mae, r = max(r) over () best_r from a")
def method_leaderboard(t: Tables):
    means = _methods(t).groupBy("method").agg(F.avg("mae").alias("mae"), F.avg("r").alias("r"))
    every = Window.partitionBy()
    flagged = means.withColumn("best_mae", F.col("mae") == F.min("mae").over(every)).withColumn("best_r", F.col("r") == F.max("r").over(every))
    return flagged.withColumn("mae", F.round("mae", 6)).withColumn("r", F.round("r", 6))


@query(f"select task, round(avg(abs(y_pred - y_true)) filter (method = 'one'), 6) \"one\", round(avg(abs(y_pred - y_true)) filter (method = 'two'), 6) \"two\" from ({_METHODS}) group by 1")
def method_task_pivot(t: Tables):
    """The mean error of each method on each task."""
    return _methods(t).groupBy("task").pivot("method", ["one", "two"]).agg(F.round(F.first("mae"), 6))


@query("with m as (select task, avg(y_true) mu from preds group by 1) select task, round(avg(abs(y_true - mu)), 6) mae_mean, round(avg(abs(y_true)), 6) mae_zero, round(avg((y_true - mu) * (y_true - mu)), 4) mse_mean, round(avg(y_true * y_true), 4) mse_zero from preds join m using (task) group by 1")
def naive_baselines(t: Tables):
    p = t("preds")
    d = F.col("y_true") - F.col("mu")
    rows = p.join(p.groupBy("task").agg(F.avg("y_true").alias("mu")), "task")
    return rows.groupBy("task").agg(F.round(F.avg(F.abs(d)), 6).alias("mae_mean"), F.round(F.avg(F.abs("y_true")), 6).alias("mae_zero"), F.round(F.avg(d * d), 4).alias("mse_mean"), F.round(F.avg(F.col("y_true") * F.col("y_true")), 4).alias("mse_zero"))


@query("select l_partkey edit, count(*) n, round(avg(y_true), 6) mean_true, round(avg(abs(y_pred - y_true)), 6) mae_1, round(avg(abs(y_pred2 - y_true)), 6) mae_2, round(corr(y_true, y_pred), 5) r_1, round(corr(y_true, y_pred2), 5) r_2 from preds group by 1 having count(*) >= 10")
def per_edit_performance(t: Tables):
    mae = lambda c: F.round(F.avg(F.abs(F.col(c) - F.col("y_true"))), 6)
    stats = t("preds").groupBy(F.col("l_partkey").alias("edit")).agg(F.count("*").alias("n"), F.round(F.avg("y_true"), 6).alias("mean_true"), mae("y_pred").alias("mae_1"), mae("y_pred2").alias("mae_2"), F.round(F.corr("y_true", "y_pred"), 5).alias("r_1"), F.round(F.corr("y_true", "y_pred2"), 5).alias("r_2"))
    return stats.where("n >= 10")


@query(f"with a as ({_metrics_sql('preds', 'task')}), b as ({_metrics_sql('preds', 'task', 'y_pred2')}) select task, round(b.r2 - a.r2, 4) d_r2, round(b.mae - a.mae, 4) d_mae, round(100 * (b.mae - a.mae) / a.mae, 3) percent_mae from a join b using (task)")
def model_improvement(t: Tables):
    a, b = (M.regression_metrics(t("preds"), ["task"], p=p, digits=4).select("task", F.col("r2").alias(f"r2_{n}"), F.col("mae").alias(f"mae_{n}")) for p, n in (("y_pred", "a"), ("y_pred2", "b")))
    gap = F.col("mae_b") - F.col("mae_a")
    return a.join(b, "task").select("task", F.round(F.col("r2_b") - F.col("r2_a"), 4).alias("d_r2"), F.round(gap, 4).alias("d_mae"), F.round(100 * gap / F.col("mae_a"), 3).alias("percent_mae")).orderBy("percent_mae")


# Clusters

_TANI = "len(list_intersect(a.bits, b.bits)) / len(list_distinct(list_concat(a.bits, b.bits)))::double"
_NEAR = f"select a.vec_id a, b.vec_id b, {_TANI} s, a.label la, b.label lb from fingerprints a join fingerprints b on a.vec_id < b.vec_id where {_TANI} >= 0.4"


def _near(t: Tables, least: float = 0.4):
    return bit_similarity_join(t("fingerprints"), "vec_id", "bits", least)


@query()
def butina_clusters(t: Tables):
    """Leaders by number of neighbours; SQL can't state the sequence, tests compare with a plain loop."""
    links = checkpointed(_near(t).select("vec_id_a", "vec_id_b"))
    degree = links.select(F.col("vec_id_a").alias("id")).unionByName(links.select(F.col("vec_id_b").alias("id"))).groupBy("id").count()
    nodes = t("fingerprints").select(F.col("vec_id").alias("id")).join(degree, "id", "left").select("id", (-F.coalesce("count", F.lit(0))).alias("order"))
    return C.leader_clusters(nodes, links, "vec_id_a", "vec_id_b")


KMER = 8  # of whole texts, which hold nearly all shorter words


def _kmer_sets(texts, id_col: str, seq: str):
    """Distinct sequences (seq, id, n, kmers), each with the smallest id."""
    distinct = texts.select(F.col(id_col).alias("id"), F.col(seq).alias("seq")).groupBy("seq").agg(F.min("id").alias("id"))
    return checkpointed(distinct.select("seq", "id", F.length("seq").alias("n"), F.array_distinct(F.regexp_extract_all("seq", F.lit(f"(?=(.{{{KMER}}}))"), F.lit(1))).alias("kmers")))  # one pass, at any length


@query()
def kmer_leader_clusters(t: Tables):
    """Leaders by length, then first sequence; k-mer Jaccard of 0.7 and more."""
    sets = _kmer_sets(t("letters").where("length(letters) > 0"), "text_id", "letters")
    links = set_similarity_join(sets, "id", "kmers", 0.7)
    return C.leader_clusters(sets.select("id", (-F.col("n")).alias("order")), links, "id_a", "id_b")


@query()
def kmer_leader_clusters_by_length(t: Tables):
    """The same among sequences of one length."""
    sets = _kmer_sets(t("letters").where("length(letters) > 0"), "text_id", "letters")
    links = set_similarity_join(sets, "id", "kmers", 0.7, within="n")
    return C.leader_clusters(sets.select("id", F.col("id").alias("order")), links.select("id_a", "id_b"), "id_a", "id_b")


@query(f"with n as ({_NEAR}), e as (select a x, b y from n union select b, a from n), core as (select x id from e group by 1 having count(*) + 1 >= 3), ce as (select x, y from e where x in (select id from core) and y in (select id from core)), reach as (with recursive r(id, lab) as (select id, id from core union select r.id, ce.y from r join ce on ce.x = r.lab) select * from r), lab as (select id, min(lab) series from reach group by 1), every as (select id, series from lab union all select e.x, min(lab.series) from e join lab on e.y = lab.id where e.x not in (select id from core) group by 1) select id, series from every where series in (select series from every group by 1 having count(*) >= 3)")
def density_series(t: Tables):
    return C.density_series(_near(t), "vec_id_a", "vec_id_b", min_samples=3, min_size=3)


@query()
def kmeans_edit_clusters(t: Tables):
    """Size and percent of k-means clusters with their commonest labels."""
    clustered = L.kmeans_clusters(t("embeddings"), "embedding", 5, components=20).select("vec_id", "label", "cluster")
    sizes = frequency(clustered, "cluster").select("cluster", F.col("n").alias("size"), "percent")
    top = top_per_group(clustered.groupBy("cluster", "label").agg(F.count("*").alias("n")), ["cluster"], 5, F.col("n").desc(), F.col("label"))
    return top.join(sizes, "cluster")


@query("select label, count(*) n, round(avg(embedding[1]::double), 5) mean, round(stddev_samp(embedding[1]::double), 5) std, round(avg(case when embedding[1] > 0 then 1.0 else 0 end), 6) positive, round(avg(case when vec_id % 6 = 0 then 1.0 else 0 end), 6) share_0, round(avg(case when vec_id % 6 = 1 then 1.0 else 0 end), 6) share_1 from embeddings group by 1")
def cluster_effect_profile(t: Tables):
    v = F.get("embedding", F.lit(0)).cast("double")
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return t("embeddings").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(v), 5).alias("mean"), F.round(F.stddev_samp(v), 5).alias("std"), share(v > 0).alias("positive"), *(share(F.col("vec_id") % 6 == i).alias(f"share_{i}") for i in (0, 1)))


@query("with s as (select q.vec_id query, r.vec_id neighbour, round(list_cosine_similarity(q.embedding::double[], r.embedding::double[]), 6) similarity from embeddings q join embeddings r on q.vec_id <> r.vec_id where q.vec_id % 100 = 0), k as (select *, row_number() over (partition by query order by similarity desc, neighbour) rank from s) select * from k where rank <= 5")
def knn_cosine(t: Tables):
    rows = t("embeddings").select("vec_id", "embedding")
    return C.knn_cosine(rows, rows.where("vec_id % 100 = 0"), "vec_id", "embedding")


@query()
def knn_cosine_all(t: Tables):
    """Neighbours of all rows from an inverted file; tests hold them against all pairs."""
    return C.knn_cosine_all(t("embeddings").select("vec_id", "embedding"), "vec_id", "embedding")


_KNN = "with s as (select q.vec_id query, r.vec_id neighbour, abs(r.label - q.label) gap, round(list_cosine_similarity({q}, {r}), 6) similarity from embeddings q join embeddings r on q.vec_id <> r.vec_id where q.vec_id % 100 = 0), k as (select *, row_number() over (partition by query order by similarity desc, neighbour) rank from s) select query, round(avg(gap), 6) gap from k where rank <= 5 group by 1"
_WHOLE, _HALF = ({x: f"{x}.embedding{part}::double[]" for x in "qr"} for part in ("", "[1:16]"))


@query(f"with w as ({_KNN.format(**_WHOLE)}), h as ({_KNN.format(**_HALF)}) select query, w.gap gap_whole, h.gap gap_half, round(w.gap - h.gap, 6) improvement from w join h using (query)")
def knn_neighbour_delta(t: Tables):
    """Mean difference of a value between a row and its neighbours, in two tables of vectors: the whole ones and their first 16 numbers."""
    e = t("embeddings").withColumn("half", F.slice("embedding", 1, 16))
    gaps = lambda v, name: C.neighbour_delta(C.knn_cosine(e.select("vec_id", v), e.where("vec_id % 100 = 0").select("vec_id", v), "vec_id", v), e, "vec_id", "label").withColumnRenamed("gap", name)
    return gaps("embedding", "gap_whole").join(gaps("half", "gap_half"), "query").select("query", F.round("gap_whole", 6).alias("gap_whole"), F.round("gap_half", 6).alias("gap_half"), F.round(F.round("gap_whole", 6) - F.round("gap_half", 6), 6).alias("improvement"))


@query(f"select count(*) n, round(avg(abs(abs(la - lb) - abs(a % 7 - b % 7))), 6) mae, round(avg(case when abs(a % 7 - b % 7) >= 2 then 1.0 else 0 end), 6) captured from ({_NEAR}) where abs(la - lb) >= 2")
def activity_cliffs(t: Tables):
    y = t("fingerprints").select("vec_id", "label")
    side = lambda s: y.select(F.col("vec_id").alias(f"vec_id_{s}"), F.col("label").alias(f"y_{s}"))
    pairs = _near(t).join(side("a"), "vec_id_a").join(side("b"), "vec_id_b")
    gap, guess = F.abs(F.col("y_a") - F.col("y_b")), F.abs(F.col("vec_id_a") % 7 - F.col("vec_id_b") % 7)
    return pairs.where(gap >= 2).agg(F.count("*").alias("n"), F.round(F.avg(F.abs(gap - guess)), 6).alias("mae"), F.round(F.avg((guess >= 2).cast("double")), 6).alias("captured"))


@query()
def ridge_delta_model(t: Tables):
    """A ridge model of a value on vectors, and the predicted change from one vector to another."""
    from editlake.plans.pairs import _vec_pairs

    e = t("embeddings").select("vec_id", "embedding", F.col("label").cast("double").alias("y"))
    model = L.ridge(e, "embedding", "y")
    scored = L.predict(model, e, "embedding", "f").select("vec_id", "f")
    a, b = (scored.select(F.col("vec_id").alias(s), F.col("f").alias(f"f_{s}")) for s in "ab")
    return _vec_pairs(t).join(a, "a").join(b, "b").select("a", "b", (F.col("f_b") - F.col("f_a")).alias("delta"))


@query()
def ridge_edit_model(t: Tables):
    """A ridge model of the change of a value directly on the vector of the edit."""
    rows = t("seq_pairs").select("pair_id", Q.edit_vector(F.col("seq_a"), F.col("seq_b")).alias("edit"), (F.col("value_b") - F.col("value_a")).alias("y"))
    return L.predict(L.ridge(rows, "edit", "y"), rows, "edit", "delta").select("pair_id", "delta")


@query()
def pca_projection(t: Tables):
    """Two components of each vector; signs are as the solver leaves them."""
    rows, shares = L.pca_projection(t("embeddings"), "embedding", 2)
    return rows.select("vec_id", "components", F.lit(sum(shares)).alias("explained"))


# Files


def _written(t: Tables, df, name: str, **options) -> str:
    path = scratch_path(t.spark, name)
    IO.write_table(df, path, **options)
    return path


@query("select p_partkey, p_name, p_retailprice from part")
def scan_csv(t: Tables):
    path = _written(t, t("part").select("p_partkey", "p_name", "p_retailprice"), "csv", format="csv")
    return IO.read_csv(t.spark, path, "p_partkey long, p_name string, p_retailprice double")


@query("select cast(s_suppkey as varchar) id, s_name name from supplier")
def scan_delimited(t: Tables):
    path = scratch_path(t.spark, "delimited")
    t("supplier").select(F.col("s_suppkey").alias("id "), F.col("s_name").alias(" name")).write.option("header", True).option("sep", ";").csv(path)
    return IO.read_delimited(t.spark, path, ";", comment="%")


@query("select event_id, cast(json_extract(props, '$.k') as int) k, event_type from events")
def scan_json_records(t: Tables):
    """Records one a line, with a text column that holds JSON."""
    path = scratch_path(t.spark, "json")
    t("events").select("event_id", "props", F.struct("event_type").alias("inner")).write.json(path)
    records = IO.read_json_records(t.spark, path, "event_id long, props string, inner struct<event_type string>", lines=True)
    return IO.parse_json_column(records, "props", "k int", "p").select("event_id", "p.k", "inner.event_type")


def _json_files(t: Tables, entry, name: str) -> str:
    """A JSON text for each thousand events, each a file of its own."""
    path = scratch_path(t.spark, name)
    e = t("events").withColumn("file", F.expr("event_id div 1000"))
    e.groupBy("file").agg(entry.alias("value")).repartition("file").write.partitionBy("file").text(path)
    return path


@query("select event_id, event_type from events")
def scan_json_array(t: Tables):
    """Files that hold an array of nested records each."""
    path = _json_files(t, F.to_json(F.collect_list(F.struct("event_id", F.struct("event_type").alias("inner")))), "json-array")
    return IO.read_json_records(t.spark, path, "event_id long, inner struct<event_type string>").select("event_id", "inner.event_type")


@query("select cast(event_id as varchar) id, event_type from events")
def scan_json_map(t: Tables):
    """Files that hold an object of records by id each."""
    path = _json_files(t, F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("event_id").cast("string"), F.struct("event_type"))))), "json-map")
    return IO.read_json_map(t.spark, path, "event_type string").select("id", "record.event_type")


@query("select p_partkey mol_id, p_name smiles, p_retailprice mw, p_size hbd from part where p_size > 5 and p_partkey % 7 <> 0")
def scan_api_records(t: Tables):
    """Nested records of an interface as columns; those without a structure or without properties are dropped."""
    nested = t("part").select(
        F.col("p_partkey").alias("molecule_id"),
        F.when(F.col("p_size") > 5, F.struct(F.col("p_name").alias("canonical_smiles"))).alias("molecule_structures"),
        F.when(F.col("p_partkey") % 7 != 0, F.struct(F.col("p_retailprice").alias("full_mwt"), F.col("p_size").alias("hbd"))).alias("molecule_properties"),
    )
    path = scratch_path(t.spark, "api")
    nested.write.json(path)
    records = IO.read_json_records(t.spark, path, "molecule_id long, molecule_structures struct<canonical_smiles string>, molecule_properties struct<full_mwt double, hbd int>", lines=True)
    columns = {"mol_id": "molecule_id", "smiles": "molecule_structures.canonical_smiles", "mw": "molecule_properties.full_mwt", "hbd": "molecule_properties.hbd"}
    return IO.flatten_records(records, columns, needed=["molecule_structures.canonical_smiles", "molecule_properties"])


@query("select n_name, r_name from nation join region on n_regionkey = r_regionkey")
def scan_jdbc_table(t: Tables):
    """Read from a database where one JVM does all the work, else from the folder of tables: no server is at hand."""
    location = t.sf_dir
    if t.spark.sparkContext.master.startswith("local["):
        location = IO.embedded_database(t.spark, "tables")
        for name, text in (("nation", "n_name"), ("region", "r_name")):
            IO.write_relational(t(name).select(*(c for c in t(name).columns if not c.endswith("_comment"))), location, name, {text: "varchar(100)"})
    nation = IO.read_relational(t.spark, location, "nation", key="n_nationkey", bounds=(0, 25), partitions=4) if location != t.sf_dir else t("nation")
    region = IO.read_relational(t.spark, location, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query("select chrom, 'transcript' feature, lo, hi, strand, gene_id, null::varchar gene_name, 't' || tx_id transcript_id from intervals")
def scan_annotation_gtf(t: Tables):
    i = t("intervals")
    text = F.concat_ws("\t", "chrom", F.lit("given"), F.lit("transcript"), "lo", "hi", F.lit("."), "strand", F.lit("."), F.concat(F.lit('gene_id "'), "gene_id", F.lit('"; transcript_id "t'), "tx_id", F.lit('";')))
    lines = i.select(text.alias("value")).unionByName(i.select(F.lit("# note").alias("value"))).unionByName(i.select(F.concat("chrom", F.lit("\tgiven\tgene\t1\t2\t.\t+\t.\tx")).alias("value")))
    path = scratch_path(t.spark, "gtf")
    lines.write.text(path)
    return IO.read_annotation(t.spark, path)


@query("select chrom, pos, ref_base, coverage, a, c, g, t from sites where coverage >= 10")
def scan_pileup(t: Tables):
    line = F.concat_ws("\t", "chrom", F.lit("."), F.lit("."), "pos", F.lower("ref_base"), "coverage", "a", "c", "g", "t", F.lit("end"))
    path = scratch_path(t.spark, "pileup")
    t("sites").select(line.alias("value")).write.text(path)
    return IO.read_pileup(t.spark, path)


@query("select 'd' || doc_id chrom, i chunk_no, substr(seq, i * 20 + 1, 20) chunk from (select doc_id, seq, unnest(range(0, 3)) i from seqs)")
def scan_genome_chunks(t: Tables):
    record = F.concat(F.lit(">d"), F.col("doc_id").cast("string"), F.lit(" from "), "lang", F.lit("\n"), F.lower(F.substring("seq", 1, 30)), F.lit("\n"), F.substring("seq", 31, 50))
    path = scratch_path(t.spark, "fasta")
    t("seqs").select(record.alias("value")).write.text(path)
    return IO.read_genome_chunks(t.spark, path, 20)


@query("select mol_id, property_name, \"value\" from measurements")
def sink_table(t: Tables):
    path = _written(t, t("measurements").select("mol_id", "property_name", "value"), "sink", partition="property_name")
    return t.spark.read.parquet(path)


# Streams


def _files(t: Tables, df, name: str, n: int = 3) -> str:
    """The rows as n files that a stream takes one by one."""
    path = scratch_path(t.spark, name)
    df.repartition(n).write.parquet(path)
    return path


@query("select chrom, pos, ref_base, sum(coverage)::bigint coverage, sum(a)::bigint a, sum(g)::bigint g, count(*) n from sites group by 1, 2, 3")
def incremental_pileup_totals(t: Tables):
    sites = t("sites").select("chrom", "pos", "ref_base", "coverage", "a", "g")
    source = _files(t, sites, "sites")
    return I.incremental_totals(t.spark, source, sites.schema, ["chrom", "pos", "ref_base"], ["coverage", "a", "g"], scratch_path(t.spark, "totals"), scratch_path(t.spark, "totals-state"), files_per_batch=1, compact=2)


@query("select a.core, a.mol_id mol_a, b.mol_id mol_b from fragments a join fragments b on a.core = b.core and a.mol_id < b.mol_id")
def incremental_pair_build(t: Tables):
    fragments = t("fragments").select("mol_id", "core")
    return I.incremental_pairs(t.spark, _files(t, fragments, "fragments"), fragments.schema, scratch_path(t.spark, "pairs"), scratch_path(t.spark, "pairs-state"), files_per_batch=1)


# Splits by clusters


@query()
def split_by_cluster(t: Tables):
    """Whole fingerprint clusters go to one split."""
    return group_split(butina_clusters(t), ["leader"]).select(F.col("id").alias("vec_id"), "split")


def _sequence_clusters(t: Tables, sequences):
    """seq -> leader over all distinct sequences, longest first."""
    sets = _kmer_sets(sequences.select("seq", F.xxhash64("seq").alias("id")), "id", "seq")
    links = set_similarity_join(sets, "id", "kmers", 0.7)
    leaders = C.leader_clusters(sets.select("id", (-F.col("n")).alias("order")), links, "id_a", "id_b")
    return sets.select("seq", "id").join(leaders, "id").select("seq", "leader")


@query()
def split_by_sequence_similarity(t: Tables):
    """Clusters over the sequences of both sides; a pair follows its first sequence."""
    p = t("text_pairs")
    clusters = _sequence_clusters(t, p.select(F.explode(F.array("seq_a", "seq_b")).alias("seq")))
    followed = p.join(clusters, F.col("seq_a") == F.col("seq")).select("pair_id", "leader")
    return group_split(followed, ["leader"]).select("pair_id", "split")


@query()
def split_pairs_by_cluster_priority(t: Tables):
    """Clusters are allotted; a pair trains if either sequence does, else validates if either does, else tests."""
    p = t("text_pairs")
    clusters = _sequence_clusters(t, p.select(F.explode(F.array("seq_a", "seq_b")).alias("seq")))
    members = group_split(clusters, ["leader"]).select("seq", "split")
    return member_split(p, members, "seq_a", "seq_b", "seq").select("pair_id", "split")


_GENE = "select s.site_id, coalesce(g.gene, 'intergenic_' || s.chrom || '_' || (s.pos // 10000)) gene from sites s left join (select site_id, arg_min(gene_id, tx_id) gene from (select s.*, i.tx_id, i.gene_id, i.strand tx_strand from sites s join intervals i on s.chrom = i.chrom and s.pos between i.lo and i.hi) where strand = tx_strand group by 1) g using (site_id)"


@query(_grouped(_GENE, "site_id", "gene"))
def split_by_gene(t: Tables):
    """Whole genes go to one split."""
    return group_split(_genes(t), ["gene"]).select("site_id", "split")
