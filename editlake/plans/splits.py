"""Queries for splits and sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from editlake.functions import sequence as Q
from editlake.operators import sampling as P
from editlake.operators import splits as S
from editlake.operators.ordering import exact_quantiles
from editlake.plans.registry import Tables, query
from editlake.plans.sequences import _MIS

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_LINE = ", ".join(LINE)
_CUT = "case when r < n * 70 // 100 then 'train' when r < n * 70 // 100 + n * 15 // 100 then 'val' else 'test' end"


def _md5(seed: str, *columns: str) -> str:
    return "md5(" + " || '|' || ".join([f"'{seed}'", *(f"coalesce(cast({c} as varchar), '')" for c in columns)]) + ")"


def _ranked(source: str, key: list[str], seed: str = "split", strata: str = "") -> str:
    part = f"partition by {strata}" if strata else ""
    return f"select *, row_number() over ({part} order by {_md5(seed, *key)}, {', '.join(key)}) - 1 r, count(*) over ({part}) n from ({source})"


def _random(source: str, key: list[str], seed: str = "split", strata: str = "", least: int = 0) -> str:
    return f"select {', '.join(key)}, case when n < {least} then 'train' else {_CUT} end split from ({_ranked(source, key, seed, strata)})"


def _groups(source: str, group: str, seed: str = "split", train: int = 70, val: int = 15) -> str:
    return f"select {group}, case when bef < tt then 'train' when bef - min(case when bef + size >= tt then bef + size end) over () < vv then 'val' else 'test' end split from (select *, total * {train} // 100 tt, total * {val} // 100 vv from (select {group}, size, sum(size) over (order by {_md5(seed, group)}, {group}) - size bef, sum(size) over () total from (select {group}, count(*) size from ({source}) where {group} is not null group by {group})))"


def _grouped(source: str, key: str, group: str, seed: str = "split") -> str:
    return f"select {key}, g.split from ({source}) s join ({_groups(source, group, seed)}) g using ({group})"


def _bin(value: str, bins: int, source: str, where: str = "true") -> str:
    edges = ", ".join(f"{i / bins}" for i in range(1, bins))
    return f"(select len(list_filter(quantile_cont({value}, [{edges}]), lambda e: s.{value} >= e)) from ({source}) where {where})"


def _holdout(source: str, key: list[str], test: str, seed: str = "split") -> str:
    marked = f"select *, coalesce({test}, false) held from ({source})"
    return f"select {', '.join(key)}, case when held then 'test' when r < n * 15 // 85 then 'val' else 'train' end split from ({_ranked(marked, key, seed, 'held')})"


LINES, SITES, SEQ, PAIRS = "select * from lineitem", "select * from sites", "select * from seqs", "select * from seq_pairs"


@query(_random(LINES, LINE))
def split_random(t: Tables):
    return S.random_split(t("lineitem").select(*LINE), LINE)


@query(_grouped("select p_partkey, p_type scaffold from part", "p_partkey", "scaffold"))
def split_by_scaffold(t: Tables):
    return S.group_split(t("part").select("p_partkey", F.col("p_type").alias("scaffold")), ["scaffold"]).select("p_partkey", "split")


@query(_grouped(LINES, _LINE.replace(", l_suppkey", ""), "l_suppkey").replace("select l_orderkey", "select l_suppkey, l_orderkey"))
def split_by_target(t: Tables):
    return S.group_split(t("lineitem").select(*LINE), ["l_suppkey"])


@query(f"with c as ({_grouped('select p_partkey, p_brand core from part', 'p_partkey, core', 'core')}) select split, count(*) n, count(distinct core) n_cores from c group by 1")
def split_by_core(t: Tables):
    return S.group_split(t("part").select("p_partkey", F.col("p_brand").alias("core")), ["core"]).groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("core").alias("n_cores"))


@query(f"select {', '.join(['doc_id', 'split'])} from ({_random(f'select s.*, {_bin("value", 5, SEQ)} b from ({SEQ}) s', ['doc_id'], strata='b', least=3)})")
def split_stratified_quantile(t: Tables):
    return S.quantile_split(t("seqs").select("doc_id", "value"), ["doc_id"], "value", 5).select("doc_id", "split")


_GC = "select doc_id, (length(seq) - length(replace(replace(seq, 'G', ''), 'C', ''))) / 50.0::double gc from seqs"


@query(_random(f"select s.*, {_bin('gc', 4, _GC)} b from ({_GC}) s", ["doc_id"], strata="b", least=3))
def split_stratified_gc(t: Tables):
    from editlake.functions.sequence import gc_content

    return S.quantile_split(t("seqs").select("doc_id", gc_content(F.col("seq")).alias("gc")), ["doc_id"], "gc", 4).select("doc_id", "split")


_LEN = "select doc_id, length(text)::double len from documents"


@query(_random(f"select s.*, {_bin('len', 5, _LEN)} b from ({_LEN}) s", ["doc_id"], strata="b", least=3))
def split_stratified_length(t: Tables):
    return S.quantile_split(t("documents").select("doc_id", F.length("text").cast("double").alias("len")), ["doc_id"], "len", 5).select("doc_id", "split")


@query(f"select event_id, {_CUT} split from (select event_id, row_number() over (order by ts, event_id) - 1 r, count(*) over () n from events)")
def split_temporal(t: Tables):
    return S.ordered_split(t("events").select("event_id", "ts"), "ts", ["event_id"]).select("event_id", "split")


@query(f"with g as (select l_suppkey, r, n from ({_ranked('select distinct l_suppkey from lineitem', ['l_suppkey'], 'splitfew')})), f as (select l_suppkey from g where r < n * 30 // 100), s as (select {_LINE}, case when r < 5 then 'train' when r - 5 < (n - 5) * 15 // 30 then 'val' else 'test' end split from ({_ranked('select * from lineitem where l_suppkey in (select l_suppkey from f)', LINE, 'split', 'l_suppkey')})), w as (select * from lineitem where l_suppkey not in (select l_suppkey from f)) select * from s union all select {_LINE.replace('l_suppkey', 'w.l_suppkey')}, g2.split from w join ({_groups('select * from w', 'l_suppkey')}) g2 on w.l_suppkey = g2.l_suppkey")
def split_few_shot_targets(t: Tables):
    return S.few_shot_split(t("lineitem").select(*LINE), "l_suppkey", LINE, 5)


_FLAGS = "regexp_matches(seq, '[AG]CCAUGG|[AG]..AUG.{4}')::int || '' || (len(list_filter(range(1, 49), lambda i: substr(seq, i, 3) = 'AUG')) > 1)::int || regexp_matches(seq, 'AUG(?:[ACGU]{3})*?(?:UAA|UAG|UGA)')::int || regexp_matches(seq, 'AUUUA')::int || (length(regexp_replace(seq, '[^GC]', '', 'g')) >= 30)::int"


@query(_grouped(f"select doc_id, {_FLAGS} sig from seqs", "doc_id", "sig"))
def split_motif_signature(t: Tables):
    m = Q.motif_flags(F.col("seq"))
    signed = t("seqs").select("doc_id", F.concat(*(m[f].cast("int").cast("string") for f in ("kozak", "uaug", "uorf", "au_rich", "gc_rich"))).alias("sig"))
    return S.group_split(signed, ["sig"]).select("doc_id", "split")


_EDITED = f"select *, length(seq_a) la, length(seq_b) lb, {_MIS} m from seq_pairs"
_SIGNATURE = f"select pair_id, case when la < lb then 'insertion|0|indel' when la > lb then 'deletion|0|indel' when len(m) = 0 then 'identical|0|none' else case when len(m) = 1 then 'snv|' else 'multiple_snv|' end || least(2, (m[1] - 1) * 3 // la) || case when substr(seq_a, m[1], 1) || substr(seq_b, m[1], 1) in ('AG', 'GA', 'CU', 'UC') then '|transition' else '|transversion' end end cls from ({_EDITED})"


@query(_grouped(_SIGNATURE, "pair_id", "cls"))
def split_edit_class(t: Tables):
    cls = t("seq_pairs").select("pair_id", Q.edit_signature(F.col("seq_a"), F.col("seq_b")).alias("cls"))
    return S.group_split(cls, ["cls"]).select("pair_id", "split")


@query(_holdout("select *, case when length(seq_a) = length(seq_b) then 'same' when length(seq_a) > length(seq_b) then 'del' else 'ins' end kind from seq_pairs", ["pair_id"], "kind in ('ins', 'del')"))
def split_edit_type_holdout(t: Tables):
    return S.holdout_split(t("seq_pairs").select("pair_id", "seq_a", "seq_b"), F.length("seq_a") != F.length("seq_b"), ["pair_id"]).select("pair_id", "split")


#: Pairs with the place of their first change, its bases and their class, and a context; pairs without a change go.
_PLACED = f"select pair_id, la, m[1] - 1 p, substr(seq_a, m[1], 1) || '>' || substr(seq_b, m[1], 1) change, case when substr(seq_a, m[1], 1) || substr(seq_b, m[1], 1) in ('AG', 'GA', 'CU', 'UC') then 'transition' else 'transversion' end class, length(regexp_replace(substr(seq_a, greatest(1, m[1] - 3), 7), '[^GC]', '', 'g')) / length(substr(seq_a, greatest(1, m[1] - 3), 7))::double gc, ['A_vs_A', 'M_vs_M', 'M_vs_A'][pair_id % 3 + 1] context, abs(value_b - value_a) effect from ({_EDITED}) where len(m) > 0"


def _placed(t: Tables):
    a, b, p = F.col("seq_a"), F.col("seq_b"), F.col("p")
    rows = t("seq_pairs").withColumn("p", F.explode(F.slice(Q.mismatches(a, b), 1, 1)))
    near = a.substr(F.greatest(F.lit(0), p - 3) + 1, F.lit(7))
    before, after = Q.char(a, p), Q.char(b, p)
    return rows.select("pair_id", F.length(a).alias("la"), "p", F.concat(before, F.lit(">"), after).alias("change"), Q.change_class(before, after).alias("class"), Q.gc_content(near).alias("gc"), F.get(F.array(*map(F.lit, Q.PAIR_TYPES)), (F.col("pair_id") % 3).cast("int")).alias("context"), F.abs(F.col("value_b") - F.col("value_a")).alias("effect"))


@query(_holdout(_PLACED, ["pair_id"], "p / la::double >= 0.5"))
def split_position(t: Tables):
    """Pairs whose first change lies in the second half test."""
    return S.holdout_split(_placed(t), F.col("p") / F.col("la") >= 0.5, ["pair_id"]).select("pair_id", "split")


@query(_holdout(f"select * from ({_PLACED}) where p in (0, 1, 2, 4, 5, 6)", ["pair_id"], "p in (4, 5, 6)"))
def split_position_lists(t: Tables):
    return S.listed_split(_placed(t), "p", [0, 1, 2], [4, 5, 6], ["pair_id"]).select("pair_id", "split")


@query(_holdout("select doc_id, length(regexp_replace(loop, '[^GC]', '', 'g')) gc from seq7", ["doc_id"], "gc > 3"))
def split_neighborhood_context(t: Tables):
    return S.holdout_split(t("seq7").select("doc_id", "loop"), F.regexp_count("loop", F.lit("[GC]")) > 3, ["doc_id"]).select("doc_id", "split")


@query(_holdout(LINES, LINE, "l_returnflag = 'R'"))
def split_experimental_context(t: Tables):
    return S.holdout_split(t("lineitem").select(*LINE, "l_returnflag"), F.col("l_returnflag") == "R", LINE).drop("l_returnflag")


@query(_holdout("select *, abs(value_b - value_a) > (select quantile_cont(abs(value_b - value_a), 0.75) from seq_pairs) big from seq_pairs", ["pair_id"], "big"))
def split_effect_magnitude(t: Tables):
    pairs = t("seq_pairs").withColumn("effect", F.abs(F.col("value_b") - F.col("value_a")))
    marked = pairs.crossJoin(F.broadcast(exact_quantiles(pairs, "effect", {"edge": 0.75})))
    return S.holdout_split(marked.select("pair_id", "effect", "edge"), F.col("effect") > F.col("edge"), ["pair_id"]).select("pair_id", "split")


@query(f"with c as (select doc_id, substr(loop,1,1) || '>' || center change from seq7), k as (select change, row_number() over (order by count(*) desc, change) rk, count(*) over () m from c group by 1), x as (select doc_id, rk > m * 70 // 100 held from c join k using (change)) {_holdout('select * from x', ['doc_id'], 'held')}".replace("with c as", "with c as", 1))
def split_nucleotide_change(t: Tables):
    changes = t("seq7").select("doc_id", F.concat(F.substring("loop", 1, 1), F.lit(">"), "center").alias("change"))
    return S.rare_holdout_split(changes, "change", ["doc_id"]).select("doc_id", "split")


_RARE = f"with c as ({_PLACED}), k as (select change, row_number() over (order by count(*) desc, change) rk, count(*) over () m from c group by 1), x as (select pair_id, rk > m * 70 // 100 held from c join k using (change)) {_holdout('select * from x', ['pair_id'], 'held')}"
_SUITE = {
    "random": _random(_PLACED, ["pair_id"]),
    "position_first_to_second_half": _holdout(_PLACED, ["pair_id"], "p / la::double >= 0.5"),
    "position_lists": _holdout(f"select * from ({_PLACED}) where p in (0, 1, 2, 4, 5, 6)", ["pair_id"], "p in (4, 5, 6)"),
    "context_gc": _holdout(_PLACED, ["pair_id"], "gc > 0.5"),
    "context_a_to_m": _holdout(f"select * from ({_PLACED}) where context in ('A_vs_A', 'M_vs_M')", ["pair_id"], "context = 'M_vs_M'"),
    "context_m_to_a": _holdout(f"select * from ({_PLACED}) where context in ('A_vs_A', 'M_vs_M')", ["pair_id"], "context = 'A_vs_A'"),
    "effect_small_to_large": _holdout(f"select *, effect > (select quantile_cont(effect, 0.75) from ({_PLACED})) big from ({_PLACED})", ["pair_id"], "big"),
    "change_holdout": _RARE,
    "transition_to_transversion": _holdout(_PLACED, ["pair_id"], "class = 'transversion'"),
    "transversion_to_transition": _holdout(_PLACED, ["pair_id"], "class = 'transition'"),
}


@query(" union all ".join(f"select '{k}' split_name, split, count(*) n from ({v}) group by 2" for k, v in _SUITE.items()))
def split_generalization_suite(t: Tables):
    """Ten splits of the same pairs, as sizes in one table."""
    from editlake.operators.shared import checkpointed

    p, key = checkpointed(_placed(t)), ["pair_id"]
    context = F.col("context")
    big = p.crossJoin(F.broadcast(exact_quantiles(p, "effect", {"edge": 0.75})))
    runs = {
        "random": S.random_split(p, key),
        "position_first_to_second_half": S.holdout_split(p, F.col("p") / F.col("la") >= 0.5, key),
        "position_lists": S.listed_split(p, "p", [0, 1, 2], [4, 5, 6], key),
        "context_gc": S.holdout_split(p, F.col("gc") > 0.5, key),
        "context_a_to_m": S.listed_split(p, "context", ["A_vs_A"], ["M_vs_M"], key),
        "context_m_to_a": S.listed_split(p, "context", ["M_vs_M"], ["A_vs_A"], key),
        "effect_small_to_large": S.holdout_split(big, F.col("effect") > F.col("edge"), key),
        "change_holdout": S.rare_holdout_split(p, "change", key),
        "transition_to_transversion": S.holdout_split(p, F.col("class") == "transversion", key),
        "transversion_to_transition": S.holdout_split(p, F.col("class") == "transition", key),
    }
    return reduce(lambda a, b: a.unionByName(b), (d.groupBy("split").agg(F.count("*").alias("n")).select(F.lit(k).alias("split_name"), "split", "n") for k, d in runs.items()))


@query(_random(SITES, ["site_id"], strata="is_edited"))
def split_label_stratified(t: Tables):
    return S.random_split(t("sites").select("site_id", "is_edited"), ["site_id"], strata=("is_edited",)).drop("is_edited")


@query(_holdout(f"select s.* , g.r < greatest(1, g.n * 15 // 100) held_chrom from sites s join ({_ranked('select distinct chrom from sites', ['chrom'], 'chrom')}) g on s.chrom = g.chrom", ["site_id"], "held_chrom"))
def split_chromosome(t: Tables):
    from editlake.operators.ordering import exact_rank, md5_key

    chroms = exact_rank(t("sites").select("chrom").distinct(), md5_key("chrom", "chrom"), ["chrom"], "g").withColumn("held", F.expr("g < greatest(1, g_of * 15 div 100)"))
    return S.holdout_split(t("sites").select("site_id", "chrom").join(chroms.select("chrom", "held"), "chrom"), F.col("held"), ["site_id"]).select("site_id", "split")


@query(_random(f"select s.*, {_bin('coverage', 5, SITES)} b from ({SITES}) s", ["site_id"], strata="b, is_edited", least=3))
def split_bin_label_stratified(t: Tables):
    return S.quantile_split(t("sites").select("site_id", "coverage", "is_edited"), ["site_id"], "coverage", 5, more=("is_edited",)).select("site_id", "split")


_CLIPPED = "select *, least(coverage, (select quantile_cont(coverage, 0.99) from sites))::double clipped from sites"
_SITE_GC = "select s.site_id, s.is_edited, coalesce(length(regexp_replace(letters, '[^GC]', '', 'g')) / nullif(length(letters), 0)::double, 0) gc, coalesce(-0.3::double * length(regexp_replace(letters, '[^CU]', '', 'g')), 0) energy from sites s left join letters on site_id = text_id"


@query(_random(f"select s.*, {_bin('clipped', 5, _CLIPPED)} b from ({_CLIPPED}) s", ["site_id"], strata="b, is_edited", least=3))
def split_bin_label_clipped(t: Tables):
    """Quantile bins of the coverage clipped at its 99th percentile, by label."""
    sites = t("sites").select("site_id", "coverage", "is_edited")
    clipped = sites.crossJoin(F.broadcast(exact_quantiles(sites, "coverage", {"p99": 0.99}))).withColumn("clipped", F.least("coverage", "p99"))
    return S.quantile_split(clipped, ["site_id"], "clipped", 5, more=("is_edited",)).select("site_id", "split")


def _site_values(t: Tables):
    """Sites with the GC share of their sequence and an energy that falls with its paired letters."""
    s = F.col("letters")
    rows = t("letters").select(F.col("text_id").alias("site_id"), Q.gc_content(s).alias("gc"), (-0.3 * F.regexp_count(s, F.lit("[CU]"))).alias("energy"))
    return t("sites").select("site_id", "is_edited").join(rows, "site_id", "left").na.fill(0.0, ["gc", "energy"])


@query(_random(f"select s.*, {_bin('gc', 5, _SITE_GC)} b from ({_SITE_GC}) s", ["site_id"], strata="b, is_edited", least=3))
def split_bin_label_gc(t: Tables):
    return S.quantile_split(_site_values(t), ["site_id"], "gc", 5, more=("is_edited",)).select("site_id", "split")


@query(_random(f"select s.*, {_bin('energy', 5, _SITE_GC)} b from ({_SITE_GC}) s", ["site_id"], strata="b, is_edited", least=3))
def split_bin_label_energy(t: Tables):
    return S.quantile_split(_site_values(t), ["site_id"], "energy", 5, more=("is_edited",)).select("site_id", "split")


@query(_random(f"select s.*, case when is_edited = 1 then {_bin('coverage', 4, SITES, 'is_edited = 1')} else -1 end b from ({SITES}) s", ["site_id"], strata="b", least=3))
def split_positive_rate_stratified(t: Tables):
    binned = P.positive_bins(t("sites").select("site_id", "coverage", "is_edited"), "is_edited", "coverage", 4)
    strata = binned.withColumn("bin", F.when(F.col("is_edited") == 1, F.col("bin")).otherwise(-1))
    return S.random_split(strata, ["site_id"], strata=("bin",), least=3).select("site_id", "split")


@query(_holdout("select * from seq7", ["doc_id"], "substr(loop, 1, 3) in ('ACG', 'GAC', 'UUA', 'CAG')"))
def split_context_holdout(t: Tables):
    return S.holdout_split(t("seq7").select("doc_id", "loop"), F.substring("loop", 1, 3).isin("ACG", "GAC", "UUA", "CAG"), ["doc_id"]).select("doc_id", "split")


@query(_holdout("select * from seq7", ["doc_id"], "regexp_matches(loop, '^.[AGU][AG]AC[ACU].$')"))
def split_motif_holdout(t: Tables):
    from editlake.functions.sequence import is_drach

    return S.holdout_split(t("seq7").select("doc_id", "loop"), is_drach(F.col("loop")), ["doc_id"]).select("doc_id", "split")


_REP = "select l_suppkey, part, round(median(l_quantity), 6) med, count(*) n from (select l_suppkey, l_quantity, case when r < n * 70 // 100 then 'train' else 'test' end part from (select *, row_number() over (partition by l_suppkey order by md5('rep|' || cast(l_orderkey as varchar) || '|' || cast(l_linenumber as varchar) || '|' || cast(l_partkey as varchar)), l_orderkey, l_linenumber, l_partkey) - 1 r, count(*) over (partition by l_suppkey) n from lineitem) where n >= 5) group by 1, 2"


@query(f"with p as ({_REP}) select a.l_suppkey, a.med train_median, b.med test_median, a.n n_train, b.n n_test, round(log2(a.med / b.med), 6) log2_ratio from p a join p b on a.l_suppkey = b.l_suppkey where a.part = 'train' and b.part = 'test'")
def split_replicates(t: Tables):
    """Replicates of a supplier in seeded order are cut 70 / 30 and both parts get their exact median; no array, no task for a supplier."""
    from editlake.operators.ordering import exact_rank, md5_key

    ranked = exact_rank(t("lineitem").select(*LINE[:3], "l_suppkey", "l_quantity"), md5_key("rep", *LINE[:3]), LINE[:3], "r", ("l_suppkey",)).where("r_of >= 5")
    parts = ranked.withColumn("part", F.when(F.expr("r < r_of * 70 div 100"), "train").otherwise("test"))
    medians = exact_quantiles(parts, "l_quantity", {"med": 0.5}, ("l_suppkey", "part")).join(parts.groupBy("l_suppkey", "part").agg(F.count("*").alias("n")), ["l_suppkey", "part"])
    of = lambda s: medians.where(F.col("part") == s).select("l_suppkey", F.round("med", 6).alias(f"{s}_median"), F.col("n").alias(f"n_{s}"))
    return of("train").join(of("test"), "l_suppkey").withColumn("log2_ratio", F.round(F.log2(F.col("train_median") / F.col("test_median")), 6))


@query(_holdout("select *, coverage between (select quantile_cont(coverage, 0.4) from sites) and (select quantile_cont(coverage, 0.6) from sites) band from sites", ["site_id"], "band"))
def split_coverage_holdout(t: Tables):
    sites = t("sites").select("site_id", "coverage")
    ends = exact_quantiles(sites, "coverage", {"lo": 0.4, "hi": 0.6})
    return S.holdout_split(sites.crossJoin(F.broadcast(ends)), F.col("coverage").between(F.col("lo"), F.col("hi")), ["site_id"]).select("site_id", "split")


@query(f"with x as (select *, coverage > (select quantile_cont(coverage, 0.75) from sites where is_edited = 1) and is_edited = 1 high from sites), n as (select *, r < n * 25 // 100 low from ({_ranked('select * from x where is_edited <> 1', ['site_id'], 'neg')})), u as (select site_id, high held from x where is_edited = 1 union all select site_id, low from n) {_holdout('select * from u', ['site_id'], 'held')}")
def split_rate_extrapolation(t: Tables):
    from editlake.operators.ordering import exact_rank, md5_key

    sites = t("sites").select("site_id", "coverage", "is_edited")
    edge = exact_quantiles(sites.where("is_edited = 1"), "coverage", {"edge": 0.75})
    positives = sites.where("is_edited = 1").crossJoin(F.broadcast(edge)).select("site_id", (F.col("coverage") > F.col("edge")).alias("held"))
    negatives = exact_rank(sites.where("is_edited <> 1"), md5_key("neg", "site_id"), ["site_id"], "r").select("site_id", F.expr("r < r_of * 25 div 100").alias("held"))
    return S.holdout_split(positives.unionByName(negatives), F.col("held"), ["site_id"]).drop("held")


@query(f"select d.entry_id, case when r < n * 80 // 100 then 'train' when r < n * 80 // 100 + n * 10 // 100 then 'val' else 'test' end split from docs_mut d join ({_ranked('select distinct antibody_id from docs_mut', ['antibody_id'])}) g on d.antibody_id = g.antibody_id")
def split_by_entity(t: Tables):
    return S.entity_split(t("docs_mut").select("entry_id", "antibody_id"), "antibody_id").drop("antibody_id")


# Sampling

_NEG = "select * from sites where is_edited <> 1"


@query(f"select site_id, is_edited from sites where is_edited = 1 union all select site_id, is_edited from ({_ranked(_NEG, ['site_id'], 'sample')}) where r < 100")
def sample_classes(t: Tables):
    return P.positives_and(t("sites").select("site_id", "is_edited"), "is_edited", ["site_id"], 100)


@query(f"select site_id, is_edited from sites where is_edited = 1 union all select site_id, is_edited from ({_ranked(_NEG, ['site_id'], 'sample')}) where r < 2 * (select count(*) from sites where is_edited = 1)")
def sample_negative_ratio(t: Tables):
    return P.ratio_negatives(t("sites").select("site_id", "is_edited"), "is_edited", ["site_id"], 2)


def _matched(strata: str, n: int, source: str) -> str:
    quota = f"select {strata}, {n} * count(*) // (select count(*) from ({source}) where is_edited = 1) q from ({source}) where is_edited = 1 group by {strata}"
    return f"select site_id from ({_ranked(f'select * from ({source}) where is_edited <> 1', ['site_id'], 'sample', strata)}) join ({quota}) using ({strata}) where r < q"


_BINNED = f"select s.*, {_bin('coverage', 4, SITES, 'is_edited = 1')} b from ({SITES}) s"


@query(_matched("b", 120, _BINNED))
def sample_coverage_matched(t: Tables):
    binned = P.positive_bins(t("sites").select("site_id", "coverage", "is_edited"), "is_edited", "coverage", 4, "b")
    return P.matched_negatives(binned, "is_edited", ["site_id"], 120, ["b"]).select("site_id")


@query(_matched("ref_base", 120, SITES))
def sample_context_matched(t: Tables):
    return P.matched_negatives(t("sites").select("site_id", "ref_base", "is_edited"), "is_edited", ["site_id"], 120, ["ref_base"]).select("site_id")


_RANGE = f"select * from ({_BINNED}) where is_edited = 1 or coverage between (select min(coverage) from sites where is_edited = 1) and (select max(coverage) from sites where is_edited = 1)"


@query(_matched("b, ref_base", 120, _RANGE))
def sample_joint_matched(t: Tables):
    binned = P.positive_bins(t("sites").select("site_id", "coverage", "ref_base", "is_edited"), "is_edited", "coverage", 4, "b")
    return P.matched_negatives(P.within_positive_range(binned, "is_edited", "coverage"), "is_edited", ["site_id"], 120, ["b", "ref_base"]).select("site_id")


_HARD = "select * from sites where is_edited <> 1 and ref_base = 'A' and coverage >= (select median(coverage) from sites where is_edited = 1)"


@query(f"select site_id from ({_ranked(_HARD, ['site_id'], 'sample')}) where r < 60")
def sample_hard_negatives(t: Tables):
    return P.hard_negatives(t("sites").select("site_id", "coverage", "ref_base", "is_edited"), "is_edited", "coverage", ["site_id"], 60, F.col("ref_base") == "A").select("site_id")


_MIX = f"with h as materialized (select site_id from ({_ranked(_HARD, ['site_id'], 'sample')}) where r < 36), rest as materialized (select * from ({_RANGE}) where site_id not in (select site_id from h)) select site_id, 'hard' kind from h union all select site_id, 'joint' from ({_matched('b, ref_base', 84, 'select * from rest')})"


def _mixed(t: Tables):
    sites = P.positive_bins(t("sites").select("site_id", "coverage", "ref_base", "is_edited"), "is_edited", "coverage", 4, "b")
    hard = P.hard_negatives(sites, "is_edited", "coverage", ["site_id"], 36, F.col("ref_base") == "A").select("site_id")
    rest = P.within_positive_range(sites, "is_edited", "coverage").join(hard, "site_id", "left_anti")
    joint = P.matched_negatives(rest, "is_edited", ["site_id"], 84, ["b", "ref_base"]).select("site_id")
    return hard.withColumn("kind", F.lit("hard")).unionByName(joint.withColumn("kind", F.lit("joint")))


@query(_MIX)
def sample_mixed(t: Tables):
    return _mixed(t)


_STRATEGIES = {"random": f"select site_id from ({_ranked(_NEG, ['site_id'], 'sample')}) where r < 120", "mixed": f"select site_id from ({_MIX})", "coverage": _matched("b", 120, _BINNED), "context": _matched("ref_base", 120, SITES), "joint": _matched("b, ref_base", 120, _RANGE), "hard": f"select site_id from ({_ranked(_HARD, ['site_id'], 'sample')}) where r < 60"}


@query(" union all ".join(f"select '{k}' strategy, count(*) n, round(avg(coverage), 6) mean_coverage, round(avg(ln(1 + coverage)), 6) mean_log, round(avg(case when ref_base = 'A' then 1.0 else 0 end), 6) share_a from sites where site_id in (select site_id from ({v}))" for k, v in _STRATEGIES.items()))
def balanced_dataset_suite(t: Tables):
    sites = t("sites").select("site_id", "coverage", "ref_base")
    runs = {"random": lambda t: P.sample_count(t("sites").where("is_edited <> 1").select("site_id"), ["site_id"], 120), "mixed": lambda t: _mixed(t).select("site_id"), "coverage": sample_coverage_matched, "context": sample_context_matched, "joint": sample_joint_matched, "hard": sample_hard_negatives}
    chosen = reduce(lambda a, b: a.unionByName(b), (f(t).withColumn("strategy", F.lit(k)) for k, f in runs.items()))
    rows = chosen.join(sites, "site_id")
    return rows.groupBy("strategy").agg(F.count("*").alias("n"), F.round(F.avg("coverage"), 6).alias("mean_coverage"), F.round(F.avg(F.log1p("coverage")), 6).alias("mean_log"), F.round(F.avg((F.col("ref_base") == "A").cast("double")), 6).alias("share_a"))


@query(f"select {_LINE} from ({_ranked(LINES, LINE, 'sample')}) where r < n * 10 // 100")
def sample_fraction(t: Tables):
    return P.sample_fraction(t("lineitem").select(*LINE), LINE, 10)


_STATS = "select l_suppkey, avg(case when l_linestatus = 'O' then l_quantity end) ma, stddev_samp(case when l_linestatus = 'O' then l_quantity end) sa, avg(case when l_linestatus = 'F' then l_quantity end) mb, stddev_samp(case when l_linestatus = 'F' then l_quantity end) sb from lineitem group by 1"


@query(f"with s as ({_STATS}), w as (select l_suppkey, 1 / greatest((pow(sa / ma, 2) + pow(sb / mb, 2)) / (ln(2.0) * ln(2.0)), 1e-6) w from s) select l_suppkey, round(w / (select avg(w) from w), 6) weight from w")
def variance_weights(t: Tables):
    value = lambda s: F.when(F.col("l_linestatus") == s, F.col("l_quantity"))
    stats = t("lineitem").groupBy("l_suppkey").agg(F.avg(value("O")).alias("ma"), F.stddev_samp(value("O")).alias("sa"), F.avg(value("F")).alias("mb"), F.stddev_samp(value("F")).alias("sb"))
    return P.variance_weights(stats, "ma", "sa", "mb", "sb").select("l_suppkey", F.round("weight", 6).alias("weight"))
