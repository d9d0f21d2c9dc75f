"""Queries for sources, extraction, windows and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from editlake.operators import relational as R
from editlake.operators.aggregates import frequency
from editlake.plans.registry import Tables, query

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("select p_partkey mol_id, p_name, p_retailprice mw from part where p_retailprice between 905 and 995 and p_name is not null and exists (select 1 from lineitem where l_partkey = p_partkey and l_returnflag in ('A','R') and l_linestatus = 'F')")
def molecules_with_activity(t: Tables):
    parts = t("part").where("p_retailprice between 905 and 995 and p_name is not null").withColumnRenamed("p_partkey", "l_partkey")
    return R.with_activity(parts, t("lineitem"), "l_partkey", F.col("l_returnflag").isin("A", "R") & (F.col("l_linestatus") == "F")).select(F.col("l_partkey").alias("mol_id"), "p_name", F.col("p_retailprice").alias("mw"))


@query("select distinct p_partkey mol_id, p_name, p_retailprice mw from part join lineitem on l_partkey = p_partkey order by mol_id limit 500")
def molecules_distinct_join(t: Tables):
    found = t("part").join(t("lineitem"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_partkey").alias("mol_id"), "p_name", F.col("p_retailprice").alias("mw")).distinct()
    return R.top_by(found, 500, F.col("mol_id"))


@query("select l_partkey mol_id, l_orderkey doc_id, l_linenumber assay_id, l_quantity value, o_orderpriority assay_type, s_name target_name from lineitem join orders on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey where l_partkey in (select p_partkey from part where p_size < 5)")
def measurements_for_molecules(t: Tables):
    keys = t("part").where("p_size < 5").select(F.col("p_partkey").alias("l_partkey"))
    rows = t("lineitem").join(keys, "l_partkey", "left_semi").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(F.col("l_partkey").alias("mol_id"), F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("assay_id"), F.col("l_quantity").alias("value"), F.col("o_orderpriority").alias("assay_type"), F.col("s_name").alias("target_name"))


@query("select target_id, count(distinct mol_id) n_molecules, count(*) n_measurements from measurements group by target_id having count(distinct mol_id) >= 100 order by n_molecules desc, target_id limit 20")
def top_targets(t: Tables):
    return R.top_by(R.target_counts(t("measurements"), ["target_id"], "mol_id").where("n_molecules >= 100"), 20, F.col("n_molecules").desc(), F.col("target_id"))


@query("select target_id, s_name target_name, count(distinct mol_id) n_molecules from measurements join supplier on s_suppkey = target_id where relation <> 'O' group by all")
def target_molecule_counts(t: Tables):
    rows = t("measurements").where("relation <> 'O'").join(t("supplier"), F.col("target_id") == F.col("s_suppkey"))
    return R.target_counts(rows, ["target_id", "s_name"], "mol_id").select("target_id", F.col("s_name").alias("target_name"), "n_molecules").orderBy(F.col("n_molecules").desc(), "target_id")


@query("select l_orderkey doc_id, l_linenumber, mol_id, value, mw, heavy_atoms from (select l_orderkey, l_linenumber, l_partkey mol_id, l_quantity value from lineitem where l_suppkey = 7 and l_returnflag = 'R') x join molecules using (mol_id) order by doc_id, l_linenumber, mol_id, value limit 200")
def activities_for_target(t: Tables):
    rows = t("lineitem").where("l_suppkey = 7 and l_returnflag = 'R'").select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", F.col("l_partkey").alias("mol_id"), F.col("l_quantity").alias("value"))
    return R.top_by(rows.join(t("molecules").select("mol_id", "mw", "heavy_atoms"), "mol_id"), 200, *map(F.col, ("doc_id", "l_linenumber", "mol_id", "value")))


@query("select distinct s_suppkey target_id, n_name organism, r_name sequence, length(r_name) seq_length from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where s_suppkey in (select l_suppkey from lineitem where l_quantity > 49)")
def target_sequences(t: Tables):
    wanted = t("lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey")).distinct()
    rows = t("supplier").join(wanted, "s_suppkey", "left_semi").join(F.broadcast(t("nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(F.col("s_suppkey").alias("target_id"), F.col("n_name").alias("organism"), F.col("r_name").alias("sequence"), F.length("r_name").alias("seq_length")).distinct()


@query("select * from measurements where target_id in (3, 5, 8)")
def select_targets_specific(t: Tables):
    return t("measurements").where(F.col("target_id").isin(3, 5, 8))


@query("with c as (select target_id, count(distinct mol_id) n_molecules from measurements group by 1), j as (select k.word target_class, c.target_id, n_molecules, row_number() over (partition by k.word order by n_molecules desc, c.target_id) rank from c join targets t on c.target_id = t.target_id join (select unnest(['asia','ame','EU']) word) k on contains(lower(t.target_class), lower(k.word))) select * from j where rank <= 3")
def select_targets_mix(t: Tables):
    words = t.spark.createDataFrame([("asia",), ("ame",), ("EU",)], "word string")
    classes = t("targets").select("target_class").distinct().join(F.broadcast(words), F.contains(F.lower("target_class"), F.lower("word")))
    counts = R.target_counts(t("measurements"), ["target_id"], "mol_id").join(t("targets").select("target_id", "target_class"), "target_id").join(classes, "target_class")
    return R.top_per_group(counts.select(F.col("word").alias("target_class"), "target_id", "n_molecules"), ["target_class"], 3, F.col("n_molecules").desc(), F.col("target_id"))


@query("with c as (select target_id, count(distinct mol_id) n from measurements where relation = 'F' group by 1 having count(*) >= 50), k as (select target_id from c order by n desc, target_id limit 10) select mol_id, property_name, target_id, value, relation from measurements where relation = 'F' and target_id in (select target_id from k) union all select mol_id, property_name, target_id, value, relation from measurements where relation = 'O'")
def select_targets_top_n(t: Tables):
    m = t("measurements").select("mol_id", "property_name", "target_id", "value", "relation")
    top = R.top_by(R.target_counts(m.where("relation = 'F'"), ["target_id"], "mol_id").where("n_measurements >= 50"), 10, F.col("n_molecules").desc(), F.col("target_id"))
    return m.where("relation = 'F'").join(top, "target_id", "left_semi").unionByName(m.where("relation = 'O'"))


@query("select p_partkey mol_id, 'p_size' property_name, cast(p_size as double) \"value\", 'computed' units from part where p_size is not null union all select p_partkey, 'p_retailprice', p_retailprice, 'computed' from part where p_retailprice is not null")
def unpivot_descriptors(t: Tables):
    return R.unpivot_descriptors(t("part").withColumnRenamed("p_partkey", "mol_id"), "mol_id", ["p_size", "p_retailprice"])


@query("select s_suppkey target_id, concat(substr(replace(replace(lower(s_name), ' ', '_'), '-', '_'), 1, 20), '_', 'IC50') property_name from supplier")
def property_name_slug(t: Tables):
    return t("supplier").select(F.col("s_suppkey").alias("target_id"), R.name_slug(F.col("s_name"), F.lit("IC50")).alias("property_name"))


@query("select * from measurements where property_name not in ('A_0', 'N_1')")
def exclude_computed_filter(t: Tables):
    names = t.spark.createDataFrame([("A_0",), ("N_1",)], "property_name string")
    return t("measurements").join(F.broadcast(names), "property_name", "left_anti").select(*t("measurements").columns)


@query("select distinct p_type value, dense_rank() over (order by p_type) - 1 id from part")
def dictionary_encode(t: Tables):
    return R.dictionary(t("part"), "p_type")


@query("select p_partkey, coalesce(case when p_type < 'M' then p_type end, 'Unknown') p_type from part")
def dictionary_decode(t: Tables):
    words = R.dictionary(t("part"), "p_type")
    coded = R.encode(t("part").select("p_partkey", "p_type"), words, "p_type", "type_id")
    return R.decode(coded, words.where("value < 'M'"), "type_id", "p_type")


@query("select entry_id, antibody_id, assay_type, mutations from docs_mut where antibody_id in ('src1','src2','src3') and assay_type <> 'de' and len(string_split(mutations, ',')) between 1 and 2")
def antibody_filter(t: Tables):
    n = F.size(F.split("mutations", ","))
    return R.optional_filters(t("docs_mut"), F.col("antibody_id").isin("src1", "src2", "src3"), None, F.col("assay_type") != "de", n.between(1, 2)).select("entry_id", "antibody_id", "assay_type", "mutations")


@query("select p_partkey, p_name, p_type from part where lower(p_name) like '%ring%' or lower(p_type) like '%promo%' or lower(p_name) like '%promo%' or lower(p_type) like '%ring%'")
def keyword_any_filter(t: Tables):
    return t("part").where(R.keyword_any(["p_name", "p_type"], ["Ring", "PROMO"])).select("p_partkey", "p_name", "p_type")


@query("with c as (select l_orderkey, l_linenumber, l_partkey, length(cast(l_extendedprice as varchar)) len, row_number() over (partition by l_orderkey order by case when l_returnflag = 'A' then 0 else 1 end, l_quantity desc, l_linenumber, l_partkey, l_suppkey) r from lineitem) select l_orderkey id, max(case when r = 1 then l_partkey end) heavy, max(case when r = 2 then l_partkey end) light from c group by 1")
def chain_assignment(t: Tables):
    order = [F.when(F.col("l_returnflag") == "A", 0).otherwise(1), F.col("l_quantity").desc(), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]
    two = R.top_per_group(t("lineitem"), ["l_orderkey"], 2, *order)
    return two.groupBy(F.col("l_orderkey").alias("id")).agg(F.max(F.when(F.col("rank") == 1, F.col("l_partkey"))).alias("heavy"), F.max(F.when(F.col("rank") == 2, F.col("l_partkey"))).alias("light"))


@query("select mol_id, scaffold, mw from molecules where mw between 910 and 960 and scaffold is not null and heavy_atoms is not null order by mol_id limit 300")
def molecules_by_mass_band(t: Tables):
    return R.top_by(t("molecules").where("mw between 910 and 960 and scaffold is not null and heavy_atoms is not null").select("mol_id", "scaffold", "mw"), 300, F.col("mol_id"))


@query("with v as (select * from seq_pairs where regexp_matches(seq_a, '^[ACGU]*$') and regexp_matches(seq_b, '^[ACGU]*$') and property_name in ('en','fr','de')) select pair_id, property_name, value_a, value_b from v where property_name in (select property_name from v group by 1 having count(*) >= 125)")
def valid_pairs_filter(t: Tables):
    good = t("seq_pairs").where(F.col("seq_a").rlike("^[ACGU]*$") & F.col("seq_b").rlike("^[ACGU]*$") & F.col("property_name").isin("en", "fr", "de"))
    many = good.groupBy("property_name").count().where("count >= 125")
    return good.join(many, "property_name", "left_semi").select("pair_id", "property_name", "value_a", "value_b")


@query("select p_partkey id, p_brand condition, round(avg(l_quantity), 6) mean_value, count(*) n from part join lineitem on p_partkey = l_partkey where p_brand in ('Brand#1','Brand#2') group by 1, 2")
def control_subset(t: Tables):
    stats = t("lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.round(F.avg("l_quantity"), 6).alias("mean_value"), F.count("*").alias("n"))
    return t("part").where(F.col("p_brand").isin("Brand#1", "Brand#2")).select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("condition")).join(stats, "id")


@query("select l_partkey variant_id, l_returnflag ref, l_linestatus alt, p_name oligo, value from (select *, l_quantity value, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_suppkey, l_quantity) r from lineitem where length(l_returnflag) = 1 and length(l_linestatus) = 1) x join part on p_partkey = l_partkey where r = 1")
def variant_oligo_join(t: Tables):
    single = t("lineitem").where((F.length("l_returnflag") == 1) & (F.length("l_linestatus") == 1))
    first = R.first_per_key(single, ["l_partkey"], *map(F.col, ("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")))
    return first.join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_partkey").alias("variant_id"), F.col("l_returnflag").alias("ref"), F.col("l_linestatus").alias("alt"), F.col("p_name").alias("oligo"), F.col("l_quantity").alias("value"))


@query("select l_orderkey, l_linenumber, l_partkey, coalesce(l_tax, l_discount) \"value\", l_quantity standard_value, cast(null as varchar) missing from lineitem")
def resolve_columns(t: Tables):
    keys = {k: [k] for k in KEY[:3]}
    return R.resolve_columns(t("lineitem"), keys | {"value": ["ddG", "l_tax", "l_discount"], "standard_value": ["l_quantity", "l_tax"], "missing": ["none", "nothing"]})


@query("select l_orderkey, l_partkey, l_quantity from lineitem")
def column_projection_sink(t: Tables):
    return R.project_present(t("lineitem"), ["l_orderkey", "absent", "l_partkey", "l_quantity"])


@query("select entry_id, replace(mutations, ':', '') mutations_str from docs_mut")
def flatten_nested_for_csv(t: Tables):
    parts = F.transform(F.split("mutations", ","), lambda m: F.struct(F.substring_index(m, ":", 1).alias("chain"), F.regexp_replace(m, "^H:", "").alias("rest"), F.contains(m, F.lit(":")).alias("named")))
    nested = t("docs_mut").select("entry_id", parts.alias("mutations"))
    return nested.select("entry_id", F.array_join(F.transform("mutations", lambda m: F.concat(F.when(m.named, m.chain).otherwise(F.lit("")), m.rest)), ",").alias("mutations_str"))


@query("select l_returnflag, l_orderkey, l_linenumber, l_partkey, l_extendedprice, r rank from (select *, row_number() over (partition by l_returnflag order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey) r from lineitem) where r <= 5")
def top_n_per_group(t: Tables):
    return R.top_per_group(t("lineitem"), ["l_returnflag"], 5, F.col("l_extendedprice").desc(), *map(F.col, KEY[:3])).select("l_returnflag", *KEY[:3], "l_extendedprice", "rank")


@query("select p_partkey, p_retailprice from part order by p_retailprice desc, p_partkey limit 25")
def global_top_k(t: Tables):
    return R.top_by(t("part").select("p_partkey", "p_retailprice"), 25, F.col("p_retailprice").desc(), F.col("p_partkey"))


@query("select task, avg(rank) mean_rank, max(rank) max_rank, round(sum(rank * y_true), 3) check_sum from (select task, y_true, rank() over (partition by task order by y_true) + (count(*) over (partition by task, y_true) - 1) / 2.0 rank from preds) group by task")
def average_rank(t: Tables):
    from editlake.functions.metrics import average_ranks

    ranked = average_ranks(t("preds"), ["task"], "y_true", "rank")
    return ranked.groupBy("task").agg(F.avg("rank").alias("mean_rank"), F.max("rank").alias("max_rank"), F.round(F.sum(F.col("rank") * F.col("y_true")), 3).alias("check_sum"))


@query("select task, l_orderkey, l_linenumber, l_partkey, y_true from (select *, row_number() over (partition by task order by y_true desc, l_orderkey desc, l_linenumber desc, l_partkey desc) r from preds) where r = 1")
def best_row_per_group(t: Tables):
    best = t("preds").groupBy("task").agg(F.max(F.struct("y_true", *KEY[:3])).alias("best"))
    return best.select("task", *(F.col(f"best.{k}") for k in KEY[:3]), "best.y_true")


@query("select property_name, n, round(n / sum(n) over (), 6) share, row_number() over (order by n desc, property_name) rank from (select property_name, count(*) n from measurements group by 1)")
def rank_share(t: Tables):
    return frequency(t("measurements"), "property_name").select("property_name", "n", F.round(F.col("percent") / 100, 6).alias("share"), "rank")


@query("select 'orders' source, o_orderkey id, o_totalprice \"value\", null::varchar event_type from orders union all select 'events', event_id, \"value\", event_type from events")
def union_sources(t: Tables):
    a = t("orders").select(F.lit("orders").alias("source"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"))
    b = t("events").select(F.lit("events").alias("source"), F.col("event_id").alias("id"), "value", "event_type")
    return a.unionByName(b, allowMissingColumns=True)


@query("select l_partkey from lineitem where l_returnflag = 'A' intersect select l_partkey from lineitem where l_returnflag = 'N' intersect select l_partkey from lineitem where l_returnflag = 'R'")
def intersect_edits(t: Tables):
    kinds = ["A", "N", "R"]
    rows = t("lineitem").where(F.col("l_returnflag").isin(kinds))
    return rows.groupBy("l_partkey").agg(F.countDistinct("l_returnflag").alias("n")).where(F.col("n") == len(kinds)).select("l_partkey")


@query("select site_id, coverage from sites where site_id not in (select site_id from sites where is_edited = 1)")
def except_selected(t: Tables):
    return t("sites").select("site_id", "coverage").join(t("sites").where("is_edited = 1").select("site_id"), "site_id", "left_anti")


@query("with b as (select chrom, count(*) size from sites group by 1), o as (select chrom, size, sum(size) over (order by md5('g|' || chrom), chrom) - size before, sum(size) over () total from b), s as (select *, cast(total * 0.7 as bigint) tt, cast(floor(total * 0.15) as bigint) vv from o), c as (select *, (select min(before + size) from s where before + size >= tt) reached from s) select chrom, size, before, case when before < tt then 'train' when before - reached < vv then 'val' else 'test' end split from c")
def running_group_allocation(t: Tables):
    from editlake.operators.splits import group_allocation

    groups = group_allocation(t("sites"), ["chrom"], seed="g", fractions=(0.7, 0.15))
    return groups.select("chrom", "size", "before", "split")
