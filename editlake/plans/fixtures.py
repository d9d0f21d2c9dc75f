"""Views over the given tables that stand for the inputs of the registered queries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: {STR} is the name of the text type, {G} the flag for replacing all matches, {PIECES50} and {PIECES7} give a row for each
#: stretch of so many letters: a whole text is cut into stretches, the last one ending with it; shorter texts are repeated.
VIEWS = {
    "molecules": "select p_partkey mol_id, p_name label, p_type scaffold, p_brand core_label, p_retailprice mw, p_size heavy_atoms from part",
    "fragments": "select p_partkey mol_id, p_brand core, concat(p_type,'.',p_name) chain from part union all select p_partkey mol_id, concat(p_brand,'_',p_type) core, p_name chain from part",
    "measurements": "select l_partkey mol_id, concat(l_returnflag,'_',cast(l_suppkey % 5 as {STR})) property_name, l_suppkey target_id, l_quantity value, l_linestatus relation, l_orderkey doc_id, l_linenumber assay_id, l_shipdate ts from lineitem",
    "targets": "select s_suppkey target_id, s_name target_name, n_name organism, r_name target_class, s_acctbal score from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey",
    "letters": "select doc_id text_id, lang, source, n_chars, translate(regexp_replace(lower(text),'[^a-z]',''{G}),'abcdefghijklmnopqrstuvwxyz','ACGUACGUACGUACGUACGUACGUAC') letters from documents",
    "seqs": "select text_id * 100003 + p.piece doc_id, text_id, p.s seq, lang, source, cast(n_chars + p.piece as double) value from (select text_id, lang, source, n_chars, {PIECES50} p from letters where length(letters) > 0) t",
    "seq7": "select text_id * 1000003 + p.piece doc_id, text_id, p.s loop, substr(p.s,4,1) center, lang, source, cast(n_chars + p.piece as double) value from (select text_id, lang, source, n_chars, {PIECES7} p from letters where length(letters) > 0) t",
    "text_pairs": "select text_id pair_id, letters seq_a, case when text_id % 2 = 0 then concat(substr(letters,1,p),'G',substr(letters,p+2)) else concat(substr(letters,1,p),substr(letters,p+2)) end seq_b from (select *, cast(text_id % 47 as int) p from letters where length(letters) > 0) t",
    "seq_pairs": "select doc_id pair_id, seq seq_a, case when doc_id % 10 = 0 then concat(substr(seq,1,p),substr(seq,p+2)) when doc_id % 10 = 1 then concat(substr(seq,1,p),'G',substr(seq,p+1)) when doc_id % 10 = 2 then concat(substr(seq,1,p),translate(substr(seq,p+1,2),'ACGU','UGCA'),substr(seq,p+3)) else concat(substr(seq,1,p),translate(substr(seq,p+1,1),'ACGU',case when doc_id % 3 = 0 then 'GUAC' else 'UGCA' end),substr(seq,p+2)) end seq_b, value value_a, value * (1 + (doc_id % 7 - 3) / 10.0) value_b, lang property_name, source cell_type from (select doc_id, seq, value, lang, source, cast(doc_id % 47 as int) p from seqs) t",
    "sites": "select d.doc_id site_id, d.source chrom, (d.doc_id * 37) % 5000 + 1 pos, case when d.doc_id % 2 = 0 then '+' else '-' end strand, case when d.doc_id % 2 = 0 then 'A' else 'T' end ref_base, d.n_chars coverage, d.doc_id % 11 a, d.doc_id % 13 c, d.doc_id % 7 g, d.doc_id % 5 t, coalesce(l.quality, 0) is_edited from documents d left join labels l on d.doc_id = l.doc_id",
    "intervals": "select o_orderkey tx_id, concat('src',cast(o_orderkey % 8 as {STR})) chrom, (o_custkey * 31) % 5000 + 1 lo, (o_custkey * 31) % 5000 + 1 + o_orderkey % 40 hi, case when o_orderkey % 3 = 0 then '-' else '+' end strand, concat('g',cast(o_custkey as {STR})) gene_id from orders",
    "preds": "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag task, l_quantity y_true, l_quantity * (1 - l_discount) + 10 * l_tax y_pred, l_quantity * (1 + l_discount) y_pred2 from lineitem",
    "docs_mut": "select doc_id entry_id, source antibody_id, lang assay_type, seq heavy_wt, concat('H:',substr(seq,p,1),cast(p as {STR}),'G,',substr(seq,p+3,1),cast(p+3 as {STR}),'C') mutations, value delta_value from (select *, cast(doc_id % 40 + 1 as int) p from seqs) t",
    "history": "select event_id step, value loss, event_type task, ts from events",
    "brackets": "select doc_id, translate(seq,'ACGU','.(.)') structure from seqs",
}
_STRETCH = "case when length(letters) < {n} then rpad(letters, {n}, letters) else substr(letters, cast(least(i * {n}, length(letters) - {n}) + 1 as int), {n}) end"
#: The same by bytes, as letters are ASCII: a place in a text is found at once, not by counting characters up to it.
_BYTES = "case when octet_length(letters) < {n} then rpad(letters, {n}, letters) else cast(substr(cast(letters as binary), cast(least(i * {n}, octet_length(letters) - {n}) + 1 as int), {n}) as string) end"
SPARK_BITS = "select vec_id, label, filter(transform(embedding, (x,i) -> case when x > 0.1 then i else -1 end), b -> b >= 0) bits from embeddings"
DUCK_BITS = "select vec_id, label, list_filter(list_transform(embedding, lambda x, i: case when x > 0.1 then i-1 else -1 end), lambda b: b >= 0) bits from embeddings"
#: Derived in the queries by operators, in SQL by these.
PAIR_SQL = "select a.core, a.mol_id mol_a, b.mol_id mol_b, a.chain chain_a, b.chain chain_b from fragments a join fragments b on a.core = b.core and a.mol_id < b.mol_id join molecules ma on ma.mol_id = a.mol_id join molecules mb on mb.mol_id = b.mol_id where abs(ma.mw - mb.mw) <= 200 and (select count(*) from fragments f where f.core = a.core) >= 5"


def _uses(sql: str) -> list[str]:
    return list(dict.fromkeys(m for m in re.findall(r"(?:from|join)\s+(\w+)", sql) if m in VIEWS or m in TABLES or m in ("fingerprints", "core_pairs")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or a view over them."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = SPARK_BITS if name == "fingerprints" else VIEWS[name].replace("{STR}", "string").replace("{G}", "")
    for n in (50, 7):
        sql = sql.replace(f"{{PIECES{n}}}", f"explode(transform(sequence(0, cast((length(letters) - 1) div {n} as int)), i -> named_struct('piece', i, 's', {_BYTES.format(n=n)})))")
    inner = {n: table(spark, sf_dir, n) for n in _uses(sql)}
    if name == "letters":  # a few files are too few tasks for what texts are cut into
        docs, tasks = inner["documents"], spark.sparkContext.defaultParallelism
        inner["documents"] = docs.repartition(tasks, "doc_id") if len(docs.inputFiles()) < tasks else docs
    return spark.sql(re.sub(r"\b(from|join)\s+(\w+)", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in inner else m[0], sql), **inner)


def oracle(sql: str) -> str:
    """The SQL with the views that it names, for DuckDB."""

    def needed(text: str) -> list[str]:
        names = [n for n in _uses(text) if n not in TABLES]
        return [x for n in names for x in [*needed(_text(n)), n]]

    names = list(dict.fromkeys(needed(sql)))
    views = ", ".join(f"{n} as ({_text(n)})" for n in names)
    sql = sql.strip()
    if not names:
        return sql
    return f"with {views}, {sql[5:]}" if sql.lower().startswith("with ") else f"with {views} {sql}"


def _text(name: str) -> str:
    sql = DUCK_BITS if name == "fingerprints" else PAIR_SQL if name == "core_pairs" else VIEWS[name]
    for n in (50, 7):
        sql = sql.replace(f"{{PIECES{n}}}", f"unnest(list_transform(range(0, (length(letters) - 1) // {n} + 1), lambda i: {{'piece': i, 's': {_STRETCH.format(n=n)}}}))")
    return sql.replace("{STR}", "varchar").replace("{G}", ",'g'")
