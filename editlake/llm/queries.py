"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editlake.llm.centroids import centroid_clusters
from editlake.llm.chat import format_chats
from editlake.llm.common import table
from editlake.llm.decontaminate import contaminated
from editlake.llm.divergence import source_divergence
from editlake.llm.exact_dedup import exact_dedup
from editlake.llm.html_main import extract_main_text
from editlake.llm.line_dedup import line_dedup
from editlake.llm.minhash import minhash_groups
from editlake.llm.mixing import curriculum_mix
from editlake.llm.quality import quality_scores
from editlake.llm.sharding import interleaved_shards
from editlake.llm.simhash import simhash_groups
from editlake.llm.substring_dedup import substring_dedup


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleaved_shards(table(spark, sf_dir, "documents"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = curriculum_mix(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "position", F.col("uses.position").alias("positions"))


def op11_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_groups(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_chat_formatting, op3_substring_dedup, op4_exact_dedup, op5_quality_classifier, op6_simhash_near_dedup, op7_html_extraction, op8_benchmark_decontamination, op9_sharding, op10_source_mixing, op11_minhash_near_dedup, op12_source_divergence, op13_centroid_clustering)}

def _centroids_sql(rounds: int = 5) -> str:
    """Each round is two steps: the nearest centroid of each vector, and the new centroids."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"a{k} as materialized (select vec_id, any_value(x) x, min({{'d': list_sum(list_transform(range(1, 65), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::bigint, 'k': k}}) m from x, c{k} group by vec_id)")
        if k < rounds:
            moved = f"select k, i, ((s - ((s % n) + n) % n) // n)::bigint v from (select m.k k, i, sum(x[i]) s, count(*)::hugeint n from a{k}, range(1, 65) r(i) group by 1, 2)"
            steps.append(f"c{k + 1} as materialized (select k, list(v order by i) c from ({moved}) group by k union all select k, c from c{k} where k not in (select m.k from a{k}))")
    return f"""
with x as materialized (
  select vec_id, list_transform(embedding, lambda e: floor(256 * e::double)::bigint) x from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda e: e is not null and isfinite(e))) = 64),
c0 as materialized (select row_number() over (order by sha256('2:' || vec_id)) - 1 k, x c from x qualify k < 40),
{", ".join(steps)}
select vec_id, m.k::int "cluster", m.d distance, (sum(m.d) over (partition by m.k))::bigint cluster_inertia, (sum(m.d) over ())::bigint inertia,
       sha256(array_to_string(c, ',')) centroid_sha256
from a{rounds} join c{rounds} on k = m.k"""


ORACLE_SQL = {
    "op1_line_dedup": r"""
with d as (select doc_id, case when coalesce(text, '') = '' then [] else string_split(text, chr(10)) end ls from documents),
l as (select doc_id, unnest(range(0, len(ls))) i, unnest(ls) line from d),
n as (select *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) words from l),
p as (select *, lead(line) over p b, lead(line, 2) over p c, lead(words) over p wb from n window p as (partition by doc_id order by i)),
w as (
  select doc_id, i, 1 size, row_number() over (partition by line order by doc_id, i) r from p where words >= 20
  union all select doc_id, i, 2, row_number() over (partition by line, b order by doc_id, i) from p where b is not null and words + wb >= 20
  union all select doc_id, i, 3, row_number() over (partition by line, b, c order by doc_id, i) from p where c is not null),
gone as (select distinct doc_id, unnest(range(i, i + size)) i from w where r > 1),
k as (
  select l.doc_id, count(*) n_lines, count(g.i) n_removed, string_agg(l.line, chr(10) order by l.i) filter (where g.i is null) kept
  from l left join gone g on l.doc_id = g.doc_id and l.i = g.i group by l.doc_id)
select d.doc_id, coalesce(n_lines, 0) n_lines, coalesce(n_removed, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256
from d left join k on d.doc_id = k.doc_id""",
    "op2_chat_formatting": """
with convs as (
  select conv_id, count(*) n,
         list({'r': role, 't': text} order by turn nulls first, role nulls first, text nulls first) l,
         string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10), ''
                    order by turn nulls first, role nulls first, text nulls first) chat
  from conversations group by conv_id),
inner_prefix as (select distinct l[1:k] l from (select l, unnest(range(1, n)) k from convs)),
one as (select min(conv_id) conv_id, count(*) n_same, l from convs group by l)
select o.conv_id, c.n n_turns, o.n_same, c.chat, length(c.chat) n_chars
from one o join convs c on o.conv_id is not distinct from c.conv_id
where not exists (select 1 from inner_prefix p where p.l = o.l)""",
    "op4_exact_dedup": r"""
with d as (
  select doc_id, length(coalesce(text, '')) n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) h from documents),
g as (
  select doc_id, h, first_value(doc_id) over w keep_id, count(*) over (partition by h) group_size, row_number() over w r
  from d window w as (partition by h order by n desc, doc_id nulls first))
select doc_id, keep_id, group_size, r = 1 kept, h text_sha256 from g""",
    "op8_benchmark_decontamination": r"""
with w as (
  select 'd' side, doc_id id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') ws from documents
  union all select 'b', item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') from benchmark),
s as (
  select distinct side, id, array_to_string(ws[i + 1:i + 5], ' ') g
  from (select *, unnest(range(0, greatest(len(ws) - 4, 1))) i from w where len(ws) > 0)),
n as (select id, count(*) n from s where side = 'b' group by id),
h as (select d.id doc_id, b.id item_id, count(*) shared from s d join s b on d.g = b.g where d.side = 'd' and b.side = 'b' group by all)
select doc_id, item_id, n n_item_shingles, shared n_shared, round(shared / n, 6) containment
from h join n on item_id = id where shared >= ceil(n * 0.8 - 1e-9)""",
    "op9_sharding": r"""
with t as (
  select list_transform(range(0, 256), lambda i: list_reduce([i] || list_transform(range(0, 8), lambda z: 0::bigint),
           lambda c, z: case when c & 1 = 1 then xor(3988292384::bigint, c >> 1) else c >> 1 end)) tab),
x as (select doc_id, source, coalesce(text, '') x from documents),
b as (
  select doc_id, source, octet_length(encode(x)) + 16 size, md5('shard|' || coalesce(cast(doc_id as varchar), '') || '|' || md5(x)) k,
         list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda h: ('0x' || h)::bigint) bytes from x),
d as (
  select doc_id, source, size, k, xor(4294967295::bigint,
           list_reduce([4294967295::bigint] || bytes, lambda c, y: xor(tab[(xor(c, y) & 255) + 1], c >> 8))) crc from b, t),
r as (
  select *, row_number() over (partition by source order by k, doc_id nulls first) - 1 r, count(*) over (partition by source) n from d),
p as (
  select *, (r + ('0x' || substr(md5('shard|' || coalesce(source, '')), 1, 8))::bigint / 4294967296.0::double) / n::double place from r),
o as (select *, row_number() over (order by place, k, doc_id nulls first, source nulls first) - 1 o, count(*) over () total from p),
s as (select *, o * 40 // total shard from o)
select doc_id, size, crc text_crc32, 'rows' law, shard::int shard, (o - (shard * total + 39) // 40)::bigint slot, null::int grown_shard from s""",
    "op10_source_mixing": r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) size,
         md5('mix|' || coalesce(cast(doc_id as varchar), '') || '|' || md5(coalesce(text, ''))) k from documents),
s as (select source, sum(size) source_size from d group by source),
p as (select *, row_number() over (order by source nulls last) - 1 place from s),
w as (select *, [3, 1, 2][place % 3 + 1] weight, [0.5, 0.0, -0.5][place % 3 + 1]::double slope, 2.0::double * source_size cap from p),
f as (
  select *, 1.5::double * sum(source_size) over () - coalesce(sum(cap) over b, 0) left_size,
         sum(weight) over () - coalesce(sum(weight) over b, 0) left_weight,
         row_number() over (order by source_size / weight, place) rk
  from w window b as (order by source_size / weight, place rows between unbounded preceding and 1 preceding)),
lv as (select min_by(left_size / left_weight, rk) lvl from f where cap * left_weight > left_size * weight),
t as (select source, source_size::bigint source_size, slope a, least(cap, coalesce(lvl * weight, cap))::double target from f, lv),
c as (
  select d.*, coalesce(sum(size) over (partition by source order by k, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint start from d),
m as (
  select doc_id, size, source_size, target, a, start, case when source_size > 0 then floor(target)::bigint // source_size else 0 end passes,
         case when source_size > 0 then least(size, greatest(0, floor(target)::bigint % source_size - start)) else 0 end part
  from c join t on c.source is not distinct from t.source),
u as (
  select *, case when size > 0 then list_transform(range(0, passes), lambda p: (p * source_size + start + size / 2.0::double) / target) else [] end
         || case when part > 0 then [(passes * source_size + start + part / 2.0::double) / target] else [] end ys from m),
v as (
  select *, list_transform(ys, lambda y: round(case when a = 0 then least(1.0::double, y)
         else (sqrt((1 - a) * (1 - a) + 4 * a * least(1.0::double, y)) - (1 - a)) / (2 * a) end, 9)) positions from u)
select doc_id, size, source_size, target, (passes * size + part)::bigint taken, positions[1] "position", positions from v""",
    "op11_minhash_near_dedup": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws
  from documents),
s as (select distinct doc_id, array_to_string(ws[i + 1:i + 2], ' ') g
      from (select *, unnest(range(0, greatest(len(ws) - 1, least(len(ws), 1)))) i from w)),
n as (select doc_id, count(*) n from s group by 1),
h as (select a.doc_id a, b.doc_id b, count(*) shared from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from h join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 80 * (x.n + y.n - shared)),
e as (select a x, b y from l union select b, a from l),
reach(id, lab) as (select doc_id, doc_id from documents union select r.id, e.y from reach r join e on e.x = r.lab),
c as (select id, min(lab) component_id from reach group by 1)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, component_id, component_id = d.doc_id kept
from documents d left join n using (doc_id) join c on c.id = d.doc_id""",
    "op12_source_divergence": r"""
with d as (
  select doc_id, coalesce(lang, '') lang, coalesce(source, '') source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') ws
  from documents),
t as (select doc_id, lang, source, unnest(ws) term from d),
kept as (select lang, term from (select distinct doc_id, lang, term from t) group by 1, 2 having count(*) >= 3),
v as (select lang, count(*) v from kept group by 1),
g as (select distinct lang, source from d),
o as (select lang, source, term, count(*) n from t join kept using (lang, term) group by 1, 2, 3),
gn as (select g.lang, g.source, coalesce(sum(o.n), 0)::hugeint total from g left join o on o.lang = g.lang and o.source = g.source group by 1, 2),
p as (
  select gn.lang, gn.source, k.term, coalesce(o.n, 0) n, (1 + 1000000000::hugeint * (coalesce(o.n, 0) + 1) // (total + v))::hugeint p
  from gn join kept k on k.lang = gn.lang join v on v.lang = gn.lang left join o on o.lang = gn.lang and o.source = gn.source and o.term = k.term),
f as (select a.lang, a.source, b.source item, sum((a.p - b.p) * (a.p - b.p) // b.p)::bigint value
      from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
pairs as (select a.lang, a.source, 'pair' part, b.source item, coalesce(value, 0)::bigint value
          from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source),
ln as (select lang, term, sum(n) n from o group by 1, 2),
q as (select lang, term, (1 + 1000000000::hugeint * (n + 1) // (sum(n) over (partition by lang) + v))::hugeint q from ln join v using (lang)),
terms as (select lang, source, 'term' part, term item, ((p - q) * (p - q) // q)::bigint value from p join q using (lang, term) where n > 0 and p > q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) rank from (from pairs union all from terms))
select lang, source, part, item, value, rank::int rank from r where part = 'pair' or rank <= 200""",
    "op13_centroid_clustering": _centroids_sql(),
}
