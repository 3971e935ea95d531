"""The op queries over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import bpe, clustering, fingerprints, html_extract, mixing, neardup, packing, prefix_trie, quality, secrets, sharding, topk, toxicity


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.with_length(html_extract.extract_main_text(pages))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", quality.is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(read(spark, sf_dir, "embeddings"), k=20, every=20)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(read(spark, sf_dir, "documents"))
    first = F.when(F.col("taken") > 0, mixing.position(F.lit(0)))
    return plan.withColumn("first_time", first).orderBy(F.col("first_time").asc_nulls_last(), "doc_id").select("doc_id", "size", "source_size", "target", "taken", "first_time")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.severity(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.col("tox_score").alias("score"), F.col("tox_severity").alias("severity"), F.col("tox_grade").alias("grade"), F.col("toxic").cast("int").alias("toxic"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.balanced_shards(read(spark, sf_dir, "documents"), 24)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(read(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    back = bpe.round_trip(docs, path, public_tokenizers.PATTERN)
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("secrets", lambda s: s["kind"].isin(*secrets.BASE_KINDS))

    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, secrets.BASE_KINDS), F.sha2(secrets.joined(base).cast("binary"), 256).alias("base_sha256"), secrets.joined(F.col("secrets")).alias("spans"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clusters(read(spark, sf_dir, "embeddings")).drop("evaluated")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read(spark, sf_dir, "conversations"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html": op1_html,
    "op2_quality": op2_quality,
    "op3_topk": op3_topk,
    "op4_mixing": op4_mixing,
    "op5_toxicity": op5_toxicity,
    "op6_sharding": op6_sharding,
    "op7_neardup": op7_neardup,
    "op8_fingerprints": op8_fingerprints,
    "op9_bpe": op9_bpe,
    "op10_secrets": op10_secrets,
    "op11_centroids": op11_centroids,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_packing": op13_packing,
}

def _centroid_sql() -> str:
    """Three rounds and the final assignment, written out."""
    steps = []
    for n in range(4):
        steps.append(f"""a{n} as (
  select vec_id, v, cluster, distance from (
    select x.vec_id, x.v, c.cluster, list_sum(list_transform(range(1, 65), lambda i: (x.v[i] - c.c[i]) * (x.v[i] - c.c[i])))::bigint as distance,
      row_number() over (partition by x.vec_id order by distance, c.cluster) as nth
    from v x cross join c{n} c
  ) where nth = 1
)""")
        if n < 3:
            steps.append(f"""m{n + 1} as (
  select cluster, list(mean order by i) as mean from (
    select cluster, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::bigint as mean
    from (select cluster, unnest(v) as x, unnest(range(64)) as i from a{n}) group by cluster, i
  ) group by cluster
),
c{n + 1} as (select c.cluster, coalesce(m.mean, c.c) as c from c{n} c left join m{n + 1} m using (cluster))""")
    return f"""with v as materialized (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
c0 as (select (row_number() over (order by sha256('1:' || vec_id)) - 1)::int as cluster, v as c from v order by sha256('1:' || vec_id) limit 16),
{", ".join(steps)}
select vec_id, cluster, distance, (sum(distance) over (partition by cluster))::bigint as cluster_inertia, (sum(distance) over ())::bigint as inertia,
  sha256(array_to_string(c.c, ',')) as centroid_sha256
from a3 join c3 c using (cluster)"""


ORACLES: dict[str, str] = {
    "op3_topk": """with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id query_id, b.vec_id, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::bigint score from v a join v b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id)
select query_id, rank::int rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s) where rank <= 20""",
    "op4_mixing": r"""with d as (select doc_id, source, coalesce(len(regexp_extract_all("text", '[^\x20\x09-\x0D]+')), 0)::bigint size, ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':17'), 1, 15))::bigint k from documents),
s as (select source, sum(size)::bigint source_size, (row_number() over (order by source nulls last) - 1) % 3 + 1 w from d group by source),
c as (select *, 3 * source_size cap, (sum(source_size) over ())::bigint total, row_number() over (order by (3 * source_size) / w, source nulls last) nth from s),
l as (select *, (total - coalesce(sum(cap) over (order by nth rows between unbounded preceding and 1 preceding), 0))::bigint / (sum(w) over (order by nth rows between current row and unbounded following))::bigint lev from c),
f as (select *, min(nth) filter (cap > lev * w) over () fo from l),
g as (select *, max(lev) filter (nth = fo) over () lv from f),
t as (select source s, w, source_size, case when fo is null or nth < fo then cap::double else lv * w end target from g),
p as (select *, (sum(size) over (partition by source order by k, doc_id, size rows unbounded preceding) - size)::bigint o, floor(target + 0.5)::bigint n from d join t on d.source is not distinct from t.s),
q as (select *, greatest(0, least(size, n - o)) + greatest(0, least(size, n - source_size - o)) + greatest(0, least(size, n - 2 * source_size - o)) taken, o / nullif(n, 0) y from p)
select doc_id, size, source_size, target, taken, case when taken > 0 then case w when 1 then (sqrt(2.25::double - 2 * y) - 1.5::double) / -1 when 2 then y else case when y >= 0.375 then 0.5::double + (sqrt(1 + 2 * (y - 0.375::double)) - 1) else sqrt(0.25::double + 2 * y) - 0.5::double end end end first_time from q""",
    "op7_neardup": r"""with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
h as (select doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end h from w),
x as materialized (select doc_id, len(h) n, unnest(h) g from h),
l as materialized (select a.doc_id a, b.doc_id b from x a join x b on a.g = b.g and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r(doc_id, reach) as (select doc_id, doc_id from h union select r.doc_id, l.b from r join l on l.a = r.reach),
c as (select doc_id, min(reach) component_id from r group by doc_id)
select doc_id, len(h)::bigint n_shingles, component_id, doc_id = component_id kept from h join c using (doc_id)""",
    "op11_centroids": _centroid_sql(),
    "op12_prefix_trie": r"""with recursive r as (
  select conv_id, coalesce("role", '') as role, coalesce("text", '') as content,
    row_number() over (partition by conv_id order by turn nulls first, md5(strlen(coalesce("role", '')) || ':' || coalesce("role", '') || coalesce("text", ''))) as pos
  from conversations where conv_id is not null
),
h as (
  select conv_id, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda c: ord(c)::bigint)),
    lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: xor(x >> 1, (x & 1) * 3988292384))) as inverted
  from (select distinct conv_id from r)
),
taken as (select conv_id, xor(inverted, 4294967295) % 4 as h from h),
parts as (
  select t.conv_id, 0 as own, f.pos, f.role, f.content from taken t join r f on f.conv_id = t.conv_id - t.conv_id % 20 and f.pos <= t.h
  union all
  select r.conv_id, 1, r.pos, r.role, r.content from r join taken t using (conv_id) where r.pos > t.h
),
whole as (
  select t.conv_id, coalesce(list({'role': p.role, 'content': p.content} order by p.own, p.pos) filter (p.conv_id is not null), []) as turns
  from taken t left join parts p using (conv_id) group by t.conv_id
),
prefixes as (select w.conv_id, d.depth, w.turns[1:d.depth] as node, len(w.turns) = d.depth as ends from whole w, unnest(range(len(w.turns) + 1)) as d(depth)),
nodes as (
  select node, depth, min(conv_id) as conv_id, count(*) as n_convs,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '')) as ends_sha256,
    case when depth = 0 then 0 else len(regexp_extract_all(any_value(node[depth].content), '[^\x20\x09-\x0D]+')) end as words
  from prefixes group by node, depth
),
below as (select up.node, low.n_convs, low.words, not exists (select 1 from nodes c where c.depth = low.depth + 1 and c.node[1:low.depth] = low.node) as leaf
  from nodes up join nodes low on low.depth >= up.depth and low.node[1:up.depth] = up.node),
sums as (select node, count(*) filter (leaf) as n_leaves, sum((n_convs - 1) * words)::bigint as saved_tokens from below group by node),
children as (select node[1:depth - 1] as node, count(*) as n_children from nodes where depth > 0 group by 1)
select n.conv_id, n.depth::bigint as depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(c.n_children, 0) as n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
from nodes n join sums s on s.node = n.node left join children c on c.node = n.node left join nodes p on n.depth > 0 and p.depth = n.depth - 1 and p.node = n.node[1:n.depth - 1]""",
}
"""The other operators learn, parse, encode or hash in ways that SQL can't express; tests/llm compares them with brute force."""
