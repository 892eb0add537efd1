"""Registered queries: balanced sampling, example documents, kNN retrieval, goal texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import context as ctx
from ..operators import ivf as IVF
from ..operators import knn as KN
from ..operators import sampling as SMP
from ..sources import fixtures as FX
from .registry import register

QUOTA = 20
EXAMPLE_QUOTA = 5
K = S.FEWSHOT_EXAMPLES


# ----------------------------------------------------------------------------- balanced sampling

@register("balanced_sample", f"""
select distinct pos from (
  select pos, domain, row_number() over (partition by domain order by pos) as rn from v_goal_domains) x
where rn <= {QUOTA}""")
def q_balanced_sample(spark, d):
    return SMP.balanced_sample(FX.v_goal_domains(spark, d), QUOTA)


@register("domain_counts", f"""
with s as (select distinct pos from (select pos, row_number() over (partition by domain order by pos) as rn from v_goal_domains) x where rn <= {QUOTA})
select g.domain, count(*) as n from v_goal_domains g join s using (pos) group by g.domain""")
def q_domain_counts(spark, d):
    g = FX.v_goal_domains(spark, d)
    return SMP.domain_counts(g, SMP.balanced_sample(g, QUOTA), g.select("domain"))


def _example_docs(spark, d):
    splits = FX.v_splits(spark, d).filter(F.col("split") == "train").select("conv_id", "split_pos")
    goals = FX.v_conv_goals(spark, d).join(splits, "conv_id")
    picked = SMP.balanced_sample(goals, EXAMPLE_QUOTA, key="conv_id", order="split_pos")
    turns = FX.v_turns(spark, d).join(picked, "conv_id", "left_semi")
    # full-context length and the last-k context text come from one window pass
    from pyspark.sql import Window
    earlier = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("n_ctx", F.count(F.lit(1)).over(earlier).cast("bigint"))
    docs = ctx.context_strings(turns, S.INDEX_CONTEXT_TURNS)
    return docs.select("conv_id", "turn", F.col("context_text").alias("doc_text"), "n_ctx")


@register("example_docs", f"""
with g as (select c.conv_id, c.domain, s.split_pos from v_conv_goals c join v_splits s using (conv_id) where s.split = 'train'),
picked as (select distinct conv_id from (select conv_id, row_number() over (partition by domain order by split_pos, conv_id) as rn from g) x where rn <= {EXAMPLE_QUOTA}),
t as (select * from v_turns where conv_id in (select conv_id from picked)),
c as (select conv_id, turn, speaker,
  coalesce(array_to_string(list(case speaker when 'USER' then '{S.USER_PREFIX}' else '{S.SYSTEM_PREFIX}' end || ' ' || utterance)
    over (partition by conv_id order by turn rows between {S.INDEX_CONTEXT_TURNS} preceding and 1 preceding), ' '), '') as doc_text,
  count(*) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as n_ctx
  from t)
select conv_id, turn, doc_text, n_ctx from c where speaker <> 'USER'""")
def q_example_docs(spark, d):
    return _example_docs(spark, d)


# ----------------------------------------------------------------------------- kNN

_KNN_SQL = f"""
with e as (select vec_id, label, cast(embedding as double[]) as v from embeddings),
d as (select a.vec_id, b.vec_id as nn_vec_id, b.label,
        list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as dist
      from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0),
r as (select vec_id, nn_vec_id, label, dist, row_number() over (partition by vec_id order by dist, nn_vec_id) as rank from d)
"""


def _knn(spark, d):
    """The query set is every vector whose id is divisible by 20, searched against all vectors."""
    e = FX.table(spark, d, "embeddings")
    return KN.knn_exact(e.filter("vec_id % 20 = 0"), e, K, qid="vec_id", cid="vec_id", vec="embedding", exclude_self=True)


@register("knn_topk", _KNN_SQL + f"select vec_id, rank, nn_vec_id, round(dist, 6) as dist from r where rank <= {K}")
def q_knn_topk(spark, d):
    return _knn(spark, d).select("vec_id", "rank", "nn_vec_id", F.round("dist", 6).alias("dist"))


@register("fewshot_examples", _KNN_SQL + f"""
select vec_id, string_agg(cast(nn_vec_id as string) || ':' || cast(label as string), ';' order by rank) as examples
from r where rank <= {K} group by vec_id""")
def q_fewshot_examples(spark, d):
    e = FX.table(spark, d, "embeddings")
    return KN.examples_text(_knn(spark, d), e, "vec_id", "nn_vec_id", ["label"])


@register("knn_approx")
def q_knn_approx(spark, d):
    """The same queries over an index of inverted lists, with as many probes as a sample needs for its recall."""
    e = FX.table(spark, d, "embeddings")
    index = IVF.build_index(e, IVF.train_centroids(e))
    probes = IVF.probes_for(e, index, K)
    found = IVF.search(e.filter("vec_id % 20 = 0"), index, K, probes, exclude_self=True)
    return found.select("vec_id", "rank", "nn_vec_id", F.round("dist", 6).alias("dist"))


# ----------------------------------------------------------------------------- goal texts

def _goal_desc(spark, d):
    """Goal description per document: the language domain has one item, the source domain
    one item per line of the whole text."""
    part = lambda name, col, items: F.struct(F.concat(F.lit(f"{name}:"), col).alias("domain"), items.alias("items"))
    return FX.table(spark, d, "documents").select(F.col("doc_id").alias("pos"), F.array(
        part("lang", F.col("lang"), F.array("lang")), part("source", F.col("source"), F.split("text", "\n"))).alias("desc"))


@register("goal_min_turns", """
select doc_id as pos, cast(2 * (1 + len(string_split(text, chr(10)))) as bigint) as min_turns from documents""")
def q_goal_min_turns(spark, d):
    from ..operators.sessions import goal_min_turns
    return goal_min_turns(_goal_desc(spark, d), "pos")


@register("goal_list", """
select doc_id as pos, '<ol><li>' || lang || '</li><li>' || replace(text, chr(10), '<br>') || '</li></ol>' as html from documents""")
def q_goal_list(spark, d):
    from ..operators.sessions import goal_list
    return goal_list(_goal_desc(spark, d), "pos")
