"""The registered queries of the network engine and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import normal, uniform
from ..operators import algebra, irf, netstats, posterior, predict, rank, simulate, suffstats
from ..operators import fit as fits
from ..sources import tensor
from ..streaming import ingest
from . import fixtures as fx
from .fixtures import sn, sql, su

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(keys: str = "", doubles: str = "", body: str | None = None, *views: str):
    """Registers a query; its doubles are rounded to 6 places and its columns put in the twin's order."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            if not keys and not doubles:
                return df
            return df.select(*keys.split(), *[(F.round(F.col(d).cast("double"), 6) + 0.0).alias(d) for d in doubles.split()])

        QUERIES[f.__name__] = run
        if body:
            SQL[f.__name__] = sql(keys, doubles, body, *views)
        return run

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# Views over the test tables


def net(spark: SparkSession, d: str) -> DataFrame:
    return tensor.network(spark, d)


def z(spark: SparkSession, d: str) -> DataFrame:
    return rank.standardised(net(spark, d))


def mean_op(spark: SparkSession, which: str) -> DataFrame:
    return fx.op(spark).groupBy("t", "i", "k").agg(F.avg(which).alias("v"))


def mean_theta(spark: SparkSession) -> DataFrame:
    return fx.theta(spark).groupBy("i", "j", "rel", "t").agg(F.avg("theta").alias("y"))


# Sources and shape


@query("i j rel t", "y", "SELECT * FROM trade", "trade")
def tensor_build(spark, d):
    return tensor.trade(spark, d)


@query("i j rel t", "y", "SELECT * FROM net", "net")
def tensor_dense(spark, d):
    return net(spark, d)


@query("i j rel t", "y", "SELECT i,j,'1' AS rel,t,sum(y) y FROM trade GROUP BY ALL", "trade")
def tensor_3d_promote(spark, d):
    return tensor.to_tensor(tensor.trade(spark, d), "i", "j", F.sum("y"), None, "t")


@query("n_missing n_infinite constant n_obs", "variance", "SELECT count_if(y IS NULL)::BIGINT n_missing, count_if(isinf(y))::BIGINT n_infinite, (min(y)=max(y))::INT constant, count(*) n_obs, var_samp(y) variance FROM net", "net")
def edge_case_report(spark, d):
    return tensor.edge_report(net(spark, d))


# Tensor algebra


@query("row col", "y", "SELECT i AS row, (1+(j-1)+5*(rel-1)+10*(t-1))::BIGINT col, y FROM thm", "thm")
def mode_unfold(spark, d):
    return algebra.unfold(mean_theta(spark), "i", {"i": fx.ACTORS, "j": fx.ACTORS, "rel": fx.RELS, "t": fx.TIMES})


@query("i j rel t", "y", "SELECT m.i,x.j,x.rel,x.t,sum(m.v*x.y) y FROM thm x JOIN (SELECT i,k,v FROM am WHERE t=1) m ON m.k=x.i GROUP BY ALL", "thm", "am")
def amprod(spark, d):
    return algebra.mode_product(mean_theta(spark), mean_op(spark, "a").where("t = 1").drop("t"), "i")


@query("i j rel t", "y", "SELECT m.i,n.i AS j,x.rel,x.t,sum(m.v*x.y*n.v) y FROM thm x JOIN am m ON m.k=x.i AND m.t=x.t JOIN bm n ON n.k=x.j AND n.t=x.t GROUP BY ALL", "thm", "am", "bm")
def tprod_bilinear(spark, d):
    return algebra.bilinear(mean_theta(spark), mean_op(spark, "a"), mean_op(spark, "b"), "y", ["t"])


@query("t i k", "v", "SELECT m.t,m.i,n.k,sum(m.v*n.v) v FROM am m JOIN bm n ON m.t=n.t AND m.k=n.i GROUP BY ALL", "am", "bm")
def matmul(spark, d):
    return algebra.matmul(mean_op(spark, "a"), mean_op(spark, "b"), ["t"])


@query("t i k", "v", "SELECT m.t,m.k AS i,n.k,sum(m.v*n.v) v FROM am m JOIN bm n ON m.t=n.t AND m.i=n.i GROUP BY ALL", "am", "bm")
def precomputed_products(spark, d):
    return algebra.matmul(algebra.transpose(mean_op(spark, "a")), mean_op(spark, "b"), ["t"])


@query("i k", "v", "SELECT ((m.i-1)*5+n.i)::INT i, ((m.k-1)*5+n.k)::INT k, m.v*n.v v FROM am m, bm n WHERE m.t=1 AND n.t=1", "am", "bm")
def kron_small(spark, d):
    return algebra.kronecker(mean_op(spark, "a").where("t = 1").drop("t"), mean_op(spark, "b").where("t = 1").drop("t"), 5, 5)


@query("i k", "v", "SELECT x.k AS i, w.k AS k, sum(x.v*y.v*w.v) v FROM am x JOIN bm y ON y.i=x.i JOIN am w ON w.i=y.k WHERE x.t=1 AND y.t=1 AND w.t=1 GROUP BY ALL", "am", "bm")
def quad_form(spark, d):
    return algebra.quadratic(mean_op(spark, "a").where("t = 1").drop("t"), mean_op(spark, "b").where("t = 1").drop("t"))


@query("t i k", "v", "SELECT * FROM am WHERE i<>k", "am")
def drop_diag(spark, d):
    return algebra.drop_diagonal(mean_op(spark, "a"))


@query("i k", "v", "SELECT i, i AS k, 2.5::DOUBLE v FROM (SELECT range::INT i FROM range(1,101))")
def diag_matrix(spark, d):
    return algebra.diagonal(fx.ids(spark, "i", 100), F.lit(2.5))


@query("r i k", "v", "SELECT x.r,x.i,y.i AS k,x.u*y.u v FROM uf x JOIN uf y ON x.r=y.r", "uf")
def outer_products(spark, d):
    u = fx.u_factor(spark)
    return u.join(u.select("r", F.col("i").alias("k"), F.col("u").alias("w")), "r").select("r", "i", "k", (F.col("u") * F.col("w")).alias("v"))


@query("t i k", "v", "SELECT a.t,x.i,y.i AS k,sum(a.a*x.u*y.u) v FROM uf x JOIN uf y ON x.r=y.r JOIN alpha a ON a.r=x.r GROUP BY ALL", "uf", "alpha")
def lowrank_A(spark, d):
    return algebra.lowrank(fx.u_factor(spark), fx.alpha(spark))


@query("i j rel t", "y", "SELECT m.i,n.i AS j,x.rel,x.t,any_value(b.mu)+sum(m.v*(x.y-c.mu)*n.v) y FROM thm x JOIN base c ON c.i=x.i AND c.j=x.j AND c.rel=x.rel JOIN (SELECT * FROM bm WHERE t=1) m ON m.k=x.i JOIN (SELECT * FROM bm WHERE t=1) n ON n.k=x.j JOIN base b ON b.i=m.i AND b.j=n.i AND b.rel=x.rel GROUP BY ALL", "thm", "base", "bm")
def theta_static(spark, d):
    m, b = fx.base(spark), mean_op(spark, "b").where("t = 1").drop("t")
    dev = mean_theta(spark).join(m, ["i", "j", "rel"]).select("i", "j", "rel", "t", (F.col("y") - F.col("mu")).alias("y"))
    return algebra.bilinear(dev, b, b).join(m, ["i", "j", "rel"]).select("i", "j", "rel", "t", (F.col("y") + F.col("mu")).alias("y"))


@query("i j rel t", "y", "SELECT m.i,n.i AS j,x.rel,x.t,sum(m.v*x.y*n.v)*any_value(1+0.1::DOUBLE*x.rel) y FROM thm x JOIN (SELECT * FROM am WHERE t=1) m ON m.k=x.i JOIN (SELECT * FROM bm WHERE t=1) n ON n.k=x.j GROUP BY ALL", "thm", "am", "bm")
def xb_tensor(spark, d):
    out = algebra.bilinear(mean_theta(spark), mean_op(spark, "a").where("t = 1").drop("t"), mean_op(spark, "b").where("t = 1").drop("t"))
    return out.withColumn("y", F.col("y") * (1 + 0.1 * F.col("rel")))


@query("draw", "lse", "SELECT draw, max(theta)+ln(sum(exp(theta-top))) lse FROM (SELECT draw,theta,max(theta) OVER (PARTITION BY draw) top FROM theta) GROUP BY draw", "theta")
def log_sum_exp(spark, d):
    return algebra.log_sum_exp(fx.theta(spark), ["draw"], "theta")


# Ranks and ordinal values

RANKED = "SELECT i,j,rel,t,y,(rank() OVER w + (count(*) OVER (PARTITION BY rel,y)-1)/2.0::DOUBLE)/(count(*) OVER (PARTITION BY rel)+1) p FROM net WHERE y IS NOT NULL WINDOW w AS (PARTITION BY rel ORDER BY y)"


@query("i j rel t", "p", RANKED, "net")
def zscores_avg_rank(spark, d):
    table = rank.rank_table(net(spark, d)).select("rel", "y", (F.col("rank") / (F.col("total") + 1)).alias("p"))
    return net(spark, d).join(table, ["rel", "y"])


@query("i j rel t", "z", "SELECT * FROM z", "z")
def zscore_standard(spark, d):
    return z(spark, d)


@query("rel n", "y", "SELECT rel,y,count(*) n FROM net GROUP BY ALL", "net")
def rank_level_index(spark, d):
    return rank.level_index(net(spark, d))


@query("rel t n", "y", "SELECT rel,t,y,count(*) n FROM net GROUP BY ALL", "net")
def rank_level_time_index(spark, d):
    return rank.level_index(net(spark, d), ["rel", "t"])


ORD = "(SELECT n.i,n.j,n.rel,n.t,n.z,CASE WHEN n.y IS NOT NULL THEN 1+(n.y>c1)::INT+(n.y>c2)::INT+(n.y>c3)::INT+(n.y>c4)::INT END::DOUBLE y FROM z n JOIN (SELECT rel,quantile_cont(y,0.2) c1,quantile_cont(y,0.4) c2,quantile_cont(y,0.6) c3,quantile_cont(y,0.8) c4 FROM net GROUP BY rel) USING (rel))"


def ordinal(spark, d):
    return rank.discretise(z(spark, d))


@query("i j rel t", "y", f"SELECT * FROM {ORD}", "z")
def ordinal_levels(spark, d):
    return ordinal(spark, d)


def bounds_sql(keys: str) -> str:
    return f"SELECT {keys},y,lag(hi) OVER w lower_bound, lead(lo) OVER w upper_bound FROM (SELECT {keys},y,max(z) hi,min(z) lo FROM {ORD} WHERE y IS NOT NULL GROUP BY ALL) WINDOW w AS (PARTITION BY {keys} ORDER BY y)"


@query("rel", "y lower_bound upper_bound", bounds_sql("rel"), "z")
def rank_bounds_relation(spark, d):
    return rank.level_bounds(ordinal(spark, d))


@query("rel t", "y lower_bound upper_bound", bounds_sql("rel,t"), "z")
def rank_bounds_slice(spark, d):
    return rank.level_bounds(ordinal(spark, d), ["rel", "t"])


@query("rel levels approximate", "", "SELECT rel,count(DISTINCT y) levels,(count(DISTINCT y)>10)::INT approximate FROM net GROUP BY rel", "net")
def level_count_rule(spark, d):
    return rank.many_levels(net(spark, d))


@query("i j rel t", "z", f"SELECT n.i,n.j,n.rel,n.t,0.1::DOUBLE*(coalesce((n.y-s.lo)/nullif(s.hi-s.lo,0),0.5::DOUBLE)-0.5::DOUBLE)+{sn('approx', 'n.i', 'n.j', 'n.rel', 'n.t')} z FROM {ORD} n JOIN (SELECT rel,t,min(y) lo,max(y) hi FROM {ORD} GROUP BY ALL) s USING (rel,t)", "z")
def gaussian_approx_z(spark, d):
    return rank.approximate_latent(ordinal(spark, d).withColumn("ez", F.lit(0.0)))


@query("i j rel t", "z")
def truncnorm_z(spark, d):
    rows = ordinal(spark, d).join(rank.level_bounds(ordinal(spark, d)), ["rel", "y"])
    return rows.withColumn("z", rank.truncated_normal(F.lit(0.0), F.lit(1.0), F.col("lower_bound"), F.col("upper_bound"), "trunc", "i", "j", "rel", "t"))


# Sufficient statistics


@query("i j rel", "mu", "SELECT i,j,rel,avg(z) mu FROM z GROUP BY ALL", "z")
def m_static(spark, d):
    return suffstats.baseline(z(spark, d))


@query("i j rel n", "mean var", "SELECT i,j,rel,count(z) n,coalesce(sum(z),0)/(count(z)+0.5::DOUBLE) mean,1.0::DOUBLE/(count(z)+0.5::DOUBLE) AS var FROM z GROUP BY ALL", "z")
def m_posterior_moments(spark, d):
    return suffstats.baseline_posterior(z(spark, d), 2.0)


@query("i j rel", "mu", f"SELECT i,j,rel,mean+sqrt(v)*{sn('m', 'i', 'j', 'rel')} mu FROM (SELECT i,j,rel,coalesce(sum(z),0)/(count(z)+0.5::DOUBLE) mean,1.0::DOUBLE/(count(z)+0.5::DOUBLE) v FROM z GROUP BY ALL)", "z")
def m_draw(spark, d):
    return suffstats.baseline_posterior(z(spark, d), 2.0).select("i", "j", "rel", (F.col("mean") + F.sqrt("var") * normal("m", "i", "j", "rel")).alias("mu"))


@query("", "ss", "SELECT sum((a-1)*(a-1)) ss FROM op WHERE i=k", "op")
def diag_sse(spark, d):
    return suffstats.identity_deviation(fx.op(spark).where("i = k"), value="a")


@query("draw", "ss", "SELECT draw,sum((a-(i=k)::INT)*(a-(i=k)::INT)) ss FROM op WHERE t>=2 GROUP BY draw", "op")
def deviation_from_identity(spark, d):
    return suffstats.identity_deviation(fx.op(spark).where("t >= 2"), ["draw"], "a")


@query("n", "rss", "SELECT count(z) n,sum((z-mu)*(z-mu)) rss FROM z JOIN (SELECT i,j,rel,avg(z) mu FROM z GROUP BY ALL) USING (i,j,rel)", "z")
def rss_static(spark, d):
    return suffstats.residual_squares(z(spark, d), suffstats.baseline(z(spark, d)))


@query("n", "rss", "SELECT count(*) n,sum((y-theta-mu)*(y-theta-mu)) rss FROM theta JOIN thm USING (i,j,rel,t) JOIN base USING (i,j,rel)", "thm", "base")
def obs_rss(spark, d):
    return suffstats.residual_squares(fx.theta(spark).join(mean_theta(spark), ["i", "j", "rel", "t"]), fx.base(spark), "y", "theta")


BRSS = "SELECT count(*) n,sum((x.y-p.y)*(x.y-p.y)) rss FROM thm x JOIN (SELECT m.i,n.i AS j,x.rel,x.t+1 t,sum(m.v*x.y*n.v) y FROM thm x JOIN am m ON m.k=x.i AND m.t=x.t+1 JOIN bm n ON n.k=x.j AND n.t=x.t+1 GROUP BY ALL) p USING (i,j,rel,t)"


@query("n", "rss", BRSS, "thm", "am", "bm")
def bilinear_rss(spark, d):
    return suffstats.bilinear_squares(mean_theta(spark), mean_op(spark, "a"), mean_op(spark, "b"))


@query("n", "rss", BRSS.replace("JOIN am m", "JOIN (SELECT a.t,x.i,y.i AS k,sum(a.a*x.u*y.u) v FROM uf x JOIN uf y ON x.r=y.r JOIN alpha a ON a.r=x.r GROUP BY ALL) m"), "thm", "bm", "uf", "alpha")
def lowrank_rss(spark, d):
    return suffstats.bilinear_squares(mean_theta(spark), algebra.lowrank(fx.u_factor(spark), fx.alpha(spark)), mean_op(spark, "b"))


@query("", "ss", "SELECT sum((v-b)*(v-b)) ss FROM (SELECT v,lag(v) OVER (PARTITION BY i,k ORDER BY t) b FROM am)", "am")
def innovation_ss_rw(spark, d):
    return suffstats.innovation_squares(mean_op(spark, "a"))


@query("", "ss", "SELECT sum(e*e) ss FROM (SELECT v-0.9::DOUBLE*lag(v) OVER (PARTITION BY i,k ORDER BY t)-(i=k)::INT*(1-0.9::DOUBLE) e FROM am)", "am")
def innovation_ss_ar1(spark, d):
    return suffstats.innovation_squares(mean_op(spark, "a"), 0.9)


@query("", "shape rate", f"SELECT (2+n)/2.0::DOUBLE shape,2+rss/2 rate FROM ({BRSS})", "thm", "am", "bm")
def variance_shape_rate(spark, d):
    return suffstats.bilinear_squares(mean_theta(spark), mean_op(spark, "a"), mean_op(spark, "b")).select(((2 + F.col("n")) / F.lit(2.0)).alias("shape"), (2 + F.col("rss") / 2).alias("rate"))


@query("draw", "value", f"SELECT draw,least(greatest(2/{fx.sgamma('5.0::DOUBLE', 'ig', 'draw')},1e-8::DOUBLE),1e8::DOUBLE) AS value FROM {fx.sr('draw', 200)}")
def inv_gamma_draw(spark, d):
    return fx.ids(spark, "draw", 200).select("draw", suffstats.inverse_gamma(F.lit(5.0), F.lit(2.0), "ig", "draw").alias("value"))


@query("draw k", "p", f"SELECT draw,k,g/sum(g) OVER (PARTITION BY draw) p FROM (SELECT draw,k,{fx.sgamma('(2.0::DOUBLE+k)', 'dirichlet', 'draw', 'k')} g FROM {fx.sr('draw', 50)},{fx.sr('k', 3)})")
def dirichlet_draw(spark, d):
    from pyspark.sql import Window

    from ..functions.rng import gamma

    g = fx.grid(spark, draw=50, k=3).withColumn("g", gamma(F.lit(2.0) + F.col("k"), "dirichlet", "draw", "k"))
    return g.select("draw", "k", (F.col("g") / F.sum("g").over(Window.partitionBy("draw"))).alias("p"))


TRANS = 'SELECT f."from",g."to",coalesce(n,0)::BIGINT n FROM (SELECT range::INT "from" FROM range(1,4)) f CROSS JOIN (SELECT range::INT "to" FROM range(1,4)) g LEFT JOIN (SELECT b AS "from",regime AS "to",count(*) n FROM (SELECT regime,lag(regime) OVER (PARTITION BY draw ORDER BY t) b FROM state) WHERE b IS NOT NULL GROUP BY ALL) c ON c."from"=f."from" AND c."to"=g."to"'


@query("src dst n", "", f'SELECT "from" AS src,"to" AS dst,n FROM ({TRANS})', "state")
def transition_counts(spark, d):
    return suffstats.transitions(fx.state(spark), fx.REGIMES).withColumnsRenamed({"from": "src", "to": "dst"})


@query("src dst", "p", f'SELECT "from" AS src,"to" AS dst,n/sum(n) OVER (PARTITION BY "from") p FROM ({TRANS})', "state")
def transition_matrix(spark, d):
    from pyspark.sql import Window

    out = suffstats.transitions(fx.state(spark), fx.REGIMES)
    return out.select(F.col("from").alias("src"), F.col("to").alias("dst"), (F.col("n") / F.sum("n").over(Window.partitionBy("from"))).alias("p"))


@query("draw regime", "before now", "SELECT s.draw,s.regime,avg(b.y) AS before,avg(x.y) AS now FROM state s JOIN thm x ON x.t=s.t JOIN thm b ON b.t=s.t-1 AND b.i=x.i AND b.j=x.j AND b.rel=x.rel GROUP BY ALL", "thm", "state")
def regime_pairs(spark, d):
    pairs = algebra.lag_pair(mean_theta(spark))
    return fx.state(spark).join(pairs, "t").groupBy("draw", "regime").agg(F.avg("before").alias("before"), F.avg("y").alias("now"))


@query("draw t i k", "a b", "SELECT s.draw,s.t,o.i,o.k,o.a,o.b FROM state s JOIN op o ON o.draw=s.draw AND o.t=s.regime", "op", "state")
def regime_arrays(spark, d):
    by = fx.op(spark).where(F.col("t") <= fx.REGIMES).select("draw", F.col("t").alias("regime"), "i", "k", "a", "b")
    return fx.state(spark).join(by, ["draw", "regime"])


@query("t regime", "prob", "SELECT g.t,g.regime,coalesce(n,0)/20.0::DOUBLE prob FROM (SELECT t,regime FROM (SELECT DISTINCT t FROM state),(SELECT range::INT regime FROM range(1,4))) g LEFT JOIN (SELECT t,regime,count(*) n FROM state GROUP BY ALL) USING (t,regime)", "state")
def regime_probs(spark, d):
    return posterior.regime_probs(fx.state(spark), fx.REGIMES)


@query("event_type following n", "", "SELECT event_type,following,count(*) n FROM (SELECT event_type,lead(event_type) OVER (PARTITION BY user_id ORDER BY ts,event_id) following FROM events) WHERE following IS NOT NULL GROUP BY ALL")
def ev_transitions(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = spark.read.parquet(f"{d}/events.parquet").select("event_type", F.lead("event_type").over(w).alias("following"))
    return e.where(F.col("following").isNotNull()).groupBy("event_type", "following").agg(F.count("*").alias("n"))


# State space


@query("t p q", "g", "SELECT x.t,x.i p,w.i q,sum(x.y*w.y) g FROM thm x JOIN thm w ON x.t=w.t AND x.rel=w.rel AND x.j=w.j GROUP BY ALL", "thm")
def gram_A(spark, d):
    return suffstats.gram(mean_theta(spark))


@query("t p q", "g", "SELECT x.t,x.j p,w.j q,sum(x.y*w.y) g FROM thm x JOIN thm w ON x.t=w.t AND x.rel=w.rel AND x.i=w.i GROUP BY ALL", "thm")
def gram_B(spark, d):
    return suffstats.gram(mean_theta(spark), along="i")


@query("p q", "g", "SELECT x.i p,w.i q,sum(x.mu*w.mu) g FROM base x JOIN base w ON x.rel=w.rel AND x.j=w.j GROUP BY ALL", "base")
def gram_static_B(spark, d):
    return suffstats.gram(fx.base(spark).withColumnRenamed("mu", "y"), keys=())


DESIGN = "SELECT x.t+1 t,x.rel,u.r,u.i,n.i AS j,u.u*sum(w.u*x.y*n.v) x FROM thm x JOIN bm n ON n.k=x.j AND n.t=x.t+1 JOIN uf w ON w.i=x.i JOIN uf u ON u.r=w.r GROUP BY x.t,x.rel,u.r,u.i,u.u,n.i"


def design(spark):
    past = mean_theta(spark).withColumn("t", F.col("t") + 1)
    right = algebra.mode_product(past, mean_op(spark, "b"), "j", "y", ["t"])
    u = fx.u_factor(spark)
    inner = right.join(u, "i").groupBy("t", "rel", "r", "j").agg(F.sum(F.col("u") * F.col("y")).alias("x"))
    return inner.join(u, "r").select("t", "rel", "r", "i", "j", (F.col("u") * F.col("x")).alias("x"))


@query("t rel r i j", "x", DESIGN, "thm", "bm", "uf")
def alpha_design(spark, d):
    return design(spark)


@query("t r s", "g", f"SELECT a.t,a.r,b.r AS s,sum(a.x*b.x) g FROM ({DESIGN}) a JOIN ({DESIGN}) b ON a.t=b.t AND a.rel=b.rel AND a.i=b.i AND a.j=b.j GROUP BY ALL", "thm", "bm", "uf")
def gram_alpha(spark, d):
    x = design(spark)
    y = x.select("t", "rel", "i", "j", F.col("r").alias("s"), F.col("x").alias("w"))
    return x.join(y, ["t", "rel", "i", "j"]).groupBy("t", "r", "s").agg(F.sum(F.col("x") * F.col("w")).alias("g"))


@query("place", "y", "SELECT ((t-2)*2+rel-1)*25+(j-1)*5+i AS place,y-mu y FROM thm JOIN base USING (i,j,rel) WHERE t>1", "thm", "base")
def alpha_response(spark, d):
    return suffstats.response_vector(mean_theta(spark), fx.base(spark), fx.RELS, fx.ACTORS)


EMIT = "SELECT x.t,p.regime,-0.5::DOUBLE*sum((x.y-p.y)*(x.y-p.y))-12.5::DOUBLE*ln(2*pi()) ll FROM (SELECT i,j,t,avg(y) y FROM thm GROUP BY ALL) x JOIN (SELECT m.i,n.i AS j,s.t,m.t AS regime,sum(m.v*s.y*n.v) y FROM (SELECT i,j,t+1 t,avg(y) y FROM thm GROUP BY ALL) s JOIN am m ON m.k=s.i AND m.t<=3 JOIN bm n ON n.k=s.j AND n.t=m.t GROUP BY ALL) p USING (i,j,t) GROUP BY ALL"


def emissions(spark):
    avg = mean_theta(spark).groupBy("i", "j", "t").agg(F.avg("y").alias("y"))
    past = avg.withColumn("t", F.col("t") + 1).join(fx.ids(spark, "regime", fx.REGIMES))
    a, b = (mean_op(spark, w).where(F.col("t") <= fx.REGIMES).withColumnRenamed("t", "regime") for w in "ab")
    told = algebra.bilinear(past, a, b, "y", ["regime"]).withColumnRenamed("y", "told")
    e = F.col("y") - F.col("told")
    return avg.join(told, ["i", "j", "t"]).groupBy("t", "regime").agg((-0.5 * F.sum(e * e) - F.count("*") / 2 * F.log(2 * F.pi())).alias("ll"))


@query("t regime", "ll", EMIT, "thm", "am", "bm")
def hmm_emission_ll(spark, d):
    return emissions(spark)


def forward_fold(spark, beam: int = 0):
    """The forward recursion as a fold over one array of emissions a chain; states are few. With a beam, each step goes on from the best state among so many."""
    stay, move = 0.8, 0.1
    lists = emissions(spark).groupBy("t").agg(F.array_sort(F.collect_list(F.struct("regime", "ll"))).alias("e")).agg(F.array_sort(F.collect_list(F.struct("t", "e"))).alias("steps"))

    def norm(x):
        top = F.array_max(x)
        return F.transform(x, lambda v: v - top - F.log(F.aggregate(x, F.lit(0.0), lambda s, w: s + F.exp(w - top))))

    def step(acc, at):
        def state(e, k):
            now = acc["now"]
            worst = F.element_at(F.array_sort(now), -beam) if beam else None
            terms = F.transform(now, lambda v, i: v + F.log(F.when(i == k, stay).otherwise(move)))
            if beam:
                terms = F.transform(F.filter(F.arrays_zip(now.alias("v"), terms.alias("w")), lambda x: x["v"] >= worst), lambda x: x["w"])
            top = F.array_max(terms)
            best = top if beam else top + F.log(F.aggregate(terms, F.lit(0.0), lambda s, w: s + F.exp(w - top)))
            return e["ll"] + best

        now = norm(F.transform(at["e"], state))
        return F.struct(now.alias("now"), F.concat(acc["out"], F.array(F.struct(at["t"].alias("t"), now.alias("alpha")))).alias("out"))

    start = F.struct(F.array(*[F.lit(0.0)] * fx.REGIMES).alias("now"), F.expr("cast(array() as array<struct<t:int,alpha:array<double>>>)").alias("out"))
    return lists.select(F.explode(F.aggregate("steps", start, step, lambda s: s["out"])).alias("x")).select("x.t", F.posexplode("x.alpha").alias("k", "value")).select("t", (F.col("k") + 1).cast("int").alias("regime"), F.col("value").alias("alpha"))


def forward_sql(inner: str) -> str:
    return f"""SELECT t,unnest([1,2,3])::INT regime,unnest(a) alpha FROM (WITH RECURSIVE e AS MATERIALIZED (SELECT t,list(ll ORDER BY regime) l FROM ({EMIT}) GROUP BY t), f AS (
SELECT 1 t,[0.0::DOUBLE,0.0::DOUBLE,0.0::DOUBLE] a UNION ALL SELECT q.t,list_transform(q.x, lambda v: v-list_max(q.x)-ln(list_sum(list_transform(q.x, lambda w: exp(w-list_max(q.x)))))) a FROM (
SELECT e.t,[e.l[k]+{inner} for k in [1,2,3]] x FROM f JOIN e ON e.t=f.t+1) q) SELECT * FROM f WHERE t>1)"""


TERM = "(list_transform([1,2,3], lambda i: f.a[i]+ln(CASE WHEN i=k THEN 0.8::DOUBLE ELSE 0.1::DOUBLE END)))"


@query("t regime", "alpha", forward_sql(f"ln(list_sum(list_transform({TERM}, lambda v: exp(v))))"), "thm", "am", "bm")
def hmm_forward(spark, d):
    return forward_fold(spark)


BEST = "(list_transform(list_filter([1,2,3], lambda i: f.a[i]>=list_reverse_sort(f.a)[2]), lambda i: f.a[i]+ln(CASE WHEN i=k THEN 0.8::DOUBLE ELSE 0.1::DOUBLE END)))"


@query("t regime", "alpha", forward_sql(f"list_max({BEST})"), "thm", "am", "bm")
def hmm_beam_forward(spark, d):
    return forward_fold(spark, beam=2)


WEIGHT = "list_transform([1,2,3], lambda k: exp(al.a[k])*CASE WHEN b.regime=0 THEN 1.0::DOUBLE WHEN b.regime=k THEN 0.8::DOUBLE ELSE 0.1::DOUBLE END)"
BACKWARD = f"""SELECT draw,t,regime FROM (WITH RECURSIVE al AS MATERIALIZED (SELECT t,list(alpha ORDER BY regime) a FROM ({forward_sql(f"ln(list_sum(list_transform({TERM}, lambda v: exp(v))))")}) GROUP BY t),
b AS (SELECT draw,(SELECT max(t)+1 FROM al) t,0 regime FROM {fx.sr("draw", fx.DRAWS)} UNION ALL SELECT draw,t,least(3,1+(w[1]<u*(w[1]+w[2]+w[3]))::INT+(w[1]+w[2]<u*(w[1]+w[2]+w[3]))::INT) regime FROM (
SELECT b.draw,al.t,{WEIGHT} w,{su("backward", "b.draw", "al.t")} u FROM b JOIN al ON al.t=b.t-1)) SELECT * FROM b WHERE regime>0)"""


@query("draw t regime", "", BACKWARD, "thm", "am", "bm")
def hmm_backward(spark, d):
    """Regimes of each draw, sampled from the last time to the first by forward probability times transition."""
    alpha = forward_fold(spark).groupBy("t").agg(F.array_sort(F.collect_list(F.struct("regime", "alpha"))).alias("a"))
    steps = alpha.agg(F.reverse(F.array_sort(F.collect_list(F.struct("t", F.expr("transform(a, x -> exp(x.alpha))").alias("p"))))).alias("steps"))

    def step(acc, x):
        w = F.transform(x["p"], lambda p, k: p * F.when(acc["regime"] == 0, 1.0).when(acc["regime"] == k + 1, 0.8).otherwise(0.1))
        need = uniform("backward", "draw", x["t"]) * F.aggregate(w, F.lit(0.0), lambda s, v: s + v)
        n = F.aggregate(w, F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n")), lambda s, v: F.struct((s["sum"] + v).alias("sum"), (s["n"] + (s["sum"] + v < need).cast("int")).alias("n")))["n"]
        now = F.least(F.size(w), n + 1)
        return F.struct(now.alias("regime"), F.concat(acc["path"], F.array(F.struct(x["t"].alias("t"), now.alias("regime")))).alias("path"))

    start = F.struct(F.lit(0).alias("regime"), F.expr("cast(array() as array<struct<t:int,regime:int>>)").alias("path"))
    rows = fx.ids(spark, "draw", fx.DRAWS).join(F.broadcast(steps))  # one row, an array of times
    return rows.select("draw", F.explode(F.aggregate("steps", start, step, lambda s: s["path"])).alias("x")).select("draw", "x.t", "x.regime")


SIM = "SELECT a.t t1,b.t t2,coalesce((avg(a.y*b.y)-avg(a.y)*avg(b.y))/nullif(sqrt(var_pop(a.y)*var_pop(b.y)),0),0) sim FROM thm a JOIN thm b ON a.i=b.i AND a.j=b.j AND a.rel=b.rel AND a.t<b.t GROUP BY ALL"


@query("t1 t2", "sim", SIM, "thm")
def snapshot_similarity(spark, d):
    a = mean_theta(spark).withColumnsRenamed({"t": "t1", "y": "x"})
    b = mean_theta(spark).withColumnRenamed("t", "t2")
    x, y = F.col("x"), F.col("y")
    r = (F.avg(x * y) - F.avg(x) * F.avg(y)) / F.nullif(F.sqrt(F.var_pop(x) * F.var_pop(y)), F.lit(0.0))
    return a.join(b, ["i", "j", "rel"]).where("t1 < t2").groupBy("t1", "t2").agg(F.coalesce(r, F.lit(0.0)).alias("sim"))


@query("", "ll", f"SELECT -0.5::DOUBLE*n*ln(2*pi()*0.7::DOUBLE)-rss/1.4::DOUBLE ll FROM ({BRSS})", "thm", "am", "bm")
def step_loglik(spark, d):
    r = suffstats.bilinear_squares(mean_theta(spark), mean_op(spark, "a"), mean_op(spark, "b"))
    return r.select((-0.5 * F.col("n") * F.log(2 * F.pi() * 0.7) - F.col("rss") / 1.4).alias("ll"))


@query("", "ll", "SELECT -0.5::DOUBLE*rss/0.7::DOUBLE ll FROM (" + BRSS.replace("JOIN am m", "JOIN (SELECT a.t,x.i,y.i AS k,sum(a.a*x.u*y.u) v FROM uf x JOIN uf y ON x.r=y.r JOIN alpha a ON a.r=x.r GROUP BY ALL) m") + ")", "thm", "bm", "uf", "alpha")
def loglik_U(spark, d):
    r = suffstats.bilinear_squares(mean_theta(spark), algebra.lowrank(fx.u_factor(spark), fx.alpha(spark)), mean_op(spark, "b"))
    return r.select((-0.5 * F.col("rss") / 0.7).alias("ll"))


# Network statistics and impulse responses


@query("rel t", "density", "SELECT rel,t,avg(y) density FROM net WHERE i<>j GROUP BY ALL", "net")
def net_density(spark, d):
    return netstats.density(net(spark, d))


@query("rel t j", "in_degree", "SELECT rel,t,j,sum(y) in_degree FROM net GROUP BY ALL", "net")
def in_degree(spark, d):
    return netstats.in_degree(net(spark, d))


@query("rel t i", "out_degree", "SELECT rel,t,i,sum(y) out_degree FROM net GROUP BY ALL", "net")
def out_degree(spark, d):
    return netstats.out_degree(net(spark, d))


REC = "SELECT a.rel,a.t,coalesce((avg(a.y*b.y)-avg(a.y)*avg(b.y))/nullif(sqrt(var_pop(a.y)*var_pop(b.y)),0),0) reciprocity FROM net a JOIN net b ON a.rel=b.rel AND a.t=b.t AND a.i=b.j AND a.j=b.i WHERE a.i<a.j GROUP BY ALL"
TRA = "SELECT rel,t,coalesce(c/nullif(d,0),0) transitivity FROM (SELECT DISTINCT rel,t FROM net) LEFT JOIN (SELECT x.rel,x.t,count(*)/6.0::DOUBLE c FROM net x JOIN net y ON x.rel=y.rel AND x.t=y.t AND x.j=y.i JOIN net w ON w.rel=y.rel AND w.t=y.t AND w.i=y.j AND w.j=x.i WHERE x.y>0 AND y.y>0 AND w.y>0 GROUP BY ALL) USING (rel,t) LEFT JOIN (SELECT rel,t,sum(d*(d-1))/2.0::DOUBLE d FROM (SELECT rel,t,i,count(*) d FROM net WHERE y>0 GROUP BY ALL) GROUP BY ALL) USING (rel,t)"


@query("rel t", "reciprocity", REC, "net")
def reciprocity(spark, d):
    return netstats.reciprocity(net(spark, d))


@query("rel t", "transitivity", TRA, "net")
def transitivity(spark, d):
    return netstats.transitivity(net(spark, d))


@query("rel t", "density reciprocity transitivity", f"SELECT * FROM (SELECT rel,t,avg(y) density FROM net WHERE i<>j GROUP BY ALL) JOIN ({REC}) USING (rel,t) JOIN ({TRA}) USING (rel,t)", "net")
def net_summary(spark, d):
    return netstats.summary(net(spark, d))


for kind_, where_, size_ in (("unit_edge", "i=2 AND j=3", "1"), ("node_out", "i=2", "1"), ("node_in", "j=3", "1"), ("density", "i<>j", "1/20.0")):

    def shock_(spark, d, kind=kind_):
        return irf.shock(spark, 5, kind, 2, 3)

    shock_.__name__ = f"shock_{kind_}"
    query("i j", "y", f"SELECT i,j,({size_})::DOUBLE y FROM (SELECT range::INT i FROM range(1,6)),(SELECT range::INT j FROM range(1,6)) WHERE {where_}")(shock_)

H = 4


def irf_sql(dynamic: bool) -> str:
    """The recursion unrolled: each step joins the last with the operators of its time."""
    parts = ["x0 AS MATERIALIZED (SELECT draw,2 i,3 j,1.0::DOUBLE y FROM (SELECT DISTINCT draw FROM op))"]
    for h in range(1, H + 1):
        t = 2 + h if dynamic else 1
        parts.append(f"x{h} AS MATERIALIZED (SELECT x.draw,m.i,n.i AS j,sum(m.a*x.y*n.b) y FROM x{h - 1} x JOIN op m ON m.draw=x.draw AND m.k=x.i AND m.t={t} JOIN op n ON n.draw=x.draw AND n.k=x.j AND n.t={t} GROUP BY ALL)")
    rows = " UNION ALL ".join(f"SELECT draw,{h} h,i::INT i,j::INT j,y FROM x{h}" for h in range(H + 1))
    return f"WITH {', '.join(parts)} {rows}"


def responses(spark, dynamic: bool):
    op = fx.op(spark) if dynamic else fx.op(spark).where("t = 1")
    return irf.respond(op, irf.shock(spark, fx.ACTORS, "unit_edge", 2, 3), H, 1 if dynamic else None)


SUMMARY = "h horizon,avg(v) mean,quantile_cont(v,0.5) median,stddev_samp(v) sd,quantile_cont(v,0.025) q025,quantile_cont(v,0.975) q975,quantile_cont(v,0.1) q10,quantile_cont(v,0.9) q90"


@query("draw h i j", "y", irf_sql(False), "op")
def irf_const(spark, d):
    return responses(spark, False)


@query("draw h i j", "y", irf_sql(True), "op")
def irf_dynamic(spark, d):
    return responses(spark, True)


@query("horizon", "mean median sd q025 q975 q10 q90", f"SELECT {SUMMARY} FROM (SELECT draw,h,sum(CASE WHEN i<>j THEN y ELSE 0 END)/20 v FROM ({irf_sql(True)}) GROUP BY ALL) GROUP BY h", "op")
def irf_density_summary(spark, d):
    return irf.summarise(irf.responses_of(responses(spark, True), fx.ACTORS))


@query("draw h i", "out_degree", f"SELECT draw,h,i,sum(y) out_degree FROM ({irf_sql(True)}) GROUP BY ALL", "op")
def irf_outdegree(spark, d):
    return netstats.out_degree(responses(spark, True), ["draw", "h"])


def full_response(spark):
    from functools import reduce

    cells = fx.grid(spark, draw=fx.DRAWS, i=fx.ACTORS, j=fx.ACTORS)
    grid = reduce(DataFrame.union, [cells.select("draw", F.lit(h).alias("h"), "i", "j") for h in range(H + 1)])
    return grid.join(responses(spark, True), ["draw", "h", "i", "j"], "left").withColumn("y", F.coalesce("y", F.lit(0.0)))


def rec_sql(value: str) -> str:
    return f"SELECT a.draw,a.h,coalesce((avg(a.{value}*b.{value})-avg(a.{value})*avg(b.{value}))/nullif(sqrt(var_pop(a.{value})*var_pop(b.{value})),0),0) r FROM full_ a JOIN full_ b ON a.draw=b.draw AND a.h=b.h AND a.i=b.j AND a.j=b.i WHERE a.i<a.j GROUP BY ALL"


FULL = f"WITH resp AS MATERIALIZED ({irf_sql(True)}), full_ AS MATERIALIZED (SELECT g.draw,g.h,g.i,g.j,coalesce(r.y,0)+b.mu y,b.mu mu FROM (SELECT DISTINCT o.draw,hh.h,o.i,o.k AS j FROM op o,(SELECT range::INT h FROM range(0,5)) hh) g JOIN base b ON b.i=g.i AND b.j=g.j AND b.rel=1 LEFT JOIN resp r ON r.draw=g.draw AND r.h=g.h AND r.i=g.i AND r.j=g.j)"


@query("draw h", "value", f"{FULL} SELECT draw,h,x.r-w.r AS value FROM ({rec_sql('y')}) x JOIN ({rec_sql('mu')}) w USING (draw,h)", "op", "base")
def irf_reciprocity(spark, d):
    return irf.statistic(full_response(spark), fx.base(spark).where("rel = 1").drop("rel"), netstats.reciprocity, "reciprocity")


def tri_sql(value: str) -> str:
    edges = f"(SELECT draw,h,i,j FROM full_ WHERE {value}>0)"
    closed = f"(SELECT a.draw,a.h,count(*)/6 n FROM {edges} a JOIN {edges} b ON b.draw=a.draw AND b.h=a.h AND b.i=a.j JOIN {edges} c ON c.draw=a.draw AND c.h=a.h AND c.i=b.j AND c.j=a.i GROUP BY ALL)"
    open_ = f"(SELECT draw,h,sum(d*(d-1))/2 n FROM (SELECT draw,h,i,count(*) d FROM {edges} GROUP BY ALL) GROUP BY ALL)"
    return f"SELECT k.draw,k.h,coalesce(c.n/nullif(o.n,0),0) r FROM (SELECT DISTINCT draw,h FROM full_) k LEFT JOIN {closed} c ON c.draw=k.draw AND c.h=k.h LEFT JOIN {open_} o ON o.draw=k.draw AND o.h=k.h"


@query("draw h", "value", f"{FULL} SELECT draw,h,x.r-w.r AS value FROM ({tri_sql('y')}) x JOIN ({tri_sql('mu')}) w USING (draw,h)", "op", "base")
def irf_transitivity(spark, d):
    return irf.statistic(full_response(spark), fx.base(spark).where("rel = 1").drop("rel"), netstats.transitivity, "transitivity")


# Posterior queries


@query("draw i j rel t", "theta", "SELECT * FROM theta WHERE i IN (1,2) AND j=3 AND rel=1", "theta")
def theta_slice(spark, d):
    return posterior.theta_slice(fx.theta(spark), i=[1, 2], j=[3], rel=[1])


@query("i j rel t", "value", "SELECT i,j,rel,t,avg(theta) AS value FROM theta GROUP BY ALL", "theta")
def theta_summary(spark, d):
    return posterior.theta_summary(fx.theta(spark))


@query("parameter", "mean sd q5 q50 q95", "SELECT parameter,avg(value) mean,stddev_samp(value) sd,quantile_cont(value,0.05) q5,quantile_cont(value,0.5) q50,quantile_cont(value,0.95) q95 FROM pars GROUP BY parameter", "pars")
def param_summary(spark, d):
    return posterior.param_summary(fx.pars(spark))


@query("i j", "value", "SELECT i,j,avg(mu) AS value FROM base GROUP BY ALL", "base")
def latent_summary(spark, d):
    return posterior.theta_summary(fx.base(spark), keys=["i", "j"], value="mu")


@query("draw", "norm", "SELECT draw,sqrt(sum(theta*theta)) norm FROM theta GROUP BY draw", "theta")
def derive_draws(spark, d):
    def norm(pdf):
        import pandas as pd

        return pd.DataFrame({"draw": [pdf["draw"].iloc[0]], "norm": [float((pdf["theta"] ** 2).sum() ** 0.5)]})

    return posterior.derive_draws(fx.theta(spark), norm, "draw int, norm double")


@query("t i k", "a b", "SELECT t,i,k,avg(a) a,avg(b) b FROM op GROUP BY ALL", "op")
def tidy_operators(spark, d):
    return posterior.tidy_operators(fx.op(spark))


@query("t i j", "value", "SELECT t,i,j,avg(value) AS value FROM dyad GROUP BY ALL", "dyad")
def tidy_theta(spark, d):
    return posterior.dyad_operator(fx.op(spark)).groupBy("t", "i", "j").agg(F.avg("value").alias("value"))


@query("t", "mean q2_5 q97_5", "SELECT t,avg(value) mean,quantile_cont(value,0.025) q2_5,quantile_cont(value,0.975) q97_5 FROM dyad WHERE i=1 AND j=2 GROUP BY t", "dyad")
def dyad_path(spark, d):
    return posterior.dyad_path(fx.op(spark), 1, 2)


@query("i j", "value", "SELECT i,j,avg(value) AS value FROM dyad WHERE t=3 GROUP BY ALL", "dyad")
def net_snapshot(spark, d):
    return posterior.net_snapshot(fx.op(spark), 3)


@query("i j", "value", "SELECT i,j,CASE WHEN quantile_cont(value,0.025)>0 OR quantile_cont(value,0.975)<0 THEN avg(value) END AS value FROM dyad WHERE t=3 GROUP BY ALL", "dyad")
def net_snapshot_significant(spark, d):
    return posterior.net_snapshot(fx.op(spark), 3, significant=True)


for kind_, own_, value_ in (("sender", "i", "a"), ("target", "k", "b")):
    for measure_, sum_ in (("rowsum", "sum({})"), ("rowmean", "avg({})"), ("l2", "sqrt(sum({0}*{0}))")):

        def influence_(spark, d, kind=kind_, measure=measure_):
            groups = spark.createDataFrame([("odd", 1), ("odd", 3), ("odd", 5), ("pair", 1), ("pair", 2)], "name string, id int")
            return posterior.group_influence(fx.op(spark), groups, kind, measure)

        influence_.__name__ = f"group_influence_{kind_}_{measure_}"
        query("name t", "mean q2_5 q50 q97_5", f"SELECT name,t,avg(v) mean,quantile_cont(v,0.025) q2_5,quantile_cont(v,0.5) q50,quantile_cont(v,0.975) q97_5 FROM (SELECT name,draw,t,avg(x) v FROM (SELECT draw,t,{own_} id,{sum_.format(value_)} x FROM op GROUP BY ALL) JOIN (VALUES ('odd',1),('odd',3),('odd',5),('pair',1),('pair',2)) g(name,id) USING (id) GROUP BY ALL) GROUP BY ALL", "op")(influence_)


@query("parameter", "acf", "SELECT parameter,coalesce((avg(x*y)-avg(x)*avg(y))/nullif(sqrt(var_pop(x)*var_pop(y)),0),0) acf FROM (SELECT parameter,value x,lag(value) OVER (PARTITION BY parameter ORDER BY draw) y FROM pars) WHERE y IS NOT NULL GROUP BY parameter", "pars")
def lag1_autocorr(spark, d):
    return suffstats.autocorrelation(fx.pars(spark))


@query("parameter", "rhat", "SELECT parameter,sqrt((min(n)-1)/min(n)+var_samp(m)/avg(v)) rhat FROM (SELECT parameter,draw>25 late,avg(value) m,var_samp(value) v,count(*) n FROM pars GROUP BY ALL) GROUP BY parameter", "pars")
def split_rhat(spark, d):
    return posterior.split_rhat(fx.pars(spark), 25)


ESS = """WITH p AS (SELECT parameter,draw,value-avg(value) OVER (PARTITION BY parameter) y FROM pars),
c AS MATERIALIZED (SELECT a.parameter,b.draw-a.draw lag,sum(a.y*b.y) g FROM p a JOIN p b ON a.parameter=b.parameter AND b.draw>=a.draw GROUP BY ALL),
s AS MATERIALIZED (SELECT c.parameter,(c.lag+1)//2 k,sum(c.g/o.g) s FROM c JOIN c o ON o.parameter=c.parameter AND o.lag=0 WHERE c.lag BETWEEN 1 AND 24 GROUP BY ALL)
SELECT parameter,50/(1+2*coalesce(sum(s) FILTER (k<stop),0)) ess FROM s JOIN (SELECT parameter,coalesce(min(k) FILTER (s<=0),13) stop FROM s GROUP BY parameter) USING (parameter) GROUP BY parameter"""


@query("parameter", "ess", ESS, "pars")
def effective_size(spark, d):
    return posterior.effective_sizes(fx.pars(spark))


@query("", "rss", "SELECT sum((v-(i=k)::INT)*(v-(i=k)::INT)) rss FROM am WHERE t<=3", "am")
def regime_deviation(spark, d):
    """Squared distance of all regimes' operators from the identity."""
    away = F.col("v") - (F.col("i") == F.col("k")).cast("int")
    return mean_op(spark, "a").where(F.col("t") <= fx.REGIMES).agg(F.sum(away * away).alias("rss"))


@query("t id", "score")
def role_trajectory_a(spark, d):
    return posterior.role_trajectory(fx.op(spark), "a")


@query("t id", "score")
def role_trajectory_b(spark, d):
    return posterior.role_trajectory(fx.op(spark), "b", 2)


@query("parameter", "z", "SELECT parameter,(avg(h)-avg(w))/sqrt(var_samp(h)/count(h)+var_samp(w)/count(w)) z FROM (SELECT parameter,CASE WHEN draw<=5 THEN value END h,CASE WHEN draw>25 THEN value END w FROM pars) GROUP BY parameter", "pars")
def geweke(spark, d):
    return posterior.geweke(fx.pars(spark))


@query("fit draw", "value", "SELECT f.fit,draw,value*f.s AS value FROM pars,(VALUES ('one',1.0::DOUBLE),('two',2.0::DOUBLE)) f(fit,s) WHERE parameter='g2'", "pars")
def compare_traces(spark, d):
    p = fx.pars(spark)
    return posterior.compare_traces("g2", one=p, two=p.withColumn("value", F.col("value") * 2))


@query("parameter draw", "value running", "SELECT parameter,draw,value,avg(value) OVER (PARTITION BY parameter ORDER BY draw ROWS UNBOUNDED PRECEDING) running FROM pars", "pars")
def running_mean(spark, d):
    return posterior.running_mean(fx.pars(spark))


@query("parameter bin n", "", "SELECT parameter,least(10,1+floor((value-lo)/(hi-lo)*10))::INT bin,count(*) n FROM pars JOIN (SELECT parameter,min(value) lo,max(value) hi FROM pars GROUP BY ALL) USING (parameter) GROUP BY ALL", "pars")
def trace_histogram(spark, d):
    return posterior.histogram(fx.pars(spark))


@query("i k", "effect", "WITH e AS (SELECT i,k,avg(a) effect FROM op WHERE i<>k GROUP BY ALL) SELECT * FROM e WHERE abs(effect)>(SELECT quantile_cont(abs(effect),0.8) FROM e)", "op")
def significant_edges(spark, d):
    return posterior.significant_edges(fx.op(spark), 0.2)


@query("regime", "share", "SELECT regime,count(*)/140.0::DOUBLE share FROM state GROUP BY regime", "state")
def mean_regime_share(spark, d):
    n = fx.state(spark).groupBy("regime").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("all")))).select("regime", (F.col("n") / F.col("all")).alias("share"))  # one row


@query("t", "mean lo hi", "SELECT t,avg(v) mean,quantile_cont(v,0.025) lo,quantile_cont(v,0.975) hi FROM (SELECT draw,t,sum(a) v FROM op WHERE i=k GROUP BY ALL) GROUP BY t", "op")
def tidy_factors(spark, d):
    v = fx.op(spark).where("i = k").groupBy("draw", "t").agg(F.sum("a").alias("v"))
    return v.groupBy("t").agg(F.avg("v").alias("mean"), F.percentile("v", F.lit(0.025)).alias("lo"), F.percentile("v", F.lit(0.975)).alias("hi"))


# Prediction and checks


@query("rel", "y ecdf", "SELECT DISTINCT rel,y,cume_dist() OVER (PARTITION BY rel ORDER BY y) ecdf FROM net WHERE y IS NOT NULL", "net")
def ppc_ecdf(spark, d):
    return posterior.ecdf(net(spark, d))


PPD = f"SELECT draw,i,j,rel,t,({su('ppd', 'draw', 'i', 'j', 'rel', 't')}<0.5::DOUBLE)::INT::DOUBLE y FROM theta"


@query("draw i j rel t", "y", f"SELECT draw,i,j,rel,t,theta+0.5::DOUBLE*{sn('ppd', 'draw', 'i', 'j', 'rel', 't')} y FROM theta", "theta")
def gaussian_generate(spark, d):
    return predict.posterior_predict(fx.theta(spark), "gaussian", sd=F.lit(0.5))


@query("rel observed", "y mean q5 q95", f"SELECT o.rel,o.n observed,o.y,avg(coalesce(r.n,0)) mean,quantile_cont(coalesce(r.n,0)::DOUBLE,0.05) q5,quantile_cont(coalesce(r.n,0)::DOUBLE,0.95) q95 FROM (SELECT rel,y,count(*) n FROM (SELECT rel,(y>0)::INT::DOUBLE y FROM thm) GROUP BY ALL) o CROSS JOIN (SELECT DISTINCT draw FROM theta) d LEFT JOIN (SELECT draw,rel,y,count(*) n FROM ({PPD}) GROUP BY ALL) r ON r.draw=d.draw AND r.rel=o.rel AND r.y=o.y GROUP BY ALL", "thm")
def ppc_bars(spark, d):
    obs = mean_theta(spark).withColumn("y", (F.col("y") > 0).cast("double"))
    rep = fx.theta(spark).withColumn("y", (uniform("ppd", "draw", "i", "j", "rel", "t") < 0.5).cast("double"))
    return posterior.ppc_bars(obs, rep)


@query("rel bin n", "", "SELECT rel,least(20,1+floor((y-lo)/(hi-lo)*20))::INT bin,count(*) n FROM net JOIN (SELECT rel,min(y) lo,max(y) hi FROM net GROUP BY ALL) USING (rel) WHERE y IS NOT NULL GROUP BY ALL", "net")
def ppc_density_hist(spark, d):
    rows = net(spark, d).where("y is not null").select(F.col("rel").alias("parameter"), F.col("y").alias("value"))
    return posterior.histogram(rows, 20).withColumnRenamed("parameter", "rel")


CUTS = "(SELECT rel,quantile_cont(y,0.2) c1,quantile_cont(y,0.4) c2,quantile_cont(y,0.6) c3,quantile_cont(y,0.8) c4 FROM thm GROUP BY rel)"
UNIFORM = su("ppd", "draw", "i", "j", "rel", "t")


@query("draw i j rel t", "y", f"SELECT draw,i,j,rel,t,({UNIFORM}<{fx.spnorm('theta')})::INT::DOUBLE y FROM theta", "theta")
def binary_generate(spark, d):
    return predict.posterior_predict(fx.theta(spark), "binary")


@query("draw i j rel t", "y", f"SELECT draw,i,j,rel,t,(1+{'+'.join(f'({fx.spnorm(f'(c{k}-theta)')}<{UNIFORM})::INT' for k in range(1, 5))})::DOUBLE y FROM theta JOIN {CUTS} USING (rel)", "thm")
def ordinal_generate(spark, d):
    return predict.posterior_predict(fx.theta(spark), "ordinal", cuts=predict.cuts_of(mean_theta(spark)))


@query("i j rel t", "y", f"SELECT i,j,rel,t,1+{'+'.join(f'(1-{fx.spnorm(f'(c{k}-y)')})' for k in range(1, 5))} y FROM thm JOIN {CUTS} USING (rel)", "thm")
def ordinal_expected(spark, d):
    return mean_theta(spark).join(F.broadcast(predict.cuts_of(mean_theta(spark))), "rel").withColumn("y", predict.expected_category(F.col("y"), F.col("cuts")))


CUT = "SELECT n.i,n.j,n.rel,n.t,(1+(n.y>=c1)::INT+(n.y>=c2)::INT+(n.y>=c3)::INT+(n.y>=c4)::INT)::DOUBLE y FROM thm n JOIN (SELECT rel,quantile_cont(y,0.2) c1,quantile_cont(y,0.4) c2,quantile_cont(y,0.6) c3,quantile_cont(y,0.8) c4 FROM thm GROUP BY rel) USING (rel)"


@query("i j rel t", "y", CUT, "thm")
def predict_ordinal(spark, d):
    rows = mean_theta(spark).join(F.broadcast(predict.cuts_of(mean_theta(spark))), "rel")
    return rows.withColumn("y", 1 + F.size(F.filter("cuts", lambda c: c <= F.col("y"))))


def forecast_sql(where: str, own: str = "SELECT * FROM op", steps: int = 3) -> str:
    parts = [f"own AS MATERIALIZED ({own})", "y0 AS MATERIALIZED (SELECT draw,i,j,theta y FROM theta WHERE rel=1 AND t=7)"]
    for h in range(1, steps + 1):
        parts.append(f"y{h} AS MATERIALIZED (SELECT draw,i,j,y+0.5::DOUBLE*{sn('forecast', 'draw', 'i', 'j', str(h))} y FROM (SELECT x.draw,m.i,n.i AS j,sum(m.a*x.y*n.b) y FROM y{h - 1} x JOIN own m ON m.draw=x.draw AND m.k=x.i AND {where.format('m')} JOIN own n ON n.draw=x.draw AND n.k=x.j AND {where.format('n')} GROUP BY ALL))")
    return f"WITH {', '.join(parts)} " + " UNION ALL ".join(f"SELECT draw,{h} h,i,j,y FROM y{h}" for h in range(1, steps + 1))


@query("draw h i j", "y", forecast_sql("{}.t=7"), "op", "theta")
def forecast_dynamic(spark, d):
    start = fx.theta(spark).where("rel = 1 and t = 7").select("draw", "i", "j", F.col("theta").alias("y"))
    return predict.forecast(fx.op(spark).where("t = 7"), start, 3, 0.5)


@query("draw h i j", "y", forecast_sql("{}.t=1"), "op", "theta")
def predict_static(spark, d):
    start = fx.theta(spark).where("rel = 1 and t = 7").select("draw", "i", "j", F.col("theta").alias("y"))
    return predict.forecast(fx.op(spark).where("t = 1"), start, 3, 0.5)


LATE_FACTORS = "SELECT o.draw,o.i,o.k,l.v a,o.b FROM op o JOIN (SELECT x.i,y.i AS k,sum(a.a*x.u*y.u) v FROM uf x JOIN uf y ON x.r=y.r JOIN alpha a ON a.r=x.r WHERE a.t=7 GROUP BY ALL) l ON l.i=o.i AND l.k=o.k WHERE o.t=7"


@query("draw h i j", "y", forecast_sql("TRUE", LATE_FACTORS), "op", "theta", "uf", "alpha")
def forecast_lowrank(spark, d):
    a = algebra.lowrank(fx.u_factor(spark), fx.alpha(spark)).where("t = 7").select("i", "k", F.col("v").alias("a"))
    op = fx.op(spark).where("t = 7").drop("a").join(a, ["i", "k"])
    start = fx.theta(spark).where("rel = 1 and t = 7").select("draw", "i", "j", F.col("theta").alias("y"))
    return predict.forecast(op, start, 3, 0.5)


NEXT_REGIME = f"SELECT o.* FROM op o JOIN (SELECT draw,1+(u>0.8::DOUBLE)::INT+(u>0.9::DOUBLE)::INT t FROM (SELECT draw,{su('regime', 'draw', '1')} u FROM {fx.sr('draw', fx.DRAWS)})) r ON r.draw=o.draw AND r.t=o.t"


@query("draw h i j", "y", forecast_sql("TRUE", NEXT_REGIME, 1), "op", "theta")
def forecast_hmm(spark, d):
    trans = fx.grid(spark, draw=fx.DRAWS, **{"from": 3, "to": 3}).withColumn("p", F.when(F.col("from") == F.col("to"), 0.8).otherwise(0.1))
    first = predict.regime_path(trans, 1).select("draw", F.col("regime").alias("t"))
    start = fx.theta(spark).where("rel = 1 and t = 7").select("draw", "i", "j", F.col("theta").alias("y"))
    return predict.forecast(fx.op(spark).join(first, ["draw", "t"]), start, 1, 0.5)


@query("t stored", "", "SELECT t,min_by(stored,abs(t-stored)*1000+stored) stored FROM (SELECT range::INT t FROM range(1,8)),(VALUES (1),(4),(7)) s(stored) GROUP BY t")
def nearest_time_expand(spark, d):
    return posterior.nearest_time(fx.ids(spark, "t", 7), fx.ids(spark, "t", 7).where("t % 3 = 1"))


@query("day event_type n", "", "SELECT ts::DATE AS day,event_type,count(*) n FROM events GROUP BY ALL")
def daily_event_counts(spark, d):
    return ingest.daily_counts(spark.read.parquet(f"{d}/events.parquet"))


# Generators and fits: rows only

for model_ in ("static", "dynamic", "lowrank", "hmm", "test"):

    def simulate_(spark, d, model=model_):
        from ..session import ship

        return simulate.simulate(ship(spark), model, n=8, p=2, time=10)

    simulate_.__name__ = f"sim_{model_}"
    query("i j rel t", "y")(simulate_)


def fit_input(spark, d):
    """Five sending and receiving regions' trade by year: the trade network, summed to regions."""
    nation = spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", "n_regionkey")
    rows = tensor.trade(spark, d).join(nation.toDF("i", "a"), "i").join(nation.toDF("j", "b"), "j")
    return tensor.to_tensor(rows, "a", "b", F.log1p(F.sum("y")), None, "t")


for model_ in fits.MODELS:

    def fit_(spark, d, model=model_):
        draws = fits.fit(fit_input(spark, d), "gaussian", model, nscan=40, burn=40, odens=2, chains=2)
        return draws.select("chain", "draw", "part", "t", "i", "k", "value")

    fit_.__name__ = f"fit_{model_}"
    query("chain draw part t i k", "value")(fit_)


def dynamic_fit(spark, d):
    return fits.fit(fit_input(spark, d), "gaussian", "dynamic", nscan=20, burn=20, odens=2, chains=2)


@query("i j rel t", "value")
def fit_theta_summary(spark, d):
    return posterior.theta_summary(fits.pooled(fits.states(dynamic_fit(spark, d))))


@query("draw h i j", "y")
def fit_predict(spark, d):
    return fits.predict(dynamic_fit(spark, d), 2)


@query("id t", "x")
def dlm_batch(spark, d):
    """A draw of the level of each relation of each pair of nations over the years."""
    series = net(spark, d).select(F.xxhash64("i", "j", "rel").alias("id"), "t", F.log1p("y").alias("y"))
    return posterior.dlm_states(series, 0.5, 0.1)
