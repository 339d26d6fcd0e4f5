"""Base views of the registered queries, as DataFrames and as SQL: the trade network and a seeded posterior."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normal import ERF, ERF_P
from ..functions.rng import normal, uniform

DRAWS, TIMES, ACTORS, RANK, REGIMES, RELS = 20, 7, 5, 2, 3, 2


def ids(spark: SparkSession, name: str, n: int) -> DataFrame:
    return spark.range(1, n + 1).select(F.col("id").cast("int").alias(name))


def grid(spark: SparkSession, **sizes: int) -> DataFrame:
    """Every combination of small index ranges."""
    out = None
    for name, n in sizes.items():
        out = ids(spark, name, n) if out is None else out.join(ids(spark, name, n))
    return out


def op(spark: SparkSession) -> DataFrame:
    own = F.when(F.col("i") == F.col("k"), 0.5).otherwise(0.0)
    cell = lambda seed: own + 0.3 * (uniform(seed, "draw", "t", "i", "k") - 0.5)
    return grid(spark, draw=DRAWS, t=TIMES, i=ACTORS, k=ACTORS).select("draw", "t", "i", "k", cell("A").alias("a"), cell("B").alias("b"))


def theta(spark: SparkSession) -> DataFrame:
    return grid(spark, draw=DRAWS, i=ACTORS, j=ACTORS, rel=RELS, t=TIMES).select("draw", "i", "j", "rel", "t", normal("theta", "draw", "i", "j", "rel", "t").alias("theta"))


def base(spark: SparkSession) -> DataFrame:
    return grid(spark, i=ACTORS, j=ACTORS, rel=RELS).select("i", "j", "rel", normal("mu", "i", "j", "rel").alias("mu"))


def state(spark: SparkSession) -> DataFrame:
    return grid(spark, draw=DRAWS, t=TIMES).select("draw", "t", (1 + F.floor(REGIMES * uniform("S", "draw", "t"))).cast("int").alias("regime"))


def pars(spark: SparkSession) -> DataFrame:
    names = spark.createDataFrame([("sigma2_proc",), ("tau_A2",), ("tau_B2",), ("g2",)], "parameter string")
    return ids(spark, "draw", 50).join(names).select("draw", "parameter", (1 + uniform("par", "draw", "parameter")).alias("value"))


def u_factor(spark: SparkSession) -> DataFrame:
    return grid(spark, i=ACTORS, r=RANK).select("i", "r", (uniform("U", "i", "r") - 0.5).alias("u"))


def alpha(spark: SparkSession) -> DataFrame:
    return grid(spark, r=RANK, t=TIMES).select("r", "t", uniform("alpha", "r", "t").alias("a"))


# The same in DuckDB's SQL.


def su(seed: str, *keys: str) -> str:
    return f"(('0x'||substring(md5(concat_ws('|','{seed}',{','.join(keys)})),1,13))::BIGINT/4503599627370496.0::DOUBLE)"


def sn(seed: str, *keys: str) -> str:
    return f"(sqrt(-2.0::DOUBLE*ln(greatest({su(seed + ':1', *keys)},1e-16::DOUBLE)))*cos(2*pi()*{su(seed + ':2', *keys)}))"


def spnorm(x: str) -> str:
    t = f"(1/(1+{ERF_P}::DOUBLE*abs({x})/sqrt(2.0::DOUBLE)))"
    inner = "0"
    for c in reversed(ERF):
        inner = f"({inner}*{t}+({c})::DOUBLE)"
    tail = f"(0.5::DOUBLE*{t}*{inner}*exp(-({x})*({x})/2))"
    return f"(CASE WHEN {x}>=0 THEN 1-{tail} ELSE {tail} END)"


def sgamma(shape: str, seed: str, *keys: str, attempts: int = 8) -> str:
    """The first accepted of the attempts of Marsaglia and Tsang, else the mode."""
    d = f"({shape}-1/3.0::DOUBLE)"
    tries = []
    for k in range(attempts):
        x, u = sn(f"{seed}:x{k}", *keys), f"greatest({su(f'{seed}:u{k}', *keys)},1e-16::DOUBLE)"
        v = f"pow(1+{x}/sqrt(9*{d}),3)"
        tries.append(f"WHEN {v}>0 AND ln({u})<0.5::DOUBLE*pow({x},2)+{d}-{d}*{v}+{d}*ln(greatest({v},1e-300::DOUBLE)) THEN {d}*{v}")
    return f"(CASE {' '.join(tries)} ELSE {d} END)"


def sr(name: str, n: int) -> str:
    return f"(SELECT range::INT AS {name} FROM range(1,{n + 1}))"


VIEWS = {
    "trade": "SELECT s.s_nationkey i, c.c_nationkey j, l.l_returnflag rel, year(l.l_shipdate)::INT t, sum(l.l_quantity) y FROM lineitem l JOIN orders o ON l.l_orderkey=o.o_orderkey JOIN customer c ON o.o_custkey=c.c_custkey JOIN supplier s ON l.l_suppkey=s.s_suppkey GROUP BY ALL",
    "net": "SELECT a.n_nationkey i, b.n_nationkey j, r.rel, x.t, CASE WHEN a.n_nationkey<>b.n_nationkey THEN coalesce(trade.y,0.0::DOUBLE) END y FROM nation a, nation b, (SELECT DISTINCT rel FROM trade) r, (SELECT DISTINCT t FROM trade) x LEFT JOIN trade ON trade.i=a.n_nationkey AND trade.j=b.n_nationkey AND trade.rel=r.rel AND trade.t=x.t",
    "z": "SELECT n.i, n.j, n.rel, n.t, n.y, CASE WHEN n.i<>n.j THEN (n.y-m.mean)/nullif(m.sd,0) END z FROM net n JOIN (SELECT rel, avg(y) mean, stddev_samp(y) sd FROM net GROUP BY rel) m USING (rel)",
    "op": f"SELECT draw,t,i,k, (CASE WHEN i=k THEN 0.5 ELSE 0 END)::DOUBLE+0.3::DOUBLE*({su('A', 'draw', 't', 'i', 'k')}-0.5::DOUBLE) a, (CASE WHEN i=k THEN 0.5 ELSE 0 END)::DOUBLE+0.3::DOUBLE*({su('B', 'draw', 't', 'i', 'k')}-0.5::DOUBLE) b FROM {sr('draw', DRAWS)}, {sr('t', TIMES)}, {sr('i', ACTORS)}, {sr('k', ACTORS)}",
    "theta": f"SELECT draw,i,j,rel,t,{sn('theta', 'draw', 'i', 'j', 'rel', 't')} theta FROM {sr('draw', DRAWS)}, {sr('i', ACTORS)}, {sr('j', ACTORS)}, {sr('rel', RELS)}, {sr('t', TIMES)}",
    "base": f"SELECT i,j,rel,{sn('mu', 'i', 'j', 'rel')} mu FROM {sr('i', ACTORS)}, {sr('j', ACTORS)}, {sr('rel', RELS)}",
    "state": f"SELECT draw,t,(1+floor({REGIMES}*{su('S', 'draw', 't')}))::INT regime FROM {sr('draw', DRAWS)}, {sr('t', TIMES)}",
    "pars": f"SELECT draw,parameter,1+{su('par', 'draw', 'parameter')} AS value FROM {sr('draw', 50)}, (VALUES ('sigma2_proc'),('tau_A2'),('tau_B2'),('g2')) p(parameter)",
    "uf": f"SELECT i,r,{su('U', 'i', 'r')}-0.5::DOUBLE u FROM {sr('i', ACTORS)}, {sr('r', RANK)}",
    "alpha": f"SELECT r,t,{su('alpha', 'r', 't')} a FROM {sr('r', RANK)}, {sr('t', TIMES)}",
    "thm": "SELECT i,j,rel,t,avg(theta) y FROM theta GROUP BY ALL",
    "am": "SELECT t,i,k,avg(a) v FROM op GROUP BY ALL",
    "bm": "SELECT t,i,k,avg(b) v FROM op GROUP BY ALL",
    "dyad": "SELECT x.draw,x.t,x.i,y.i AS j,sum(x.a*y.b) AS value FROM op x JOIN op y ON x.draw=y.draw AND x.t=y.t AND x.k=y.k GROUP BY ALL",
}
NEEDS = {"net": ["trade"], "z": ["trade", "net"], "thm": ["theta"], "am": ["op"], "bm": ["op"], "dyad": ["op"]}


def sql(keys: str, doubles: str, body: str, *views: str) -> str:
    """A query over the views it names; doubles are rounded to 6 places, and -0 is 0."""
    wanted = list(dict.fromkeys(w for v in views for w in [*NEEDS.get(v, []), v]))
    head = ",\n".join(f"{v} AS MATERIALIZED ({VIEWS[v]})" for v in wanted)
    columns = ", ".join([*keys.split(), *[f"round({d},6)+0.0::DOUBLE AS {d}" for d in doubles.split()]])
    return (f"WITH {head}\n" if head else "") + f"SELECT {columns} FROM ({body})"
