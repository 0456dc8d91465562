"""Registered queries of the measures on the driver's tables, and their DuckDB twins."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .operators import discrete, kernel, knn
from .operators.ordinal import symbolize
from .plans import surrogates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
ESTIMATORS = [e for e in discrete.ESTIMATORS if e not in ("nsb", "bayes")]
BAYES = {f"bayes_{p}": discrete.Estimator("bayes", alpha=p) for p in discrete.PRIORS} | {"bayes_value": discrete.Estimator("bayes", alpha=0.7, k=250)}
ALL = {e: discrete.Estimator(e) for e in ESTIMATORS} | BAYES
DIGITS = 8


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


def rounded(df: DataFrame, *keep: str, value: str = "value") -> DataFrame:
    return df.select(*keep, (F.round(value, DIGITS) + 0.0).alias(value), *(["n"] if "n" in df.columns else []))


# DuckDB's side: entropies from counts ---------------------------------------------------------------------------------


def sql_psi(x: str) -> str:
    """ψ as DuckDB arithmetic, from other shift and series length than the engine's."""
    x = f"cast({x} as double)"
    y = f"({x} + 12)"
    return f"(ln({y}) - 0.5/{y} - 1/(12*{y}*{y}) + 1/(120*pow({y},4)) - 1/(252*pow({y},6)) + 1/(240*pow({y},8)) - 1/(132*pow({y},10)) - " + " - ".join(
        f"1/({x}+{i})" for i in range(12)
    ) + ")"


def sql_entropy(est: discrete.Estimator) -> str:
    """An aggregate over one histogram's rows with columns n, tot, k, f1, f2 (and lam for shrink)."""
    kinds = str(float(est.k)) if est.k else "k"
    alpha = {"jeffrey": "0.5", "laplace": "1.0", "sch_grass": f"(1.0/{kinds})", "min_max": f"(sqrt(tot)/{kinds})"}.get(str(est.alpha), str(est.alpha))
    mle = "-sum(n/tot*ln(n/tot))"
    zhang = f"sum(n/tot*({sql_psi('tot')} - {sql_psi('n')}))"
    a = "(case when any_value(f2)>0 then 2.0*any_value(f2)/((any_value(tot)-1)*any_value(f1)+2*any_value(f2)) when any_value(f1)>0 then 2.0/((any_value(tot)-1)*(any_value(f1)-1)+2) else 1.0 end)"
    return {
        "mle": mle,
        "miller_madow": f"{mle} + (any_value(k)-1)/(2*any_value(tot))",
        "shrink": "-sum((lam/k+(1-lam)*n/tot)*ln(lam/k+(1-lam)*n/tot))",
        "grassberger": f"sum(n/tot*(ln(tot) - {sql_psi('n')} - (case when n%2=0 then 1 else -1 end)/(n+1)))",
        "zhang": zhang,
        "bayes": f"-sum((n+{alpha})/(tot+{kinds}*{alpha})*ln((n+{alpha})/(tot+{kinds}*{alpha})))",
        "bonachela": f"sum((n+1)*({sql_psi('tot+3')} - {sql_psi('n+2')}))/(any_value(tot)+2)",
        "chao_shen": "-sum(case when cov>0 then cov*n/tot*ln(cov*n/tot)/(1-pow(1-cov*n/tot, tot)) else 0 end)",
        "chao_wang_jost": f"{zhang} + case when {a}<>1 and any_value(f1)>0 then any_value(f1)/any_value(tot)*list_sum(list_transform(range(0,100000), lambda j: pow(1-{a}, 1+j)/(any_value(tot)+j))) else 0 end",
        "ansb": f"case when any_value(tot)-any_value({kinds})>0 then 0.5772156649015329-ln(2)+2*ln(any_value(tot))-{sql_psi(f'greatest(any_value(tot)-any_value({kinds}),1)')} else 'nan' end",
    }[est.name]


def sql_signed(counts: str, est: discrete.Estimator, weights: dict[str, float], groups: list[str]) -> str:
    """A signed sum of entropies; ``counts`` selects groups, the set's name ``s`` and the count ``n``."""
    over = ", ".join([*groups, "s"])
    keys = "".join(f"{g}, " for g in groups)
    weight = "case s " + " ".join(f"when '{s}' then {w}" for s, w in weights.items()) + " end"
    h = sql_entropy(est)
    if est.name == "chao_wang_jost":  # the aggregates inside the lambda are taken beforehand
        a = "(case when f2>0 then 2.0*f2/((tot-1)*f1+2*f2) when f1>0 then 2.0/((tot-1)*(f1-1)+2) else 1.0 end)"
        zhang = f"sum(n/tot*({sql_psi('tot')} - {sql_psi('n')}))"
        last = f"""z as (select {keys}s, {zhang} as z, any_value(tot) as tot, any_value(f1) as f1, any_value(f2) as f2 from u group by {over}),
     za as (select *, {a} as a from z),
     h as (select {keys}s, tot, z + case when a<>1 and f1>0 then f1/tot*coalesce((select sum(pow(1-a, 1+j)/(tot+j)) from range(0,60000) r(j)), 0) else 0 end as h from za)"""
    else:
        last = f"h as (select {keys}s, any_value(tot) as tot, {h} as h from u group by {over})"
    return f"""
with c as ({counts}),
     t as (select {keys}s, cast(n as double) as n, sum(cast(n as double)) over w as tot, cast(count(*) over w as double) as k,
                  cast(sum(case when n=1 then 1 else 0 end) over w as double) as f1, cast(sum(case when n=2 then 1 else 0 end) over w as double) as f2
           from c window w as (partition by {over})),
     v as (select *, 1 - (case when f1=tot then tot-1 else f1 end)/tot as cov, sum(n/tot*(1-n/tot)) over w/(tot-1) as num, sum((n/tot-1/k)*(n/tot-1/k)) over w as den
           from t window w as (partition by {over})),
     u as (select *, case when tot<=1 or den=0 then 1.0 else greatest(0.0, least(1.0, num/den)) end as lam from v),
     {last}
select {keys}round(sum({weight}*h), {DIGITS}) + 0.0 as value, cast(max(tot) as bigint) as n from h {'group by ' + ', '.join(groups) if groups else ''}
"""


def sql_sets(source: str, sets: dict[str, list[str]], groups: list[str]) -> str:
    return "\nunion all ".join(f"select {''.join(g + ', ' for g in groups)}'{s}' as s, count(*) as n from {source} group by {', '.join([*groups, *cols])}" for s, cols in sets.items())


def sql_psi1(x: str) -> str:
    """The derivative of ψ as DuckDB arithmetic."""
    x = f"cast({x} as double)"
    y = f"({x} + 12)"
    return f"(1/{y} + 0.5/pow({y},2) + 1/(6*pow({y},3)) - 1/(30*pow({y},5)) + 1/(42*pow({y},7)) - 1/(30*pow({y},9)) + " + " + ".join(f"1/pow({x}+{i},2)" for i in range(12)) + ")"


def sql_nsb(counts: str, weights: dict[str, float], groups: list[str], steps: int = 4000) -> str:
    """A signed sum of Nemenman-Shafee-Bialek entropies: both integrals by Simpson's rule, in steps that shrink towards the largest prior weight."""
    over = ", ".join([*groups, "s"])
    weight = "case s " + " ".join(f"when '{s}' then {w}" for s, w in weights.items()) + " end"
    return f"""
with c as ({counts}),
     t as (select {over}, cast(n as double) as n, sum(cast(n as double)) over w as tot, cast(count(*) over w as double) as k from c window w as (partition by {over})),
     g as (select {over}, any_value(tot) as tot, any_value(k) as k, ln(ln(any_value(k))) as b, ln(ln(any_value(k))) - ln(1e-8) as d from t group by {over}),
     x as (select *, exp(b - d*exp(-{40 / steps!r}*i)) as beta, exp(-{40 / steps!r}*i)*(case when i = 0 or i = {steps} then 1 when i % 2 = 1 then 4 else 2 end) as w from g, range(0, {steps + 1}) r(i)),
     y as (select {', '.join(f'x.{c}' for c in [*groups, 's'])}, i, any_value(x.tot) as tot, any_value(w*beta*(x.k*{sql_psi1('1+x.k*beta')} - {sql_psi1('1+beta')})) as f,
             -any_value(lgamma(x.tot+x.k*beta)-lgamma(x.k*beta)) + sum(t.n*(lgamma(t.n+beta)-lgamma(beta))) as l,
             any_value({sql_psi('x.tot+x.k*beta+1')}) - sum((t.n+beta)*{sql_psi('t.n+beta+1')})/any_value(x.tot+x.k*beta) as v
           from x join t using ({over}) group by {', '.join(f'x.{c}' for c in [*groups, 's'])}, i),
     z as (select *, exp(l - max(l) over (partition by {over}))*f as r from y),
     h as (select {over}, any_value(tot) as tot, sum(r*v)/sum(r) as h from z group by {over})
select {''.join(f'{g}, ' for g in groups)}round(sum({weight}*h), {DIGITS}) + 0.0 as value, cast(max(tot) as bigint) as n from h {'group by ' + ', '.join(groups) if groups else ''}
"""


def sql_local_te(source: str, sets: dict[str, list[str]]) -> str:
    """Terms of transfer entropy for each row, from window counts."""
    count = {s: f"ln(count(*) over (partition by {', '.join(cols)}))" for s, cols in sets.items()}
    return f"select round({count['xyz']} + {count['z']} - {count['xz']} - {count['yz']}, {DIGITS}) + 0.0 as local_value from {source}"


def _local(df: DataFrame) -> DataFrame:
    return df.select((F.round("local_value", DIGITS) + 0.0).alias("local_value"))


# discrete ---------------------------------------------------------------------------------------------------------------


def _lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem", "l_linenumber", "l_returnflag", "l_linestatus", "l_suppkey")


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.month("o_orderdate").alias("month"))


ORDERS = "(select o_orderkey, o_custkey, o_orderstatus, o_orderpriority, month(o_orderdate) as month from orders)"
#: One series a shard of users, with the kind of event, whether its value is high, and the hour.
EVENTS = """(select user_id % 8 as shard, ts, event_id, event_type as src, case when value > 35 then 1 else 0 end as dst, cast(floor(hour(ts)/6) as int) as cond, value from events)"""


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").select(
        (F.col("user_id") % 8).alias("shard"), "ts", "event_id", F.col("event_type").alias("src"), F.when(F.col("value") > 35, 1).otherwise(0).alias("dst"),
        F.floor(F.hour("ts") / 6).cast("int").alias("cond"), "value",
    )


MI_SETS = {"x": ["l_returnflag"], "y": ["l_linestatus"], "xy": ["l_returnflag", "l_linestatus"]}
CMI_SETS = {"xz": ["l_returnflag", "l_linenumber"], "yz": ["l_linestatus", "l_linenumber"], "xyz": ["l_returnflag", "l_linestatus", "l_linenumber"], "z": ["l_linenumber"]}
CMI_WEIGHTS = {"xz": 1.0, "yz": 1.0, "xyz": -1.0, "z": -1.0}


def sql_embedded(src_hist: int, dst_hist: int, step: int, cond_hist: int = 0, source: str = EVENTS, cols: tuple[str, str, str] = ("src", "dst", "cond")) -> str:
    delay = max(src_hist, dst_hist, cond_hist) * step
    lags = [f"lag({c}, {j * step}) over w as {n}{j}" for c, n, h in zip(cols, ("sp", "dp", "cp"), (src_hist, dst_hist, cond_hist), strict=True) for j in range(h, 0, -1)]
    return f"(select * from (select shard, {cols[1]} as fut, row_number() over w - 1 as t, {', '.join(lags)} from {source} window w as (partition by shard order by ts, event_id)) where t >= {delay} and (t - {delay}) % {step} = 0)"


def te_sets(src_hist: int, dst_hist: int, cond_hist: int = 0) -> dict[str, list[str]]:
    sp, dp = [f"sp{j}" for j in range(1, src_hist + 1)], [f"dp{j}" for j in range(1, dst_hist + 1)]
    z = dp + [f"cp{j}" for j in range(1, cond_hist + 1)]
    return {"xz": sp + z, "yz": ["fut", *z], "xyz": ["fut", *sp, *z], "z": z}


def _register_discrete() -> None:
    for name, est in ALL.items():
        add(
            f"entropy_{name}",
            lambda s, d, e=est: rounded(api.entropy(_orders(s, d), "o_custkey", group_by=["o_orderstatus"], estimator=e), "o_orderstatus"),
            sql_signed(sql_sets(ORDERS, {"x": ["o_custkey"]}, ["o_orderstatus"]), est, {"x": 1.0}, ["o_orderstatus"]),
        )
        add(
            f"mi_{name}",
            lambda s, d, e=est: rounded(api.mutual_information(_lineitem(s, d), ["l_returnflag", "l_linestatus"], group_by=["l_linenumber"], estimator=e), "l_linenumber"),
            sql_signed(sql_sets("lineitem", MI_SETS, ["l_linenumber"]), est, {"x": 1.0, "y": 1.0, "xy": -1.0}, ["l_linenumber"]),
        )
        add(
            f"cmi_{name}",
            lambda s, d, e=est: rounded(api.conditional_mutual_information(_lineitem(s, d), ["l_returnflag", "l_linestatus"], "l_linenumber", estimator=e)),
            sql_signed(sql_sets("lineitem", CMI_SETS, []), est, CMI_WEIGHTS, []),
        )
        add(
            f"te_{name}",
            lambda s, d, e=est: rounded(api.transfer_entropy(_events(s, d), "src", "dst", ["ts", "event_id"], ["shard"], 1, 1, 1, estimator=e)),
            sql_signed(sql_sets(sql_embedded(1, 1, 1), te_sets(1, 1), []), est, CMI_WEIGHTS, []),
        )
        add(
            f"cte_{name}",
            lambda s, d, e=est: rounded(api.conditional_transfer_entropy(_events(s, d), "src", "dst", "cond", ["ts", "event_id"], series_by=["shard"], estimator=e)),
            sql_signed(sql_sets(sql_embedded(1, 1, 1, 1), te_sets(1, 1, 1), []), est, CMI_WEIGHTS, []),
        )
    mle = ALL["mle"]
    add(
        "entropy_nsb",
        lambda s, d: rounded(api.entropy(_orders(s, d), "o_orderpriority", group_by=["o_orderstatus"], estimator="nsb"), "o_orderstatus"),
        sql_nsb(sql_sets(ORDERS, {"x": ["o_orderpriority"]}, ["o_orderstatus"]), {"x": 1.0}, ["o_orderstatus"]),
    )
    add(
        "mi_nsb",
        lambda s, d: rounded(api.mutual_information(_lineitem(s, d), ["l_returnflag", "l_linestatus"], group_by=["l_linenumber"], estimator="nsb"), "l_linenumber"),
        sql_nsb(sql_sets("lineitem", MI_SETS, ["l_linenumber"]), {"x": 1.0, "y": 1.0, "xy": -1.0}, ["l_linenumber"]),
    )
    add(
        "cmi_nsb",
        lambda s, d: rounded(api.conditional_mutual_information(_lineitem(s, d), ["l_returnflag", "l_linestatus"], "l_linenumber", estimator="nsb")),
        sql_nsb(sql_sets("lineitem", CMI_SETS, []), CMI_WEIGHTS, []),
    )
    add(
        "te_nsb",
        lambda s, d: rounded(api.transfer_entropy(_events(s, d), "src", "dst", ["ts", "event_id"], ["shard"], estimator="nsb")),
        sql_nsb(sql_sets(sql_embedded(1, 1, 1), te_sets(1, 1), []), CMI_WEIGHTS, []),
    )
    add(
        "cte_nsb",
        lambda s, d: rounded(api.conditional_transfer_entropy(_events(s, d), "src", "dst", "cond", ["ts", "event_id"], series_by=["shard"], estimator="nsb")),
        sql_nsb(sql_sets(sql_embedded(1, 1, 1, 1), te_sets(1, 1, 1), []), CMI_WEIGHTS, []),
    )
    events = EVENTS.replace(" from events", ", event_id % 3 as third from events")
    window = "window w as (partition by shard order by ts, event_id)"
    two = f"(select * from (select dst as fut, row_number() over w - 1 as t, lag(src) over w as s1, lag(src, 2) over w as s2, lag(cond) over w as c1, lag(cond, 2) over w as c2, lag(dst) over w as dp from {events} {window}) where t >= 2)"
    add(
        "te_nd",
        lambda s, d: rounded(api.transfer_entropy(_events(s, d), ["src", "cond"], "dst", ["ts", "event_id"], ["shard"], 2, 1, 1)),
        sql_signed(sql_sets(two, {"xz": ["s1", "s2", "c1", "c2", "dp"], "yz": ["fut", "dp"], "xyz": ["fut", "s1", "s2", "c1", "c2", "dp"], "z": ["dp"]}, []), mle, CMI_WEIGHTS, []),
    )
    both = f"(select * from (select dst as f1_, cond as f2_, row_number() over w - 1 as t, lag(src, 2) over w as sp, lag(dst, 2) over w as d1, lag(cond, 2) over w as d2, lag(dst, 4) over w as d3, lag(cond, 4) over w as d4, lag(third, 2) over w as z1, lag(third, 4) over w as z2 from {events} {window}) where t >= 4 and (t - 4) % 2 = 0)"
    z = ["d1", "d2", "d3", "d4", "z1", "z2"]
    add(
        "cte_nd",
        lambda s, d: rounded(
            api.conditional_transfer_entropy(
                _events(s, d).withColumn("third", F.col("event_id") % 3), "src", ["dst", "cond"], "third", ["ts", "event_id"], series_by=["shard"], src_hist=1, dest_hist=2, cond_hist=2, step=2
            )
        ),
        sql_signed(sql_sets(both, {"xz": ["sp", *z], "yz": ["f1_", "f2_", *z], "xyz": ["f1_", "f2_", "sp", *z], "z": z}, []), mle, CMI_WEIGHTS, []),
    )
    add(
        "local_te",
        lambda s, d: _local(api.transfer_entropy(_events(s, d), "src", "dst", ["ts", "event_id"], ["shard"], 2, 1, 1, local=True)),
        sql_local_te(sql_embedded(2, 1, 1), te_sets(2, 1)),
    )
    dealt = f"""b as (select *, row_number() over (partition by shard order by ts, event_id) as rn from
 (select * from (select shard, ts, event_id, dst as fut, row_number() over w - 1 as t, lag(src) over w as sp1, lag(dst) over w as dp1 from {EVENTS} {window}) where t >= 1)),
 m as (select round, shard, sp1, row_number() over (partition by round, shard order by md5(concat_ws(':', event_id, round))) as rn from b, range(0, 20) r(round)),
 f as (select round, fut, dp1, m.sp1 from b join m using (shard, rn) union all select -1, fut, dp1, sp1 from b)"""
    each = sql_signed(sql_sets("f", te_sets(1, 1), ["round"]), mle, CMI_WEIGHTS, ["round"]).replace("round(sum(", "(sum(").replace(f", {DIGITS}) + 0.0", ")")
    add(
        "effective_te",
        lambda s, d: surrogates.effective_transfer_entropy(_events(s, d), "src", "dst", ["ts", "event_id"], series_by=["shard"], key=["event_id"], digits=DIGITS),
        f"""with {dealt}, e as ({each}), o as (select value as seen, n as rows from e where round = -1), r as (select value from e where round >= 0)
select round(any_value(seen)-avg(value), {DIGITS}) + 0.0 as value, round(any_value(seen), {DIGITS}) + 0.0 as observed, round(avg(value), {DIGITS}) + 0.0 as surrogate_mean,
 round(stddev_samp(value), {DIGITS}) + 0.0 as surrogate_sd, round((sum(case when value >= seen then 1 else 0 end)+1)/(count(*)+1), {DIGITS}) + 0.0 as p_value, any_value(rows) as n from r, o""",
    )
    add(
        "te_history",
        lambda s, d: rounded(api.transfer_entropy(_events(s, d), "src", "dst", ["ts", "event_id"], ["shard"], 2, 3, 2)),
        sql_signed(sql_sets(sql_embedded(2, 3, 2), te_sets(2, 3), []), mle, CMI_WEIGHTS, []),
    )
    add(
        "te_single_series",
        lambda s, d: rounded(api.transfer_entropy(_events(s, d), "src", "dst", ["ts", "event_id"], (), 2, 1, 1)),
        sql_signed(sql_sets(sql_embedded(2, 1, 1, source=f"(select * replace (0 as shard) from {EVENTS})"), te_sets(2, 1), []), mle, CMI_WEIGHTS, []),
    )
    add(
        "joint_entropy",
        lambda s, d: rounded(api.joint_entropy(_lineitem(s, d), ["l_returnflag", "l_linestatus", "l_suppkey"], group_by=["l_linenumber"]), "l_linenumber"),
        sql_signed(sql_sets("lineitem", {"x": ["l_returnflag", "l_linestatus", "l_suppkey"]}, ["l_linenumber"]), mle, {"x": 1.0}, ["l_linenumber"]),
    )
    add(
        "conditional_entropy",
        lambda s, d: rounded(api.conditional_entropy(_lineitem(s, d), "l_returnflag", "l_linestatus", group_by=["l_linenumber"]), "l_linenumber"),
        sql_signed(sql_sets("lineitem", {"xy": ["l_returnflag", "l_linestatus"], "y": ["l_linestatus"]}, ["l_linenumber"]), mle, {"xy": 1.0, "y": -1.0}, ["l_linenumber"]),
    )
    three = {"x": ["o_orderstatus"], "y": ["o_orderpriority"], "z": ["month"], "xyz": ["o_orderstatus", "o_orderpriority", "month"]}
    add(
        "mi_3way",
        lambda s, d: rounded(api.mutual_information(_orders(s, d), ["o_orderstatus", "o_orderpriority", "month"])),
        sql_signed(sql_sets(ORDERS, three, []), mle, {"x": 1.0, "y": 1.0, "z": 1.0, "xyz": -1.0}, []),
    )
    add(
        "entropy_batch_rows",
        lambda s, d: rounded(api.entropy(s.read.parquet(f"{d}/events.parquet"), "event_type", group_by=["user_id"]), "user_id"),
        sql_signed(sql_sets("events", {"x": ["event_type"]}, ["user_id"]), mle, {"x": 1.0}, ["user_id"]),
    )
    local = "ln(count(*) over (partition by {0}) / cast(count(*) over () as double))"
    n, k = "cast(count(*) over () as double)", "(select count(distinct l_returnflag) from lineitem)"
    c = "count(*) over (partition by l_returnflag)"
    sq = "(select sum(n*n) from (select count(*)/(select cast(count(*) as double) from lineitem) as n from lineitem group by l_returnflag))"
    lam = f"greatest(0.0, least(1.0, (1-{sq})/({n}-1)/({sq}-1.0/{k})))"
    per_row = {
        "mle": f"-{local.format('l_returnflag')}",
        "miller_madow": f"-{local.format('l_returnflag')} + ({k}-1)/(2*{n})",
        "shrink": f"-ln({lam}/{k} + (1-{lam})*{c}/{n})",
        "grassberger": f"ln({n}) - {sql_psi(c)} - (case when ({c})%2=0 then 1 else -1 end)/({c}+1)",
        "zhang": f"{sql_psi(n)} - {sql_psi(c)}",
    }
    for name, sql in per_row.items():
        add(
            f"local_entropy_{name}",
            lambda s, d, e=name: api.local_entropy(read(s, d, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag"), "l_returnflag", estimator=e).select(
                "l_orderkey", "l_linenumber", (F.round("local_value", DIGITS) + 0.0).alias("local_value")
            ),
            f"select l_orderkey, l_linenumber, round({sql}, {DIGITS}) + 0.0 as local_value from lineitem",
        )
    add(
        "local_mi",
        lambda s, d: api.local_mutual_information(_orders(s, d), ["o_orderstatus", "o_orderpriority"]).select("o_orderkey", (F.round("local_value", DIGITS) + 0.0).alias("local_value")),
        f"select o_orderkey, round({local.format('o_orderstatus, o_orderpriority')} - {local.format('o_orderstatus')} - {local.format('o_orderpriority')}, {DIGITS}) + 0.0 as local_value from orders",
    )
    add(
        "local_cmi",
        lambda s, d: api.conditional_mutual_information(_orders(s, d), ["o_orderstatus", "o_orderpriority"], "month", local=True).select("o_orderkey", (F.round("local_value", DIGITS) + 0.0).alias("local_value")),
        f"select o_orderkey, round({local.format('o_orderstatus, o_orderpriority, month')} + {local.format('month')} - {local.format('o_orderstatus, month')} - {local.format('o_orderpriority, month')}, {DIGITS}) + 0.0 as local_value from {ORDERS}",
    )


def _register_divergences() -> None:
    def split(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
        o = read(s, d, "orders", "o_orderstatus", "o_orderpriority")
        return o.where("o_orderstatus = 'O'"), o.where("o_orderstatus = 'F'")

    pq = """p as (select o_orderpriority as x, count(*) as n from orders where o_orderstatus = 'O' group by 1), q as (select o_orderpriority as x, count(*) as n from orders where o_orderstatus = 'F' group by 1),
     a as (select sum(n) as np, count(*) as kp from p), b as (select sum(n) as nq, count(*) as kq from q),
     j as (select p.n as pn, q.n as qn, np, nq, kp, kq from p join q using (x), a, b)"""
    cross = {
        "mle": "-sum(pn/np*ln(qn/nq))",
        "miller_madow": "-sum(pn/np*ln(qn/nq)) + ((any_value(kp)+any_value(kq))/2.0 - 1)/(any_value(np)+any_value(nq))",
        "bayes": "-sum((pn+0.5)/(np+kp*0.5)*ln((qn+0.5)/(nq+kq*0.5)))",
    }
    for name, sql in cross.items():
        add(
            f"cross_entropy_{name}",
            lambda s, d, e=name: rounded(api.cross_entropy(*split(s, d), "o_orderpriority", estimator=e)),
            f"with {pq} select round({sql}, {DIGITS}) + 0.0 as value from j",
        )
    add(
        "kl_divergence",
        lambda s, d: rounded(api.kl_divergence(*split(s, d), "o_orderpriority")),
        f"with {pq} select round(sum(pn/np*ln((pn/np)/(qn/nq))), {DIGITS}) + 0.0 as value from j",
    )
    add(
        "js_divergence",
        lambda s, d: rounded(api.js_divergence(split(s, d), "o_orderpriority")),
        f"""with {pq}, m as (select pn/np as u, qn/nq as v, (pn/np + qn/nq)/2 as w from j)
select round(-sum(w*ln(w)) + sum(u*ln(u))/2 + sum(v*ln(v))/2, {DIGITS}) + 0.0 as value from m""",
    )


# ordinal ----------------------------------------------------------------------------------------------------------------


def sql_pattern(order: int, delay: int, col: str = "value", key: str = "shard") -> str:
    """Lehmer codes of argsorts from pairwise comparisons of a window's values."""
    window = f"(partition by {key} order by ts, event_id)"
    leads = ", ".join(f"lead({col}, {j * delay}) over {window} as w{j}" for j in range(order))
    pairs = ", ".join(f"[w{j}, {j}.0]" for j in range(order))
    code = " + ".join(f"{math.factorial(order - 1 - i)}*(case when perm[{i + 1}] > perm[{j + 1}] then 1 else 0 end)" for i in range(order) for j in range(i + 1, order)) or "0"
    return f"""(select *, cast({code} as bigint) as pat from (select *, list_transform(list_sort([{pairs}]), lambda z: z[2]) as perm from (
 select *, lead(event_id, {(order - 1) * delay}) over {window} as last, {leads} from {EVENTS})) where last is not null)"""


def _register_ordinal() -> None:
    for order, delay in ((2, 1), (3, 1), (3, 2), (4, 1)):
        add(
            f"ordinal_entropy_m{order}_d{delay}",
            lambda s, d, m=order, t=delay: rounded(api.entropy(_events(s, d), "value", "ordinal", order=m, delay=t, order_by=["ts", "event_id"], series_by=["shard"], group_by=["shard"]), "shard"),
            sql_signed(sql_sets(sql_pattern(order, delay), {"x": ["pat"]}, ["shard"]), ALL["mle"], {"x": 1.0}, ["shard"]),
        )
    add(
        "ordinal_entropy_single_series",
        lambda s, d: rounded(api.entropy(_events(s, d), "value", "ordinal", order=3, delay=1, order_by=["ts", "event_id"])),
        sql_signed(sql_sets(sql_pattern(3, 1).replace(EVENTS, f"(select * replace (0 as shard) from {EVENTS})"), {"x": ["pat"]}, []), ALL["mle"], {"x": 1.0}, []),
    )
    add(
        "ordinal_patterns",
        lambda s, d: symbolize(_events(s, d), ["value"], 3, ["ts", "event_id"], ["shard"], keep=["event_id"]).select("event_id", F.col("value_pattern").alias("pat")),
        f"select event_id, pat from {sql_pattern(3, 1)}",
    )
    two = sql_pattern(3, 1).replace(EVENTS, f"(select *, value * (event_id % 7) as other from {EVENTS})")
    other = sql_pattern(3, 1, "other").replace(EVENTS, f"(select *, value * (event_id % 7) as other from {EVENTS})")
    both = f"(select a.shard, a.ts, a.event_id, a.pat as px, b.pat as py from {two} a join {other} b using (event_id))"

    def pair(s: SparkSession, d: str) -> DataFrame:
        return _events(s, d).withColumn("other", F.col("value") * (F.col("event_id") % 7))

    sets = {"x": ["px"], "y": ["py"], "xy": ["px", "py"]}
    add(
        "ordinal_mi",
        lambda s, d: rounded(api.mutual_information(pair(s, d), ["value", "other"], "ordinal", order=3, order_by=["ts", "event_id"], series_by=["shard"])),
        sql_signed(sql_sets(both, sets, []), ALL["mle"], {"x": 1.0, "y": 1.0, "xy": -1.0}, []),
    )
    add(
        "ordinal_joint_entropy",
        lambda s, d: rounded(api.entropy(pair(s, d), ["value", "other"], "ordinal", order=3, order_by=["ts", "event_id"], series_by=["shard"])),
        sql_signed(sql_sets(both, {"xy": ["px", "py"]}, []), ALL["mle"], {"xy": 1.0}, []),
    )
    add(
        "ordinal_te",
        lambda s, d: rounded(api.transfer_entropy(pair(s, d), "other", "value", ["ts", "event_id"], ["shard"], approach="ordinal", order=3)),
        sql_signed(sql_sets(sql_embedded(1, 1, 1, source=both, cols=("py", "px", "px")), te_sets(1, 1), []), ALL["mle"], CMI_WEIGHTS, []),
    )
    add(
        "ordinal_local_te",
        lambda s, d: _local(api.transfer_entropy(pair(s, d), "other", "value", ["ts", "event_id"], ["shard"], approach="ordinal", order=3, local=True)),
        sql_local_te(sql_embedded(1, 1, 1, source=both, cols=("py", "px", "px")), te_sets(1, 1)),
    )
    third = f"(select a.*, b.pat as pz from {both} a join (select event_id, pat from {sql_pattern(3, 1, '(value * (event_id % 5))')}) b using (event_id))"
    add(
        "ordinal_cte",
        lambda s, d: rounded(
            api.conditional_transfer_entropy(pair(s, d).withColumn("third", F.col("value") * (F.col("event_id") % 5)), "other", "value", "third", ["ts", "event_id"], series_by=["shard"], approach="ordinal", order=3)
        ),
        sql_signed(sql_sets(sql_embedded(1, 1, 1, 1, source=third, cols=("py", "px", "pz")), te_sets(1, 1, 1), []), ALL["mle"], CMI_WEIGHTS, []),
    )
    add(
        "ordinal_cmi",
        lambda s, d: rounded(
            api.conditional_mutual_information(pair(s, d).withColumn("third", F.col("value") * (F.col("event_id") % 5)), ["value", "other"], "third", "ordinal", order=3, order_by=["ts", "event_id"], series_by=["shard"])
        ),
        sql_signed(sql_sets(third, {"xz": ["px", "pz"], "yz": ["py", "pz"], "xyz": ["px", "py", "pz"], "z": ["pz"]}, []), ALL["mle"], CMI_WEIGHTS, []),
    )
    add(
        "ordinal_cross_entropy",
        lambda s, d: rounded(api.cross_entropy(_events(s, d).where("shard < 4"), _events(s, d).where("shard >= 4"), "value", "ordinal", order=3, order_by=["ts", "event_id"], series_by=["shard"])),
        f"""with z as (select shard, pat from {sql_pattern(3, 1)}), p as (select pat as x, count(*) as n from z where shard < 4 group by 1), q as (select pat as x, count(*) as n from z where shard >= 4 group by 1)
select round(-sum(p.n/(select sum(n) from p)*ln(q.n/(select sum(n) from q))), {DIGITS}) + 0.0 as value from p join q using (x)""",
    )


# kernels and neighbours --------------------------------------------------------------------------------------------------

#: Small tables: the twins join every pair. Part's price and size, the supplier's balance, and the vectors' first components.
PART = "(select p_partkey as id, p_retailprice/1000.0 as x, p_size/50.0 as y, ((p_partkey * 7919) % 101)/101.0 as z from part)"


def _part(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/part.parquet").select(
        F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 1000.0).alias("x"), (F.col("p_size") / 50.0).alias("y"), ((F.col("p_partkey") * 7919) % 101 / 101.0).alias("z")
    )


def _vectors(s: SparkSession, d: str, *more: str) -> DataFrame:
    return s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", *more, *[F.col("embedding")[i].cast("double").alias(f"v{i}") for i in range(4)])


VECTORS = "(select vec_id as id, " + ", ".join(f"cast(embedding[{i + 1}] as double) as v{i}" for i in range(4)) + " from embeddings)"


def sql_box(source: str, spaces: dict[str, list[str]], bw: float) -> str:
    near = {c: f"abs(a.{c}-b.{c}) <= {bw / 2!r} + 1e-15" for cols in spaces.values() for c in cols}
    sums = ", ".join(f"sum(case when {' and '.join(near[c] for c in cols)} then 1.0 else 0.0 end)/((select count(*) from pts)*pow({bw},{len(cols)})) as {n}" for n, cols in spaces.items())
    return f"pts as (select * from {source}), d as (select a.id, {sums} from pts a, pts b group by a.id)"


def sql_gaussian(source: str, spaces: dict[str, list[str]], bw: float, cut: bool = True) -> str:
    """Gaussian densities of subspaces, in coordinates solved from a Cholesky factor that is written out; without ``cut``, all pairs count."""
    cols = sorted({c for s in spaces.values() for c in s})
    cov = ", ".join(f"{bw * bw!r}*covar_samp({a},{b}) as s_{a}_{b}" for i, a in enumerate(cols) for b in cols[i:])
    factors, whitened, sums = [], [], []
    for name, dims in spaces.items():
        for i, a in enumerate(dims):
            for j in range(i + 1):
                s = "s_{}_{}".format(*sorted((a, dims[j])))
                rest = s + "".join(f" - {name}_{i}{k}*{name}_{j}{k}" for k in range(j))
                factors.append(f"{f'sqrt({rest})' if i == j else f'({rest})/{name}_{j}{j}'} as {name}_{i}{j}")
            whitened.append(f"({a}" + "".join(f" - {name}_{i}{k}*{name}_x{k}" for k in range(i)) + f")/{name}_{i}{i} as {name}_x{i}")
        q = " + ".join(f"pow(a.{name}_x{i}-b.{name}_x{i},2)" for i in range(len(dims)))
        norm = f"any_value(a.n)*pow(2*pi(), {len(dims) / 2})*any_value({'*'.join(f'a.{name}_{i}{i}' for i in range(len(dims)))})"
        sums.append(f"sum(case when {q} <= a.cut then exp(-0.5*({q})) else 0 end)/({norm}) as {name}" if cut else f"sum(exp(-0.5*({q})))/({norm}) as {name}")
    limit = " case when count(*) <= 5000 then 64 else 36 end as cut," if cut else ""
    return f"""pts as (select * from {source}), m as (select count(*) as n,{limit} {cov} from pts), f as (select *, {', '.join(factors)} from m),
w as (select id, f.*, {', '.join(whitened)} from pts, f), d as (select a.id, {', '.join(sums)} from w a, w b group by a.id)"""


def sql_knn(source: str, cols: list[str], k: int, metric: str, target: str | None = None) -> str:
    dist = {
        "chebyshev": f"greatest({', '.join(f'abs(a.{c}-b.{c})' for c in cols)})" if len(cols) > 1 else f"abs(a.{cols[0]}-b.{cols[0]})",
        "euclidean": f"sqrt({' + '.join(f'(a.{c}-b.{c})*(a.{c}-b.{c})' for c in cols)})",
        "manhattan": " + ".join(f"abs(a.{c}-b.{c})" for c in cols),
    }.get(metric) or f"pow({' + '.join(f'pow(abs(a.{c}-b.{c}), {metric})' for c in cols)}, 1/{metric})"
    rank = k if target else k + 1
    return f"""pts as (select * from {source}), oth as (select * from {target or source}),
r as (select id, rho from (select a.id, {dist} as rho, row_number() over (partition by a.id order by {dist}) as rk from pts a, oth b) where rk = {rank})"""


def _register_kernel() -> None:
    for bw in (0.3, 1.0):
        add(
            f"box_entropy_1d_bw{bw}",
            lambda s, d, b=bw: rounded(api.entropy(_part(s, d), "x", "kernel", bandwidth=b)),
            f"with {sql_box(PART, {'d': ['x']}, bw)} select round(-avg(ln(d)), {DIGITS}) + 0.0 as value, count(*) as n from d",
        )
    add(
        "box_entropy_3d",
        lambda s, d: rounded(api.entropy(_part(s, d), ["x", "y", "z"], "kernel", bandwidth=0.5)),
        f"with {sql_box(PART, {'d': ['x', 'y', 'z']}, 0.5)} select round(-avg(ln(d)), {DIGITS}) + 0.0 as value, count(*) as n from d",
    )
    add(
        "box_mi",
        lambda s, d: rounded(api.mutual_information(_part(s, d), ["x", "y"], "kernel", bandwidth=0.4)),
        f"with {sql_box(PART, {'xy': ['x', 'y'], 'dx': ['x'], 'dy': ['y']}, 0.4)} select round(avg(ln(xy)-ln(dx)-ln(dy)), {DIGITS}) + 0.0 as value, count(*) as n from d",
    )
    add(
        "box_cmi",
        lambda s, d: rounded(api.conditional_mutual_information(_part(s, d), ["x", "y"], "z", "kernel", bandwidth=0.4)),
        f"with {sql_box(PART, {'xyz': ['x', 'y', 'z'], 'dz': ['z'], 'xz': ['x', 'z'], 'yz': ['y', 'z']}, 0.4)} select round(avg(ln(xyz)+ln(dz)-ln(xz)-ln(yz)), {DIGITS}) + 0.0 as value, count(*) as n from d",
    )
    add(
        "box_cross_entropy",
        lambda s, d: rounded(api.cross_entropy(_part(s, d).where("z < 0.5"), _part(s, d).where("z >= 0.5"), ["x", "y"], "kernel", bandwidth=0.4)),
        f"""with p as (select * from {PART} where z < 0.5), q as (select * from {PART} where z >= 0.5),
d as (select p.id, sum(case when abs(p.x-q.x) <= 0.2 + 1e-15 and abs(p.y-q.y) <= 0.2 + 1e-15 then 1.0 else 0 end)/((select count(*) from q)*0.16) as d from p, q group by p.id)
select round(-avg(case when d > 0 then ln(d) else 0 end), {DIGITS}) + 0.0 as value, count(*) as n from d""",
    )
    lagged = "(select * from (select event_id as id, value/100.0 as y, row_number() over w - 1 as t, lag(value/100.0) over w as yp, lag((event_id % 13)/13.0) over w as xp from events window w as (order by ts, event_id)) where t >= 1)"

    def series(s: SparkSession, d: str) -> DataFrame:
        return s.read.parquet(f"{d}/events.parquet").select("ts", "event_id", (F.col("value") / 100.0).alias("y"), ((F.col("event_id") % 13) / 13.0).alias("x"))

    add(
        "box_te",
        lambda s, d: rounded(api.transfer_entropy(series(s, d), "x", "y", ["ts", "event_id"], approach="kernel", bandwidth=0.5)),
        f"with {sql_box(lagged, {'xyz': ['y', 'xp', 'yp'], 'dz': ['yp'], 'xz': ['xp', 'yp'], 'yz': ['y', 'yp']}, 0.5)} select round(avg(ln(xyz)+ln(dz)-ln(xz)-ln(yz)), {DIGITS}) + 0.0 as value, count(*) as n from d",
    )
    gauss1 = f"pts as (select * from {PART}), m as (select count(*) as n, stddev_samp(x)*0.5 as sd from pts), d as (select a.id, sum(case when pow((a.x-b.x)/sd,2) <= 64 then exp(-0.5*pow((a.x-b.x)/sd,2)) else 0 end)/(any_value(n)*sqrt(2*pi())*any_value(sd)) as d from pts a, pts b, m group by a.id)"
    add(
        "gaussian_entropy_1d",
        lambda s, d: rounded(api.entropy(_part(s, d), "x", "kernel", kernel="gaussian", bandwidth=0.5)),
        f"with {gauss1} select round(-avg(ln(d)), {DIGITS}) + 0.0 as value, count(*) as n from d",
    )
    # two dimensions: squared Mahalanobis distance and determinant of the scaled covariance, written out
    gauss2 = f"""pts as (select * from {PART}), m as (select count(*) as n, 0.25*var_samp(x) as sxx, 0.25*var_samp(y) as syy, 0.25*covar_samp(x,y) as sxy from pts),
q as (select a.id, (syy*pow(a.x-b.x,2) - 2*sxy*(a.x-b.x)*(a.y-b.y) + sxx*pow(a.y-b.y,2))/(sxx*syy-sxy*sxy) as qxy, pow(a.x-b.x,2)/sxx as qx, pow(a.y-b.y,2)/syy as qy, n, sxx, syy, sxy from pts a, pts b, m),
d as (select id, sum(case when qxy<=64 then exp(-0.5*qxy) else 0 end)/(any_value(n)*2*pi()*sqrt(any_value(sxx*syy-sxy*sxy))) as dxy, sum(case when qx<=64 then exp(-0.5*qx) else 0 end)/(any_value(n)*sqrt(2*pi()*any_value(sxx))) as dx,
 sum(case when qy<=64 then exp(-0.5*qy) else 0 end)/(any_value(n)*sqrt(2*pi()*any_value(syy))) as dy from q group by id)"""
    add(
        "gaussian_entropy_2d",
        lambda s, d: rounded(api.entropy(_part(s, d), ["x", "y"], "kernel", kernel="gaussian", bandwidth=0.5)),
        f"with {gauss2} select round(-avg(ln(dxy)), {DIGITS}) + 0.0 as value, count(*) as n from d",
    )
    add(
        "gaussian_mi",
        lambda s, d: rounded(api.mutual_information(_part(s, d), ["x", "y"], "kernel", kernel="gaussian", bandwidth=0.5)),
        f"with {gauss2} select round(avg(ln(dxy)-ln(dx)-ln(dy)), {DIGITS}) + 0.0 as value, count(*) as n from d",
    )
    cmi = f"select round(avg(ln(xyz)+ln(dz)-ln(xz)-ln(yz)), {DIGITS}) + 0.0 as value, count(*) as n from d"
    add(
        "gaussian_cmi",
        lambda s, d: rounded(api.conditional_mutual_information(_part(s, d), ["x", "y"], "z", "kernel", kernel="gaussian", bandwidth=0.5)),
        f"with {sql_gaussian(PART, {'xyz': ['x', 'y', 'z'], 'dz': ['z'], 'xz': ['x', 'z'], 'yz': ['y', 'z']}, 0.5, cut=False)} {cmi}",
    )
    add(
        "gaussian_te",
        lambda s, d: rounded(api.transfer_entropy(series(s, d), "x", "y", ["ts", "event_id"], approach="kernel", kernel="gaussian", bandwidth=0.5)),
        f"with {sql_gaussian(lagged, {'xyz': ['y', 'xp', 'yp'], 'dz': ['yp'], 'xz': ['xp', 'yp'], 'yz': ['y', 'yp']}, 0.5, cut=False)} {cmi}",
    )
    past = f"(select * from (select id, y, row_number() over w - 1 as t, lag(y) over w as yp, lag(x) over w as xp, lag(z) over w as zp from {PART} window w as (order by id)) where t >= 1)"
    spaces = {"xyz": ["y", "xp", "yp", "zp"], "dz": ["yp", "zp"], "xz": ["xp", "yp", "zp"], "yz": ["y", "yp", "zp"]}
    for kind, sql in (("box", sql_box), ("gaussian", sql_gaussian)):
        add(
            f"{kind}_cte",
            lambda s, d, k=kind: rounded(api.conditional_transfer_entropy(_part(s, d), "x", "y", "z", ["id"], approach="kernel", kernel=k, bandwidth=0.5)),
            f"with {sql(past, spaces, 0.5)} {cmi}",
        )
        add(
            f"{kind}_local_entropy",
            lambda s, d, k=kind: _local(api.local_entropy(_part(s, d), ["x", "y"], "kernel", kernel=k, bandwidth=0.4)),
            f"with {sql(PART, {'d': ['x', 'y']}, 0.4)} select round(-ln(d), {DIGITS}) + 0.0 as local_value from d",
        )
        add(
            f"{kind}_local_mi",
            lambda s, d, k=kind: _local(api.local_mutual_information(_part(s, d), ["x", "y"], "kernel", kernel=k, bandwidth=0.4)),
            f"with {sql(PART, {'xy': ['x', 'y'], 'dx': ['x'], 'dy': ['y']}, 0.4)} select round(ln(xy)-ln(dx)-ln(dy), {DIGITS}) + 0.0 as local_value from d",
        )
    add(
        "gaussian_cross_entropy",
        lambda s, d: rounded(api.cross_entropy(_part(s, d).where("z < 0.5"), _part(s, d).where("z >= 0.5"), ["x", "y"], "kernel", kernel="gaussian", bandwidth=0.5)),
        f"""with p as (select * from {PART} where z < 0.5), q as (select * from {PART} where z >= 0.5),
m as (select count(*) as n, case when count(*) <= 5000 then 64 else 36 end as cut, 0.25*var_samp(x) as sxx, 0.25*var_samp(y) as syy, 0.25*covar_samp(x,y) as sxy from q),
c as (select p.id, n, cut, sxx*syy-sxy*sxy as det, (syy*pow(p.x-q.x,2) - 2*sxy*(p.x-q.x)*(p.y-q.y) + sxx*pow(p.y-q.y,2))/(sxx*syy-sxy*sxy) as g from p, q, m),
d as (select id, sum(case when g <= cut then exp(-0.5*g) else 0 end)/(any_value(n)*2*pi()*sqrt(any_value(det))) as d from c group by id)
select round(-avg(case when d > 0 then ln(d) else 0 end), {DIGITS}) + 0.0 as value, count(*) as n from d""",
    )


def sql_kl(dim: int, k: int, volume: float, variant: int = 1) -> str:
    fix = knn.digamma_value(k)
    return f"select round({sql_psi('count(*)')} - {fix!r} + {(1 / k if variant == 2 else 0.0)!r} + {math.log(volume)!r} + {dim}*avg(case when rho > 0 then ln(2*rho) end), {DIGITS}) + 0.0 as value, count(*) as n from r"


def _register_knn() -> None:
    v = ["v0", "v1", "v2", "v3"]
    ball = {"chebyshev": 1.0, "euclidean": math.pi**2 / 2 * 0.5**4, "manhattan": 2**4 * 0.5**4 / 24}
    for metric, volume in ball.items():
        add(
            f"kl_entropy_4d_{metric}",
            lambda s, d, m=metric: rounded(api.entropy(_vectors(s, d), v, "kl", k=4, metric=m)),
            f"with {sql_knn(VECTORS, v, 4, metric)} {sql_kl(4, 4, volume)}",
        )
    add("kl_entropy_1d_type2", lambda s, d: rounded(api.entropy(_vectors(s, d), "v0", "kl", k=3, variant=2)), f"with {sql_knn(VECTORS, ['v0'], 3, 'chebyshev')} {sql_kl(1, 3, 1.0, 2)}")
    by_label = f"pts as (select vec_id as id, label, cast(embedding[1] as double) as v0 from embeddings)"
    near = f"{by_label}, r as (select label, rho from (select a.label, a.id, abs(a.v0-b.v0) as rho, row_number() over (partition by a.id order by abs(a.v0-b.v0)) as rk from pts a join pts b using (label)) where rk = 4)"
    add(
        "kl_entropy_grouped",
        lambda s, d: rounded(api.entropy(_vectors(s, d, "label"), "v0", "kl", k=3, group_by=["label"]), "label"),
        f"with {near} {sql_kl(1, 3, 1.0).replace('select round', 'select label, round')} group by label",
    )
    add(
        "box_entropy_grouped",
        lambda s, d: rounded(api.entropy(_vectors(s, d, "label"), "v0", "kernel", bandwidth=0.1, group_by=["label"]), "label"),
        f"""with {by_label}, d as (select label, a.id, sum(case when abs(a.v0-b.v0) <= 0.05 + 1e-15 then 1.0 else 0 end)/(count(*)*0.1) as d from pts a join pts b using (label) group by label, a.id)
select label, round(-avg(ln(d)), {DIGITS}) + 0.0 as value, count(*) as n from d group by label""",
    )
    for power in (3.0, 0.5):
        add(
            f"kl_entropy_minkowski_{str(power).replace('.', '_')}",
            lambda s, d, p=power: rounded(api.entropy(_vectors(s, d), v[:3], "kl", k=4, metric=p)),
            f"with {sql_knn(VECTORS, v[:3], 4, repr(power))} {sql_kl(3, 4, math.gamma(1 + 1 / power) ** 3 / math.gamma(1 + 3 / power))}",
        )
    add(  # noise far below the digits that are compared
        "kl_entropy_noise",
        lambda s, d: rounded(api.entropy(_vectors(s, d), v, "kl", k=4, noise=1e-13, seed=5)),
        f"with {sql_knn(VECTORS, v, 4, 'chebyshev')} {sql_kl(4, 4, 1.0)}",
    )
    near4 = near.replace("where rk = 4", "where rk = 5")
    grouped_i = f"(pow((count(*)-1)*{(math.gamma(4) / math.gamma(5 - 1.2)) ** (1 / (1 - 1.2)) * 2.0!r}, {1 - 1.2!r})*sum(case when rho > 0 then pow(rho, {1 - 1.2!r}) else 0 end)/count(*))"
    for name, more, value in (("renyi", {"alpha": 1.2}, f"ln({grouped_i})/{1 - 1.2!r}"), ("tsallis", {"q": 1.2}, f"({grouped_i}-1)/{1 - 1.2!r}")):
        add(
            f"{name}_entropy_grouped",
            lambda s, d, a=name, o=more: rounded(api.entropy(_vectors(s, d, "label"), "v0", a, group_by=["label"], **o), "label"),
            f"with {near4} select label, round({value}, {DIGITS}) + 0.0 as value, count(*) as n from r group by label",
        )
    add(
        "gaussian_entropy_grouped",
        lambda s, d: rounded(api.entropy(_vectors(s, d, "label"), "v0", "kernel", kernel="gaussian", bandwidth=0.5, group_by=["label"]), "label"),
        f"""with {by_label}, m as (select label, count(*) as n, case when count(*) <= 5000 then 64 else 36 end as cut, stddev_samp(v0)*0.5 as sd from pts group by label),
d as (select a.label, a.id, sum(case when pow((a.v0-b.v0)/sd,2) <= cut then exp(-0.5*pow((a.v0-b.v0)/sd,2)) else 0 end)/(any_value(n)*sqrt(2*pi())*any_value(sd)) as d from pts a join pts b using (label) join m using (label) group by a.label, a.id)
select label, round(-avg(ln(d)), {DIGITS}) + 0.0 as value, count(*) as n from d group by label""",
    )
    for order in (0.6, 1.0, 1.2, 1.8):
        d, k, vol = 2, 4, math.pi
        if order == 1.0:
            both = f"({d}*sum(case when rho > 0 then ln(rho) else 0 end) + count(*)*ln((count(*)-1)*{math.exp(-knn.digamma_value(k)) * vol!r}))/count(*)"
            renyi = tsallis = both
        else:
            c = (math.gamma(k) / math.gamma(k + 1 - order)) ** (1 / (1 - order))
            i = f"(pow((count(*)-1)*{c * vol!r}, {1 - order!r})*sum(case when rho > 0 then pow(rho, {d * (1 - order)!r}) else 0 end)/count(*))"
            renyi, tsallis = f"ln({i})/{1 - order!r}", f"({i}-1)/{1 - order!r}"
        name = str(order).replace(".", "_")
        knn_sql = sql_knn(VECTORS, v[:2], k, "euclidean")
        add(f"renyi_entropy_{name}", lambda s, d_, a=order: rounded(api.entropy(_vectors(s, d_), v[:2], "renyi", alpha=a)), f"with {knn_sql} select round({renyi}, {DIGITS}) + 0.0 as value, count(*) as n from r")
        add(f"tsallis_entropy_{name}", lambda s, d_, a=order: rounded(api.entropy(_vectors(s, d_), v[:2], "tsallis", q=a)), f"with {knn_sql} select round({tsallis}, {DIGITS}) + 0.0 as value, count(*) as n from r")

    def halves(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
        x = _vectors(s, d, "label")
        return x.where("label < 5"), x.where("label >= 5")

    vectors = VECTORS.replace(" from embeddings", ", label from embeddings")
    p, q = f"(select * from {vectors} where label < 5)", f"(select * from {vectors} where label >= 5)"
    add(
        "kl_cross_entropy",
        lambda s, d: rounded(api.cross_entropy(*halves(s, d), v[:2], "kl", k=4)),
        f"with {sql_knn(p, v[:2], 4, 'chebyshev', q)} select round(-{knn.digamma_value(4)!r} + {sql_psi('(select count(*) from oth)')} + 2*avg(case when rho>0 then ln(rho) end) + 2*ln(2), {DIGITS}) + 0.0 as value, count(*) as n from r",
    )
    c = (math.gamma(4) / math.gamma(5 - 1.2)) ** (1 / -0.2)
    i = f"(pow((count(*)-1)*{c * math.pi!r}, -0.2)*sum(case when rho > 0 then pow(rho, {2 * (1 - 1.2)!r}) else 0 end)/count(*))".replace("-0.2)*sum", f"{1 - 1.2!r})*sum")
    add("renyi_cross_entropy", lambda s, d: rounded(api.cross_entropy(*halves(s, d), v[:2], "renyi", alpha=1.2)), f"with {sql_knn(p, v[:2], 4, 'euclidean', q)} select round(ln({i})/{1 - 1.2!r}, {DIGITS}) + 0.0 as value, count(*) as n from r")
    add("tsallis_cross_entropy", lambda s, d: rounded(api.cross_entropy(*halves(s, d), v[:2], "tsallis", q=1.2)), f"with {sql_knn(p, v[:2], 4, 'euclidean', q)} select round(({i}-1)/{1 - 1.2!r}, {DIGITS}) + 0.0 as value, count(*) as n from r")

    def ksg_sql(spaces: dict[str, list[str]], variant: int, given: bool, n_vars: int, source: str = VECTORS, cols: list[str] | None = None, k: int = 4, metric: str = "chebyshev", base: float = math.e, local: bool = False) -> str:
        cols = cols or sorted({c for s in spaces.values() for c in s})
        cmp = "<" if variant == 1 else "<="
        counts = ", ".join(f"sum(case when greatest({', '.join(f'abs(a.{c}-b.{c})' for c in s)}, 0) {cmp} rho then 1 else 0 end) as {n}" for n, s in spaces.items())

        def psi(n: str) -> str:
            return sql_psi(f"greatest({n}-1, 0)+1" if variant == 1 else n)

        fix = knn.digamma_value(k) - (1 / k if variant == 2 else 0.0)
        if given:
            term = f"{fix!r} + {psi('nz')} - {psi('n0')} - {psi('n1')}"
        else:
            term = f"{fix!r} + {n_vars - 1}*{sql_psi('(select count(*) from pts)')} - " + " - ".join(psi(n) for n in spaces)
        cnt = f"with {sql_knn(source, cols, k, metric)}, cnt as (select a.id, {counts} from pts a join r using (id), pts b group by a.id)"
        if local:
            return f"{cnt} select round(({term})/{math.log(base)!r}, {DIGITS}) + 0.0 as local_value from cnt"
        return f"{cnt} select round(avg({term})/{math.log(base)!r}, {DIGITS}) + 0.0 as value, count(*) as n from cnt"

    for variant in (1, 2):
        add(
            f"ksg_mi_type{variant}",
            lambda s, d, t=variant: rounded(api.mutual_information(_vectors(s, d), ["v0", "v1"], "ksg", variant=t)),
            ksg_sql({"n0": ["v0"], "n1": ["v1"]}, variant, False, 2),
        )
        add(
            f"ksg_cmi_type{variant}",
            lambda s, d, t=variant: rounded(api.conditional_mutual_information(_vectors(s, d), ["v0", "v1"], "v2", "ksg", variant=t)),
            ksg_sql({"n0": ["v0", "v2"], "n1": ["v1", "v2"], "nz": ["v2"]}, variant, True, 2),
        )
    for metric in ("euclidean", "manhattan"):
        add(
            f"ksg_mi_{metric}_bits",
            lambda s, d, m=metric: rounded(api.mutual_information(_vectors(s, d), ["v0", "v1"], "ksg", metric=m, base=2)),
            ksg_sql({"n0": ["v0"], "n1": ["v1"]}, 1, False, 2, metric=metric, base=2),
        )
    add("ksg_local_mi", lambda s, d: _local(api.local_mutual_information(_vectors(s, d), ["v0", "v1"], "ksg")), ksg_sql({"n0": ["v0"], "n1": ["v1"]}, 1, False, 2, local=True))
    add(
        "ksg_local_cmi",
        lambda s, d: _local(api.conditional_mutual_information(_vectors(s, d), ["v0", "v1"], "v2", "ksg", variant=2, local=True)),
        ksg_sql({"n0": ["v0", "v2"], "n1": ["v1", "v2"], "nz": ["v2"]}, 2, True, 2, local=True),
    )
    add("ksg_mi_3way", lambda s, d: rounded(api.mutual_information(_vectors(s, d), ["v0", "v1", ["v2", "v3"]], "ksg")), ksg_sql({"n0": ["v0"], "n1": ["v1"], "n2": ["v2", "v3"]}, 1, False, 3))
    lagged = "(select * from (select vec_id as id, cast(embedding[1] as double) as y, row_number() over w - 1 as t, lag(cast(embedding[1] as double)) over w as yp, lag(cast(embedding[2] as double)) over w as xp, lag(cast(embedding[3] as double)) over w as zp from embeddings window w as (order by vec_id)) where t >= 1)"
    add(
        "ksg_te",
        lambda s, d: rounded(api.transfer_entropy(_vectors(s, d), "v1", "v0", ["vec_id"], approach="ksg")),
        ksg_sql({"n0": ["xp", "yp"], "n1": ["y", "yp"], "nz": ["yp"]}, 1, True, 2, lagged, ["y", "xp", "yp"]),
    )
    add(
        "ksg_te_type2",
        lambda s, d: rounded(api.transfer_entropy(_vectors(s, d), "v1", "v0", ["vec_id"], approach="ksg", variant=2)),
        ksg_sql({"n0": ["xp", "yp"], "n1": ["y", "yp"], "nz": ["yp"]}, 2, True, 2, lagged, ["y", "xp", "yp"]),
    )
    add(
        "ksg_cte_type2",
        lambda s, d: rounded(api.conditional_transfer_entropy(_vectors(s, d), "v1", "v0", "v2", ["vec_id"], approach="ksg", variant=2)),
        ksg_sql({"n0": ["xp", "yp", "zp"], "n1": ["y", "yp", "zp"], "nz": ["yp", "zp"]}, 2, True, 2, lagged, ["y", "xp", "yp", "zp"]),
    )
    add(
        "ksg_cte",
        lambda s, d: rounded(api.conditional_transfer_entropy(_vectors(s, d), "v1", "v0", "v2", ["vec_id"], approach="ksg")),
        ksg_sql({"n0": ["xp", "yp", "zp"], "n1": ["y", "yp", "zp"], "nz": ["yp", "zp"]}, 1, True, 2, lagged, ["y", "xp", "yp", "zp"]),
    )

    def order_sql(kind: str, dim: int, order: float = 1.2, k: int = 4) -> str:
        ball = math.pi ** (dim / 2) / math.gamma(dim / 2 + 1)
        c = (math.gamma(k) / math.gamma(k + 1 - order)) ** (1 / (1 - order))
        i = f"(pow((count(*)-1)*{c * ball!r}, {1 - order!r})*sum(case when rho > 0 then pow(rho, {dim * (1 - order)!r}) else 0 end)/count(*))"
        return f"select {f'ln({i})' if kind == 'renyi' else f'({i}-1)'}/{1 - order!r} as value from r"

    def kl_sum(weights: dict[tuple[str, ...], float], source: str = VECTORS, kind: str = "kl") -> str:
        parts = []
        for j, (cols, w) in enumerate(weights.items()):
            whole = sql_kl(len(cols), 4, 1.0).replace("round(", "(").replace(f", {DIGITS}) + 0.0", ")") if kind == "kl" else order_sql(kind, len(cols))
            parts.append(f"select {w} * (select value from (with {sql_knn(source, list(cols), 4, 'chebyshev' if kind == 'kl' else 'euclidean')} {whole}) t{j}) as v")
        return f"select round(sum(v), {DIGITS}) + 0.0 as value, (select count(*) from {source}) as n from ({' union all '.join(parts)})"

    signs = {
        "mi": (VECTORS, {("v0",): 1.0, ("v1",): 1.0, ("v0", "v1"): -1.0}),
        "cmi": (VECTORS, {("v0", "v2"): 1.0, ("v1", "v2"): 1.0, ("v0", "v1", "v2"): -1.0, ("v2",): -1.0}),
        "te": (lagged, {("xp", "yp"): 1.0, ("y", "yp"): 1.0, ("y", "xp", "yp"): -1.0, ("yp",): -1.0}),
        "cte": (lagged, {("xp", "yp", "zp"): 1.0, ("y", "yp", "zp"): 1.0, ("y", "xp", "yp", "zp"): -1.0, ("yp", "zp"): -1.0}),
    }
    sql = {(a, m): kl_sum(weights, source, a) for a in ("kl", "renyi", "tsallis") for m, (source, weights) in signs.items()}
    for a, more in (("kl", {}), ("renyi", {"alpha": 1.2}), ("tsallis", {"q": 1.2})):
        add(f"{a}_mi", lambda s, d, a=a, o=more: rounded(api.mutual_information(_vectors(s, d), ["v0", "v1"], a, **o)), sql[a, "mi"])
        add(f"{a}_cmi", lambda s, d, a=a, o=more: rounded(api.conditional_mutual_information(_vectors(s, d), ["v0", "v1"], "v2", a, **o)), sql[a, "cmi"])
        add(f"{a}_te", lambda s, d, a=a, o=more: rounded(api.transfer_entropy(_vectors(s, d), "v1", "v0", ["vec_id"], approach=a, **o)), sql[a, "te"])
        add(f"{a}_cte", lambda s, d, a=a, o=more: rounded(api.conditional_transfer_entropy(_vectors(s, d), "v1", "v0", "v2", ["vec_id"], approach=a, **o)), sql[a, "cte"])
    add(
        "kl_local_entropy",
        lambda s, d: api.local_entropy(_vectors(s, d), v[:2], "kl").select((F.round("local_value", DIGITS) + 0.0).alias("local_value")),
        f"with {sql_knn(VECTORS, v[:2], 4, 'chebyshev')} select round({sql_psi('(select count(*) from r)')} - {knn.digamma_value(4)!r} + 2*(case when rho > 0 then ln(2*rho) else 0 end), {DIGITS}) + 0.0 as local_value from r",
    )


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutual information of return flag and line status for each line number."""
    return QUERIES["mi_mle"](spark, sf_dir)


_register_discrete()
_register_divergences()
_register_ordinal()
_register_kernel()
_register_knn()
