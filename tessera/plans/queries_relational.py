"""Queries over metadata, joins, sets and pivots."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.numeric import r6
from tessera.operators import relational
from tessera.plans import inputs
from tessera.plans.inputs import META_SQL
from tessera.session import table

QUERIES: dict = {}
ORACLES: dict = {}
KINDS = ["view", "click", "purchase", "signup", "logout"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {META_SQL} SELECT d.doc_id AS pID, d.n_chars, m.dx, m.mmse FROM documents d LEFT JOIN meta m ON d.doc_id = m.pID")
def meta_merge(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pID"), "n_chars")
    return relational.merge_with_meta(d, inputs.meta(spark, sf_dir).select("pID", "dx", "mmse"))


_FLAGS = ", ".join(f"CAST(max(CASE WHEN event_type = '{k}' THEN 1 ELSE 0 END) AS INTEGER) AS has_{k}" for k in KINDS)


@query(f"SELECT user_id AS pID, {_FLAGS} FROM events GROUP BY user_id")
def availability_matrix(spark, sf_dir):
    a = relational.availability(inputs.measures(spark, sf_dir), "pID", "srcID", KINDS)
    return a.select("pID", *(F.col(k).alias(f"has_{k}") for k in KINDS))


@query(f"WITH a AS (SELECT user_id AS pID, {_FLAGS} FROM events GROUP BY user_id) SELECT pID FROM a WHERE {' AND '.join(f'has_{k} = 1' for k in ('view', 'click'))} AND pID NOT IN (3, 7, 11)")
def inclusion_filter(spark, sf_dir):
    a = availability_matrix(spark, sf_dir)
    return a.where("has_view = 1 and has_click = 1").where(~F.col("pID").isin(3, 7, 11)).select("pID")


@query("""WITH a AS (SELECT c_nationkey AS k, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS rn FROM customer),
b AS (SELECT s_nationkey AS k, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS rn FROM supplier)
SELECT a.k AS nation, a.rn AS place, c_custkey, s_suppkey FROM a JOIN b ON a.k = b.k AND a.rn = b.rn""")
def positional_join(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("a_nation"), "c_custkey", "c_acctbal")
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("b_nation"), "s_suppkey", "s_acctbal")
    p = relational.pair_by_position(a, b, ["c_acctbal", "c_custkey"], ["s_acctbal", "s_suppkey"], "a_nation", "b_nation")
    return p.select(F.col("a_nation").alias("nation"), F.col("_rn").cast("long").alias("place"), "c_custkey", "s_suppkey")


@query(f"""WITH {META_SQL}, g AS (SELECT doc_id AS pID, source AS srcID, CAST(length(text) AS DOUBLE) AS gc FROM documents), p AS (SELECT doc_id AS pID, source AS srcID, CAST(n_chars AS DOUBLE) / 7 AS P_diff FROM documents)
SELECT m.srcID, m.pID, m.dx, m.mmse, round(p.P_diff, 6) + 0 AS P_diff, g.gc FROM meta m LEFT JOIN g ON m.srcID = g.srcID AND m.pID = g.pID LEFT JOIN p ON m.srcID = p.srcID AND m.pID = p.pID WHERE p.P_diff IS NOT NULL AND g.gc IS NOT NULL AND m.mmse IS NOT NULL""")
def combined_results(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    key = [F.col("doc_id").alias("pID"), F.col("source").alias("srcID")]
    g = d.select(*key, F.length("text").cast("double").alias("gc"))
    p = d.select(*key, (F.col("n_chars") / 7).alias("P_diff"))
    m = inputs.meta(spark, sf_dir).select("srcID", "pID", "dx", "mmse")
    return relational.combine(m, [g, p], ["srcID", "pID"], ["mmse", "P_diff", "gc"]).select("srcID", "pID", "dx", "mmse", r6(F.col("P_diff")).alias("P_diff"), "gc")


@query("""SELECT 'both' AS part, count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)
UNION ALL SELECT 'unlabelled', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
UNION ALL SELECT 'either', count(*) FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels)
UNION ALL SELECT 'all', count(*) FROM (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels)""")
def set_ops(spark, sf_dir):
    a, b = (table(spark, sf_dir, t).select("doc_id") for t in ("documents", "labels"))
    parts = {"both": a.intersect(b), "unlabelled": a.subtract(b), "either": a.union(b).distinct(), "all": a.unionAll(b)}
    out = None
    for k, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("part"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT DISTINCT d.source AS srcID FROM documents d WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def key_intersection(spark, sf_dir):
    toxic = table(spark, sf_dir, "labels").where("toxic = 1")
    return table(spark, sf_dir, "documents").join(toxic, "doc_id", "left_semi").select(F.col("source").alias("srcID")).distinct()


@query(f"SELECT user_id AS pID, {', '.join(f'round(avg(CASE WHEN event_type = {chr(39)}{k}{chr(39)} THEN value END), 6) + 0 AS {k}' for k in KINDS)} FROM events GROUP BY user_id")
def pivot_wide(spark, sf_dir):
    p = inputs.measures(spark, sf_dir).groupBy("pID").pivot("srcID", KINDS).avg("value")
    return p.select("pID", *(r6(F.col(k)).alias(k) for k in KINDS))


@query(f"WITH {META_SQL} SELECT lang, count(*) AS n, sum(CASE WHEN dx = 'Control' THEN 1 ELSE 0 END)::BIGINT AS n_control, round(avg(CASE WHEN dx = 'Control' THEN 1.0 ELSE 0.0 END), 6) + 0 AS share_control FROM meta GROUP BY lang")
def crosstab_dx(spark, sf_dir):
    control = F.col("dx") == "Control"
    return inputs.meta(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(control).alias("n_control"), r6(F.avg(control.cast("double"))).alias("share_control"))


@query("""WITH m AS (SELECT event_type AS srcID, avg(value) AS v FROM events GROUP BY 1)
SELECT CASE srcID WHEN 'view' THEN 'Manual' WHEN 'click' THEN 'W-Tiny' ELSE srcID END AS name, row_number() OVER (ORDER BY v, srcID) AS place FROM m""")
def source_order(spark, sf_dir):
    o = relational.order_by_mean(inputs.measures(spark, sf_dir), "srcID", "value")
    return o.select(relational.recode(F.col("srcID"), {"view": "Manual", "click": "W-Tiny"}).alias("name"), F.col("place").cast("long").alias("place"))


@query("""WITH a AS (SELECT n_nationkey, n_regionkey, row_number() OVER (ORDER BY n_name) AS i FROM nation), b AS (SELECT n_nationkey, n_regionkey, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation)
SELECT count(*) AS mismatches FROM a JOIN b ON a.i = b.i WHERE a.n_regionkey IS DISTINCT FROM b.n_regionkey""")
def mismatch_count(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    a = n.select("n_name", F.col("n_regionkey").alias("ra"))
    b = n.select("n_nationkey", F.col("n_regionkey").alias("rb"))
    p = relational.pair_by_position(a, b, ["n_name"], ["n_nationkey"])
    return p.where(~F.col("ra").eqNullSafe(F.col("rb"))).agg(F.count(F.lit(1)).alias("mismatches"))


@query("SELECT doc_id, source, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10")
def longest_documents(spark, sf_dir):
    """A report of the ten longest documents."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return relational.first_rows(d, [F.desc("n_chars"), "doc_id"], 10)


@query("SELECT doc_id, lang, n_chars FROM documents")
def without_columns(spark, sf_dir):
    """Columns that are not wanted go, whether they are there or not."""
    return relational.drop_columns(table(spark, sf_dir, "documents"), "text", "source", "age", "sex")
