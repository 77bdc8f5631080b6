"""The given tables seen as this engine's inputs: message log, graph, tasks, facts, documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.session import checkpointed, settled

MICROS_2024 = 1704067200000000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; times without a zone are read as instants in the session zone."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes])


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly. The given tables come as single files, which a scan reads in one task; operators never do this."""
    return df if df.isStreaming else df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def stored(df: DataFrame) -> DataFrame:
    """A derived table as a stored one, as a graph's tables are: written once, then only scanned."""
    return checkpointed(df)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as a message log; gaps inside a session grow by a minute per turn."""
    return spread(table(spark, sf_dir, "conversations")).select(
        F.expr("conv_id * 1000 + turn + 1").alias("id"),
        F.expr("lpad(cast(conv_id AS string), 26, '0')").alias("session_id"),
        F.expr(f"timestamp_micros({MICROS_2024} + conv_id * 3600000000 + (turn * (turn + 1) div 2) * 60000000)").alias("ts"),
        "role",
        F.col("text").alias("content"),
        F.expr("role = 'assistant' AND turn % 4 = 3").alias("is_summary"),
        F.lit(None).cast("string").alias("tool_call_id"),
        F.lit(None).cast("string").alias("tool_calls_json"),
    )


def document_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as one-message sessions per source: long texts for the text functions."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")


def tool_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as assistant rows that call tools, line items as the tool rows that answer some of them.

    Every fifth answer has no id, every seventh is missing, every eleventh carries a stray id.
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    calls = (
        li.groupBy("l_orderkey", "l_linenumber")
        .agg(F.max("l_partkey").alias("p"))
        .groupBy("l_orderkey")
        .agg(F.array_sort(F.collect_list("l_linenumber")).alias("n"))  # a line number is 1..7
    )
    heads = o.join(calls, o.o_orderkey == calls.l_orderkey, "left").select(
        F.expr("o_orderkey * 16").alias("id"),
        F.col("o_custkey").cast("string").alias("session_id"),
        F.lit("assistant").alias("role"),
        F.expr("concat('order ', o_orderkey)").alias("content"),
        F.lit(None).cast("string").alias("tool_call_id"),
        F.expr(
            "CASE WHEN n IS NOT NULL THEN concat('[', array_join(transform(n, x -> concat('{\"id\":\"c', o_orderkey, '_', x, "
            "'\",\"type\":\"function\",\"function\":{\"name\":\"action\",\"arguments\":\"{}\"}}')), ','), ']') END"
        ).alias("tool_calls_json"),
    )
    answers = (
        li.groupBy("l_orderkey", "l_linenumber")
        .agg(F.max("l_partkey").alias("p"))
        .join(o, F.col("l_orderkey") == o.o_orderkey)
        .where("(l_orderkey + l_linenumber) % 7 <> 0")
        .select(
            F.expr("l_orderkey * 16 + l_linenumber").alias("id"),
            F.col("o_custkey").cast("string").alias("session_id"),
            F.lit("tool").alias("role"),
            F.expr("concat('part ', p)").alias("content"),
            F.expr(
                "CASE WHEN (l_orderkey + l_linenumber) % 5 = 0 THEN NULL WHEN (l_orderkey + l_linenumber) % 11 = 0 "
                "THEN 'stray' ELSE concat('c', l_orderkey, '_', l_linenumber) END"
            ).alias("tool_call_id"),
            F.lit(None).cast("string").alias("tool_calls_json"),
        )
    )
    return heads.unionByName(answers)


def nodes(spark: SparkSession, sf_dir: str, with_age: bool = True) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    c = t("customer").selectExpr(
        "concat('n_c', c_custkey) AS id", "'Person' AS type", "c_name AS title", "CASE WHEN c_acctbal > 0 THEN 0.8D ELSE 0.3D END AS confidence"
    )
    s = t("supplier").selectExpr("concat('n_s', s_suppkey) AS id", "'Company' AS type", "s_name AS title", "0.7D AS confidence")
    p = t("part").selectExpr("concat('n_p', p_partkey) AS id", "'Product' AS type", "p_name AS title", "0.6D AS confidence")
    n = t("nation").selectExpr("concat('n_n', n_nationkey) AS id", "'Location' AS type", "n_name AS title", "0.9D AS confidence")
    out = c.union(s).union(p).union(n)
    if with_age:
        last = t("orders").groupBy(F.expr("concat('n_c', o_custkey)").alias("id")).agg(F.max("o_orderdate").alias("updated_ts"))
        out = out.join(last, "id", "left")
    return out.withColumn("status", F.expr("CASE WHEN confidence >= 0.8 THEN 'promoted' ELSE 'provisional' END"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    c = t("customer").selectExpr("concat('n_c', c_custkey) AS src_id", "concat('n_n', c_nationkey) AS dst_id", "'member_of' AS type", "0.7D AS weight")
    s = t("supplier").selectExpr("concat('n_s', s_suppkey) AS src_id", "concat('n_n', s_nationkey) AS dst_id", "'member_of' AS type", "0.7D AS weight")
    b = (
        t("orders").select("o_orderkey", "o_custkey")
        .join(t("lineitem").select("l_orderkey", "l_partkey"), F.expr("l_orderkey = o_orderkey"))
        .groupBy("o_custkey", "l_partkey")
        .agg(F.count(F.lit(1)).alias("n"))
        .selectExpr("concat('n_c', o_custkey) AS src_id", "concat('n_p', l_partkey) AS dst_id", "'related_to' AS type",
                    "CASE WHEN n >= 10 THEN 1.0D ELSE n / 10.0D END AS weight")
    )
    return c.union(s).union(b)


def _with_id(edges: DataFrame) -> DataFrame:
    return edges.withColumn("id", F.expr("concat('e_', substr(md5(concat_ws('|', src_id, type, dst_id)), 1, 26))"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_id(_edges(spark, sf_dir))


def stored_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges as a stored table. Their ids, hashes of the other columns, are the larger part of it: a scan makes them where it reads them."""
    return _with_id(settled(_edges(spark, sf_dir)))


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every title, and each word of a part name."""
    from palimpsest.functions.text import alias_key

    ns = nodes(spark, sf_dir, with_age=False)
    whole = ns.select(F.col("id").alias("node_id"), F.col("title").alias("alias"), F.lit("seed").alias("source"), F.lit(1.0).alias("weight"))
    words = (
        ns.where("type = 'Product'")
        .select(F.col("id").alias("node_id"), F.explode(F.array_distinct(F.split("title", " "))).alias("alias"))
        .select("node_id", "alias", F.lit("span").alias("source"), F.lit(0.5).alias("weight"))
    )
    return (
        whole.union(words)
        .withColumn("id", F.expr("concat('a_', substr(md5(concat_ws('|', node_id, alias, source)), 1, 26))"))
        .withColumn("alias_key", alias_key("alias"))
        .withColumn("created_ts", F.timestamp_seconds(F.length("alias")))
    )


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.expr("concat('v_', o_orderkey)").alias("id"),
        F.lit("node").alias("subject_kind"),
        F.expr("concat('n_c', o_custkey)").alias("subject_id"),
        F.col("o_orderkey").alias("msg_id"),
        F.lit(None).cast("string").alias("span_json"),
        F.col("o_orderdate").alias("created_ts"),
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as task rows per owner; ``seq`` is the order in which they were written."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("owner"),
        F.col("o_orderkey").alias("seq"),
        F.expr("concat('Order ', o_orderkey % 97)").alias("name"),
        F.expr("lower(substr(o_orderpriority, 3))").alias("importance"),
        F.lit(None).cast("array<string>").alias("tags"),
        F.expr("CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE date_format(o_orderdate, 'yyyy-MM-dd') END").alias("date"),
        F.expr("CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat(lpad(cast(o_orderkey % 24 AS string), 2, '0'), ':00') END").alias("start"),
        F.lit(None).cast("string").alias("end"),
        F.expr("array(concat('status ', o_orderstatus))").alias("updates"),
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as categorised facts of a user; ``pos`` is the order of writing."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("owner"),
        F.col("event_type").alias("key"),
        F.expr("concat('k', get_json_object(props, '$.k'))").alias("fact"),
        F.col("event_id").alias("pos"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("embedding").alias("vector"),
        F.expr(f"timestamp_micros({MICROS_2024} + vec_id * 3600000000)").alias("start_ts"),
        F.expr("md5(cast(label AS string))").alias("hash"),
        F.expr("concat('chunk ', vec_id)").alias("chunk_text"),
        F.expr("cast(label AS long)").alias("label"),
    )


def reply_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant replies with action blocks, one per order, over every intent and error case."""
    pay = (
        "CASE o_orderkey % 9 "
        "WHEN 0 THEN concat('~~~action\\n{\"intent\":\"create_task\",\"args\":{\"name\":\"', name, '\",\"date\":\"', d, '\",\"importance\":\"', imp, '\"}}\\n~~~') "
        "WHEN 1 THEN concat('~~~action\\n{\"intent\":\"update_task\",\"args\":{\"name\":\"', name, '\",\"updates\":[\"seen ', o_orderkey % 5, '\"]}}\\n~~~') "
        "WHEN 2 THEN concat('~~~action\\n{\"intent\":\"delete_task\",\"args\":{\"name\":\"', name, '\",\"date\":\"', d, '\"}}\\n~~~') "
        "WHEN 3 THEN concat('~~~action {\"intent\":\"finish_task\",\"args\":{\"name\":\"', name, '\",}} ~~~') "
        "WHEN 4 THEN concat('~~~memory\\n{\"op\":\"upsert\",\"fact\":\"likes ', o_orderkey % 13, '\",\"key\":\"K', o_orderkey % 3, '\"}\\n~~~ done') "
        "WHEN 5 THEN concat('~~~memory\\n{\"op\":\"delete\",\"fact\":\"likes ', o_orderkey % 13, '\",\"key\":\"', CASE WHEN o_orderkey % 2 = 0 THEN '*' ELSE concat('K', o_orderkey % 3) END, '\"}\\n~~~') "
        "WHEN 6 THEN concat('~~~interest\\n{\"topics\":[\"', imp, '\",\"b\",\"c\",\"d\",\"e\"],\"reason\":\"r', o_orderkey % 4, '\",\"confidence\":', CASE WHEN o_orderkey % 2 = 0 THEN '1.5' ELSE '0.4' END, '}\\n~~~ ~~~Other {\"a\":1} ~~~') "
        "WHEN 7 THEN '~~~action {oops} ~~~ and ~~~debug {\"op\":\"on\"} ~~~' "
        "ELSE 'no block here' END"
    )
    return (
        spread(table(spark, sf_dir, "orders"))
        .selectExpr(
            "o_orderkey", "o_custkey AS owner", "concat('Order ', o_orderkey % 97) AS name", "date_format(o_orderdate, 'yyyy-MM-dd') AS d",
            "lower(substr(o_orderpriority, 3)) AS imp",
        )
        .selectExpr("o_orderkey AS id", "owner", f"concat('Noted ', o_orderkey, '. ', {pay}) AS text")
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One detection JSON per order: a task, a project, a time and a person, with slots."""
    return detections_of(spread(table(spark, sf_dir, "orders")), table(spark, sf_dir, "customer"))


def detections_of(orders: DataFrame, customers: DataFrame) -> DataFrame:
    return (
        orders.join(customers.select("c_custkey", "c_name", "c_mktsegment"), F.expr("c_custkey = o_custkey"))
        .selectExpr(
            "o_orderkey AS msg_id",
            "cast(o_custkey AS string) AS session_id",
            "concat('{\"intent\":{\"label\":\"', CASE WHEN o_orderkey % 5 = 0 THEN 'made_up' ELSE 'plan' END, '\",\"score\":0.', 100 + o_orderkey % 900, '},\"entities\":["
            "{\"type\":\"Task\",\"text\":\"Order ', o_orderkey % 97, '\",\"norm\":\"Order ', o_orderkey % 97, '\",\"span\":[0,', 6 + o_orderkey % 3, '],\"attrs\":{\"status_hint\":\"todo\",\"extra\":\"x\"},\"score\":0.', 30 + o_orderkey % 60, '},"
            "{\"type\":\"Project\",\"text\":\"', c_mktsegment, '\",\"norm\":\"', c_mktsegment, '\",\"span\":[8,12],\"attrs\":{},\"score\":0.8},"
            "{\"type\":\"Person\",\"text\":\"', c_name, '\",\"norm\":\"', c_name, '\",\"span\":[13],\"attrs\":{\"role\":\"r\"},\"score\":0.9},"
            "{\"type\":\"Planet\",\"text\":\"Mars\",\"norm\":\"Mars\",\"span\":[1,2],\"attrs\":{},\"score\":0.9},"
            "{\"type\":\"Time\",\"text\":\"then\",\"norm\":\"', date_format(o_orderdate, 'yyyy-MM-dd'), '\",\"span\":[20,24],\"attrs\":{\"iso\":\"', date_format(o_orderdate, 'yyyy-MM-dd'), '\",\"grain\":\"day\"},\"score\":0.8}],"
            "\"slots\":{', CASE WHEN o_orderkey % 2 = 0 THEN concat('\"deadline\":\"', date_format(o_orderdate, 'yyyy-MM-dd'), '\",') ELSE '' END, '\"mood\":\"ok\",\"priority\":\"high\"}}') AS det_json",
        )
    )


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders told as short notes with dates, amounts, names, quotes and wishes."""
    iso = "concat(year(o_orderdate) + 30, date_format(o_orderdate, '-MM-dd'))"
    text = (
        f"CASE o_orderkey % 6 WHEN 0 THEN concat('Please finish \"Order ', o_orderkey % 97, '\" by ', {iso}, ' or 3/14.') "
        "WHEN 1 THEN concat('need ', o_orderkey % 50, 'GB and ', o_orderkey % 7, '.5 kg in ', o_orderkey % 9, ' hours; not today') "
        "WHEN 2 THEN concat('Meet John Smith on monday at ', o_orderkey % 12, 'pm, who knows') "
        "WHEN 3 THEN concat('I prefer ', lower(substr(o_orderpriority, 3))) "
        "WHEN 4 THEN 'schedule a call next week with Mary Ann Jones' "
        "ELSE \"finsh 'Pici' tmr, don't wait\" END"
    )
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "cast(o_custkey AS string) AS session_id", f"{text} AS text")
