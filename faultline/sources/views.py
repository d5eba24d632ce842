"""Log, method and tree views over the supplied tables, stated once as SQL that both engines run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SERVICES = ["frontend", "cartservice", "checkoutservice", "paymentservice", "adservice", "redis"]
METHODS = "handleLogin parseCart checkUpstream runCheckout startWorker dumpCore callRemote openRedis authorize allocate writeLog deref applyCoupon getPage retryCall useLegacy serveProduct addItem completeRequest beat".split()
#: Message templates; in braces: V the event, U the user, W the event modulo 200, H the event in hex.
TEMPLATES = [
    "User login ok for user_id={U}",
    'Traceback (most recent call last):\n  File "/app/cart.py", line {W}, in handler\n    x()\nValueError: bad value {V}',
    "[error] upstream returned status={U}",
    "request to checkout failed after {V} ms",
    "FATAL: worker {U} aborted",
    "process crashed with core dumped at 0x{H}",
    "deadline exceeded calling 10.0.{U}.7:8080",
    "connection refused by redis at 2024-01-01 00:00:00",
    "access denied for user{U}@example.com",
    "container exited: out of memory",
    "no space left on /var/log/app/{V}.log",
    "nil pointer dereference in handler_{U}",
    'invalid coupon "ABCDEFGHIJKLMNOPQRSTUV{V}"',
    "GET /cart/{V} 404 page",
    "WARN: retrying trace_id=abc{H}",
    "deprecated API v1.2.3 used",
    "served GET https://shop.example.com/p/{V} in {U} ms",
    "java.lang.IllegalStateException: boom\n\tat shop.Cart.add(Cart.java:{W})",
    "request_id={H}-0000-4000-8000-{H}0000 completed",
    "heartbeat seq={V}",
]


def _template(text: str, spark: bool) -> str:
    kind, char = ("string", "char") if spark else ("varchar", "chr")
    values = {
        "V": f"cast(event_id as {kind})",
        "U": f"cast(user_id as {kind})",
        "W": f"cast(event_id % 200 as {kind})",
        "H": "lower(lpad(hex(event_id), 8, '0'))",
    }
    parts, rest = [], text
    while rest:
        cut = min((i for i in (rest.find(x) for x in ("{", "\n", "\t")) if i >= 0), default=len(rest))
        if cut:
            parts.append("'" + rest[:cut].replace("'", "''") + "'")
            rest = rest[cut:]
        elif rest[0] == "{":
            parts.append(values[rest[1]])
            rest = rest[3:]
        else:
            parts.append(f"{char}({ord(rest[0])})")
            rest = rest[1:]
    return " || ".join(parts)


def logs_sql(spark: bool, named: bool = False, events: str = "events") -> str:
    """row_id, timestamp, service, message. named: each message ends in the name of its method."""
    micros = "unix_micros(cast(ts as timestamp))" if spark else "epoch_us(ts)"
    service = "case user_id % 6 " + " ".join(f"when {i} then '{s}'" for i, s in enumerate(SERVICES)) + " end"
    end = "" if not named else " || ' [' || case event_id % 20 " + " ".join(f"when {k} then '{m}'" for k, m in enumerate(METHODS)) + " end || ']'"
    message = "case event_id % 20 " + " ".join(f"when {k} then {_template(t, spark)}" for k, t in enumerate(TEMPLATES)) + " end"
    return f"select event_id as row_id, cast({micros} - 1704067200000000 as double) / cast(1e8 as double) + cast(1704067200 as double) as timestamp, {service} as service, ({message}){end} as message from {events}"


def logs(spark: SparkSession, sf_dir: str, named: bool = False) -> DataFrame:
    return spark.sql(logs_sql(True, named, "{events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id"))


def _tokens(text: str) -> list[str]:
    import re

    return sorted({t for t in re.sub(r"[^a-z ]+", " ", text.lower()).split() if len(t) >= 3})


def method_rows() -> list[tuple]:
    """service, rec_idx, name, full_name, tokens, callee_names and line of the views' methods: constants."""
    import re

    rows = []
    for s, service in enumerate(SERVICES):
        own = [k for k in range(20) if k < 4 or (k + s) % 2 == 0]
        for idx, k in enumerate(own):
            callees = {
                METHODS[(3 * k + 1) % 20],
                METHODS[(7 * k + s) % 20],
            } | ({f"extCall{'abcdefghijklmnopqrst'[k]}"} if k % 5 == 0 else set()) | ({"info"} if k % 4 == 0 else set())
            rows.append((
                service,
                idx,
                METHODS[k],
                f"shop.{service}.{METHODS[k]}",
                _tokens(METHODS[k] + " " + re.sub(r"\{.\}", " ", TEMPLATES[k])),
                sorted(callees),
                str(10 * idx + s),
            ))
    return rows


def methods(spark: SparkSession) -> DataFrame:
    from ..functions.text import is_log_method

    frame = spark.createDataFrame(
        method_rows(),
        "service string, rec_idx int, name string, full_name string, tokens array<string>, callee_names array<string>, line string",
    )
    return frame.withColumn("callee_names", F.filter("callee_names", lambda x: ~is_log_method(x)))


def methods_sql() -> str:
    """The methods as a relation for DuckDB, without callees that only log."""
    array = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]::varchar[]"
    rows = ", ".join(
        f"('{s}', {i}, '{n}', '{f}', {array(t)}, {array([c for c in cs if c != 'info'])}, '{line}')" for s,
        i,
        n,
        f,
        t,
        cs,
        line in method_rows()
    )
    return f"select * from (values {rows}) as m(service, rec_idx, name, full_name, tokens, callee_names, line)"


def tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, label, name, code) and AST edges (src, dst) from region to orders."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    none = F.lit(None).cast("string")
    region, nation, customer, orders = (read(t) for t in ("region", "nation", "customer", "orders"))
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    nodes = region.select(
        key("r", "r_regionkey").alias("node_id"),
        F.lit("TYPE_DECL").alias("label"),
        F.col("r_name").alias("name"),
        none.alias("code"),
    )
    nodes = nodes.unionByName(nation.select(
        key("n", "n_nationkey").alias("node_id"),
        F.lit("METHOD").alias("label"),
        F.col("n_name").alias("name"),
        none.alias("code"),
    ))
    nodes = nodes.unionByName(customer.select(
        key("c", "c_custkey").alias("node_id"),
        F.lit("IDENTIFIER").alias("label"),
        none.alias("name"),
        F.col("c_mktsegment").alias("code"),
    ))
    nodes = nodes.unionByName(orders.select(
        key("o", "o_orderkey").alias("node_id"),
        F.lit("CALL").alias("label"),
        F.col("o_orderpriority").alias("name"),
        none.alias("code"),
    ))
    edges = nation.select(
        key("r", "n_regionkey").alias("src"),
        key("n", "n_nationkey").alias("dst"),
    ).unionAll(customer.select(key("n", "c_nationkey"), key("c", "c_custkey"))).unionAll(orders.select(key("c", "o_custkey"), key("o", "o_orderkey")))
    return nodes, edges
