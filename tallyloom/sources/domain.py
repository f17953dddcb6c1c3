"""The domain tables (transactions, parties, PII, places), read from a folder of parquet tables.

``orders_fact`` and ``events_fact`` share one contract: transaction_id, event_seq (dense 1..n by
time), unix_time, card, merchant, category, amount, is_fraud, use_chip, split_id, causal_fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FACT_COLUMNS = ("transaction_id", "event_seq", "unix_time", "card", "merchant", "category", "amount", "is_fraud", "use_chip", "split_id", "causal_fold")
TRAIN_FOLDS = 5

#: Relations that identify a party, in natural order, with the weight a shared value adds to a match.
RELATIONS = {"birthdate": 0.3, "email": 0.6, "name": 0.2, "phone": 0.5, "street_address": 0.4, "identity_document": 0.8}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_seconds(ts: str) -> Column:
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({ts} AS timestamp_ntz))")


def dense_sequence(rows: DataFrame, order: list[str], out: str = "event_seq") -> DataFrame:
    """``rows`` with ``out``, their rank 1..n by ``order`` (which must be a total order).

    Rows are range-partitioned and sorted; only one count per partition reaches the driver. The
    sorted rows are settled first, so both passes see the same partitions.
    """
    from ..operators.components import settle_table

    ordered = settle_table(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()))
    counts = sorted((r[0], r[1]) for r in ordered.groupBy("__part").count().toLocalIterator())
    before, start = 1, []
    for part, n in counts:
        start += [F.lit(part), F.lit(before)]
        before += n
    if not start:
        return ordered.withColumn(out, F.lit(1).cast("long")).drop("__part")
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.withColumn(out, (F.create_map(*start)[F.col("__part")] + within).cast("long")).drop("__part")


def with_splits(fact: DataFrame, n: int, folds: int = TRAIN_FOLDS) -> DataFrame:
    """split_id 0/1/2 for the first 60 %, next 20 % and last 20 % of event_seq; causal_fold cuts split 0 into equal folds."""
    from ..plans.builds import equal_edges

    n1, n2 = n * 6 // 10, n * 8 // 10
    seq = F.col("event_seq")
    split = F.when(seq <= n1, 0).when(seq <= n2, 1).otherwise(2)
    fold = F.lit(-1)
    for k, (lo, hi) in enumerate(zip(equal_edges(1, n1, folds)[:-1], equal_edges(1, n1, folds)[1:])):
        fold = F.when((seq >= lo) & (seq < hi), k).otherwise(fold)
    return fact.withColumn("split_id", split).withColumn("causal_fold", F.when(seq <= n1, fold).otherwise(-1))


def orders_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, orders, supplier = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "supplier"))
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    rows = dense_sequence(line, order)
    rows = rows.join(orders.select("o_orderkey", "o_custkey"), rows["l_orderkey"] == F.col("o_orderkey")).join(supplier.select("s_suppkey", "s_nationkey"), rows["l_suppkey"] == F.col("s_suppkey"))
    fact = rows.select(
        F.col("event_seq").alias("transaction_id"), "event_seq", epoch_seconds("l_shipdate").alias("unix_time"), F.col("o_custkey").alias("card"), F.col("l_suppkey").alias("merchant"), F.col("s_nationkey").cast("long").alias("category"),
        F.col("l_extendedprice").alias("amount"), (F.col("l_returnflag") == "R").cast("int").alias("is_fraud"), F.col("l_linestatus").alias("use_chip"),
    )
    return with_splits(fact, line.count())


ORDERS_SQL = """
fact0 AS (
  SELECT row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS event_seq,
    floor(epoch(l_shipdate))::BIGINT AS unix_time, o_custkey AS card, l_suppkey AS merchant, s_nationkey::BIGINT AS category, l_extendedprice AS amount, (l_returnflag = 'R')::INT AS is_fraud, l_linestatus AS use_chip
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
)"""


def event_merchant() -> Column:
    return F.regexp_extract("props", "([0-9]+)", 1).cast("long")


def event_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(card, merchant) of every event, for what needs neither order nor splits: rows are not numbered, so not sorted and stored."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("card"), event_merchant().alias("merchant"))


def events_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    rows = dense_sequence(events, ["ts", "event_id"])
    merchant = event_merchant()
    fact = rows.select(
        F.col("event_id").alias("transaction_id"), "event_seq", epoch_seconds("ts").alias("unix_time"), F.col("user_id").alias("card"), merchant.alias("merchant"), (merchant % 7).alias("category"),
        F.col("value").alias("amount"), (F.col("event_type") == "error").cast("int").alias("is_fraud"), F.col("event_type").alias("use_chip"),
    )
    return with_splits(fact, events.count())


EVENTS_SQL = """
fact0 AS (
  SELECT row_number() OVER (ORDER BY ts, event_id) AS event_seq, floor(epoch(ts))::BIGINT AS unix_time, user_id AS card,
    regexp_extract(props, '([0-9]+)', 1)::BIGINT AS merchant, regexp_extract(props, '([0-9]+)', 1)::BIGINT % 7 AS category, value AS amount, (event_type = 'error')::INT AS is_fraud, event_type AS use_chip, event_id
  FROM events
)"""

#: Adds split_id and causal_fold to fact0, and the six builds: folds 1 to 4, val, test.
SPLITS_SQL = """
size AS (SELECT count(*) AS n, count(*) * 6 // 10 AS n1, count(*) * 8 // 10 AS n2 FROM fact0),
edges AS (SELECT k, (1 + round_even(k * n1 / 5.0, 0))::BIGINT AS lo FROM size, range(0, 6) t(k)),
fact AS (
  SELECT f.*, CASE WHEN event_seq <= n1 THEN 0 WHEN event_seq <= n2 THEN 1 ELSE 2 END AS split_id,
    CASE WHEN event_seq <= n1 THEN (SELECT max(k) FROM edges WHERE lo <= event_seq AND k < 5) ELSE -1 END AS causal_fold
  FROM fact0 f, size
),
builds AS (
  SELECT 'fold_' || a.k AS build_id, a.lo AS cutoff, a.lo AS serves_from, b.lo AS serves_until FROM edges a JOIN edges b ON b.k = a.k + 1 WHERE a.k BETWEEN 1 AND 4
  UNION ALL SELECT 'val', n1 + 1, n1 + 1, n2 + 1 FROM size
  UNION ALL SELECT 'test', n2 + 1, n2 + 1, n + 1 FROM size
)"""


def party_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(party, rel, value, seq): one polymorphic edge table; seq 0 means an unknown time."""
    c = table(spark, sf_dir, "customer")
    key, balance, nation = F.col("c_custkey"), F.floor("c_acctbal"), F.col("c_nationkey").cast("string")
    value = {
        "birthdate": (key % 400).cast("string"), "email": (key % 500).cast("string"), "name": F.concat_ws("-", "c_mktsegment", nation),
        "phone": (key % 700).cast("string"), "street_address": F.concat_ws("-", nation, F.floor(F.col("c_acctbal") / 50).cast("string")), "identity_document": balance.cast("string"),
    }
    edges = F.explode(F.array(*[F.struct(F.lit(rel).alias("rel"), value[rel].alias("value"), F.lit(i).alias("i")) for i, rel in enumerate(RELATIONS)]))
    seq = F.when(key % 97 == 0, 0).otherwise(1 + (key * 37 + F.col("e.i") * 101) % 10007)
    return c.select("*", edges.alias("e")).select(key.alias("party"), "e.rel", "e.value", seq.cast("long").alias("seq"))


PII_SQL = """
pii AS (
  SELECT c_custkey AS party, rel, value, CASE WHEN c_custkey % 97 = 0 THEN 0 ELSE 1 + (c_custkey * 37 + i * 101) % 10007 END::BIGINT AS seq
  FROM (
    SELECT c_custkey, 'birthdate' AS rel, (c_custkey % 400)::VARCHAR AS value, 0 AS i FROM customer
    UNION ALL SELECT c_custkey, 'email', (c_custkey % 500)::VARCHAR, 1 FROM customer
    UNION ALL SELECT c_custkey, 'name', c_mktsegment || '-' || c_nationkey, 2 FROM customer
    UNION ALL SELECT c_custkey, 'phone', (c_custkey % 700)::VARCHAR, 3 FROM customer
    UNION ALL SELECT c_custkey, 'street_address', c_nationkey || '-' || floor(c_acctbal / 50)::BIGINT, 4 FROM customer
    UNION ALL SELECT c_custkey, 'identity_document', floor(c_acctbal)::BIGINT::VARCHAR, 5 FROM customer
  )
)"""


def party_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(party, kind, endpoint, seq, time): devices and addresses that parties have used."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    uses = F.explode(F.array(F.struct(F.lit("device").alias("kind"), (key % 211).alias("endpoint"), F.lit(3).alias("i")), F.struct(F.lit("ip").alias("kind"), (key % 307).alias("endpoint"), F.lit(5).alias("i"))))
    seq = F.when(key % 89 == 0, 0).otherwise(1 + (key * 41 + F.col("u.i")) % 10007)
    return c.select("*", uses.alias("u")).select(key.alias("party"), "u.kind", F.col("u.endpoint").alias("endpoint"), seq.cast("long").alias("seq"))


DEVICE_SQL = """
uses AS (
  SELECT c_custkey AS party, kind, endpoint, CASE WHEN c_custkey % 89 = 0 THEN 0 ELSE 1 + (c_custkey * 41 + i) % 10007 END::BIGINT AS seq
  FROM (SELECT c_custkey, 'device' AS kind, c_custkey % 211 AS endpoint, 3 AS i FROM customer UNION ALL SELECT c_custkey, 'ip', c_custkey % 307, 5 FROM customer)
)"""


def party_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(party, card): most cards have one owner; every tenth is shared with the next party."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("party"))
    own = c.select("party", F.col("party").alias("card"))
    return own.unionByName(c.where("party % 10 = 0").select((F.col("party") + 1).alias("party"), F.col("party").alias("card")))


PARTY_CARD_SQL = """
party_card AS (SELECT c_custkey AS party, c_custkey AS card FROM customer UNION ALL SELECT c_custkey + 1, c_custkey FROM customer WHERE c_custkey % 10 = 0)"""


def homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(party, zip, lat, lon, seq): two tenures each, places as affine functions of a number."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    tenure = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), ((key + 13 * i) % 90).alias("zip")) for i in (0, 1)]))
    rows = c.select(key.alias("party"), tenure.alias("t")).select("party", "t.zip", (F.col("t.zip") * 0.9 - 40.0).alias("lat"), (F.col("t.zip") * 2.1 - 100.0).alias("lon"), (1 + (F.col("party") * 29 + F.col("t.i") * 4001) % 10007).cast("long").alias("seq"))
    return rows.withColumn("lat", F.when(F.col("zip") % 11 != 0, F.col("lat"))).withColumn("lon", F.when(F.col("zip") % 11 != 0, F.col("lon")))


HOMES_SQL = """
homes AS (
  SELECT party, zip, CASE WHEN zip % 11 <> 0 THEN zip * 0.9::DOUBLE - 40 END AS lat, CASE WHEN zip % 11 <> 0 THEN zip * 2.1::DOUBLE - 100 END AS lon, (1 + (party * 29 + i * 4001) % 10007)::BIGINT AS seq
  FROM (SELECT c_custkey AS party, i, (c_custkey + 13 * i) % 90 AS zip FROM customer, range(0, 2) t(i))
),
sites AS (SELECT m AS merchant, m * 10 AS location_id, m * 0.7::DOUBLE - 30 AS lat, m * 1.3::DOUBLE - 60 AS lon FROM range(0, 100) t(m) WHERE m % 5 <> 0)"""


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(merchant, location_id, lat, lon): geocoded merchant locations; every fifth merchant has none."""
    m = F.col("merchant")
    return spark.range(100).select(F.col("id").alias("merchant")).where(m % 5 != 0).select("merchant", (m * 10).alias("location_id"), (m * 0.7 - 30.0).alias("lat"), (m * 1.3 - 60.0).alias("lon"))


def last_row_number(keys: list[str], order: list[Column]) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
