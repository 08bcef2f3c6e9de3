"""Flow, alarm, packet and explanation tables derived from the star-schema test tables.

Real deployments read their own tables through ``netweir.sources``; these adapters give
the catalog queries tables of the same shape, row for row from the given parquet files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netweir.functions import contract
from netweir.operators.alarms import raise_alarms
from netweir.session import COMPILED_METHODS

def spread(df: DataFrame) -> DataFrame:
    """Deals out the rows of a file that cannot be split, for work that is heavy per row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


T0_MICROS = 1704067200000000  # 2024-01-01, first day of the events table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    for setting, value in COMPILED_METHODS.items():
        spark.conf.set(setting, value)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lineitem table as a stream of closed files."""
    from netweir.streaming.flows import flow_stream
    return flow_stream(spark, sf_dir, table(spark, sf_dir, "lineitem").schema, "parquet", file_glob="lineitem.parquet")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of closed files."""
    from netweir.streaming.flows import flow_stream
    schema = table(spark, sf_dir, "events").schema
    return flow_stream(spark, sf_dir, schema, "parquet", file_glob="events.parquet")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_flows(table(spark, sf_dir, "events"))


def as_flows(events: DataFrame) -> DataFrame:
    """Detected flows, one per event; works on a table and on a stream."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    kind = F.col("event_type")
    label = (F.when(kind.isin("view", "click"), "BENIGN")
             .when(kind.isin("purchase", "signup"), "ATTACK").otherwise("UNKNOWN"))
    return events.select(
        F.col("event_id").alias("flow_id"),
        F.col("ts").cast("timestamp").alias("flow_ts"),
        F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")).alias("source_ip"),
        F.concat(F.lit("192.168.1."), k.cast("string")).alias("destination_ip"),
        (F.lit(1024) + F.col("user_id")).cast("int").alias("source_port"),
        k.alias("destination_port"),
        F.element_at(F.array(F.lit("6"), F.lit("17"), F.lit("1.0"), F.lit("x")),
                     (k % 4 + 1).cast("int")).alias("protocol"),
        label.alias("predicted_label"),
        F.when(kind == "purchase", "PortScan").when(kind == "signup", "DoS Hulk")
        .alias("attack_type"),
        F.when(label != "UNKNOWN", F.col("value") / (F.col("value") + 20))
        .alias("confidence"),
        F.when(label == "UNKNOWN", 20 / (F.col("value") + 20)).alias("anomaly_score"),
        F.when(label == "UNKNOWN", "ANOMALY_DETECTION").otherwise("SUPERVISED_ML")
        .alias("detection_method"),
        F.when(F.col("event_id") % 5 != 4,
               F.concat(F.lit("model-"), (F.col("event_id") % 5).cast("string")))
        .alias("model_name"),
        F.when(F.col("event_id") % 3 == 0, "PortScan").alias("truth_attack_type"),
        F.col("value"))


def alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raise_alarms(flows(spark, sf_dir))


STATUS_HISTORIES = [
    ["NEW"],
    ["NEW", "ACKNOWLEDGED"],
    ["NEW", "ACKNOWLEDGED", "CONFIRMED"],
    ["NEW", "FALSE_POSITIVE", "FALSE_POSITIVE"],
    ["NEW", "CONFIRMED", "ACKNOWLEDGED", "RESOLVED"],
]


def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyst status changes, ten minutes apart, after each alarm."""
    histories = F.array(*[F.array(*[F.lit(s) for s in h]) for h in STATUS_HISTORIES])
    history = F.element_at(histories, (F.col("alarm_id") % 5 + 1).cast("int"))
    return alarms(spark, sf_dir).select(
        "alarm_id", "created_at", F.posexplode(history).alias("step", "status")
    ).select(
        "alarm_id", "status",
        F.timestamp_micros(F.unix_micros("created_at")
                           + F.col("step").cast("long") * 600000000).alias("changed_at"),
        F.concat(F.lit("analyst-"), (F.col("alarm_id") % 3).cast("string")).alias("analyst"))


def _row_id() -> Column:
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


FEATURE_COLUMNS = ["quantity", "extendedprice", "discount", "tax"]


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows with four numeric features, a time and a unique row id."""
    return table(spark, sf_dir, "lineitem").select(
        _row_id().alias("row_id"),
        F.element_at(F.create_map(F.lit("N"), F.lit("BENIGN"), F.lit("A"), F.lit("DoS Hulk"),
                                  F.lit("R"), F.lit("PortScan")), F.col("l_returnflag"))
        .alias("label"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.concat(F.lit("day-"), F.year("l_shipdate").cast("string")).alias("source_file"),
        F.col("l_linestatus").alias("status"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("extendedprice"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))


def rare_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``features`` with a finer label, so that classes differ widely in size."""
    label = (F.when(F.col("quantity") == 50, F.concat("label", F.lit(" rare")))
             .when((F.col("quantity") > 44) & (F.col("label") == "PortScan"), "Bot")
             .when(F.col("quantity") > 40, "DDoS").when(F.col("quantity") > 12, "BENIGN")
             .otherwise(F.col("label")))
    return features(spark, sf_dir).withColumn("label", label)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True label, predicted label and score of every row."""
    q, status = F.col("quantity"), F.col("status")
    return features(spark, sf_dir).select(
        "row_id", F.col("label").alias("y_true"),
        F.when(q < 8, "BENIGN").when((q > 46) & (status == "F"), "Bot")
        .when((q >= 20) & (q <= 24), "DoS Hulk").otherwise(F.col("label")).alias("y_pred"),
        F.col("discount").alias("score"), "quantity", "tax", "status", "ts")


def live_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored flows of labelled lab runs."""
    run = F.col("l_orderkey") % 8
    scenario = (F.when(run < 3, "benign").when(run < 6, "portscan").otherwise("ssh"))
    q, flag = F.col("l_quantity"), F.col("l_returnflag")
    expected = (F.when(scenario == "benign", "BENIGN").when(flag == "N", "BENIGN")
                .when((flag == "R") & (q > 48), "UNLABELLED").otherwise("ATTACK"))
    attack = F.when(scenario == "portscan", "PortScan").otherwise("SSH-Patator")
    model_a = (F.when((expected == "ATTACK") & (q > 10),
                      F.when(F.col("l_linestatus") == "F", attack).otherwise("DoS Hulk"))
               .when((expected == "BENIGN") & (q > 47), "Bot").otherwise("BENIGN"))
    return table(spark, sf_dir, "lineitem").select(
        _row_id().alias("row_id"),
        F.concat(F.lit("run-"), run.cast("string")).alias("run_id"),
        scenario.alias("scenario"), expected.alias("expected_binary_label"),
        F.when(F.col("l_discount") >= 0.095, "MISSING_FEATURE")
        .when(F.col("l_tax") >= 0.075, "NONFINITE_VALUE").otherwise("VALID")
        .alias("validation_status"),
        model_a.alias("predicted_label"),
        (q / (q + 20)).alias("prediction_confidence"),
        ((q + F.col("l_discount") * 100) / (q + F.col("l_discount") * 100 + 25))
        .alias("model_b_score"),
        F.col("l_linenumber").cast("long").alias("flow_index"),
        (run == 7).alias("excluded"))


RAW_FEATURES = [
    "Flow Duration", "Total Fwd Packets", "Total Backward Packets",
    "Total Length of Fwd Packets", "Total Length of Bwd Packets", "Fwd Packet Length Max",
    "Fwd Packet Length Min", "Fwd Packet Length Mean", "Bwd Packet Length Max",
    "Bwd Packet Length Min", "Bwd Packet Length Mean", "Packet Length Std",
]
VALIDATED_FEATURES = RAW_FEATURES + [
    "Flow Bytes/s", "Flow Packets/s", "Down/Up Ratio", "Max Packet Length",
    "Packet Length Variance", "Bwd PSH Flags", "Fwd Avg Bulk Rate", "Average Packet Size",
]


def flow_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_vectors(spread(table(spark, sf_dir, "lineitem")))


def as_vectors(lines: DataFrame) -> DataFrame:
    """Numeric flow statistics with contract names, of a table or a stream."""
    q, price, line = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_linenumber")
    fwd, bwd = q, F.col("l_linenumber").cast("double") - 1
    return lines.select(
        _row_id().alias("row_id"), F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"),
        F.when((F.col("l_tax") == 0) & (q > 40), 0.0).otherwise(F.floor(price * 10).cast("double"))
        .alias("Flow Duration"),
        fwd.alias("Total Fwd Packets"), bwd.alias("Total Backward Packets"),
        F.floor(price / 4).cast("double").alias("Total Length of Fwd Packets"),
        (bwd * 64).alias("Total Length of Bwd Packets"),
        (q * 20).alias("Fwd Packet Length Max"), (q + 4).alias("Fwd Packet Length Min"),
        (q * 10).alias("Fwd Packet Length Mean"),
        (bwd * 32).alias("Bwd Packet Length Max"), (bwd * 8).alias("Bwd Packet Length Min"),
        (bwd * 16).alias("Bwd Packet Length Mean"),
        (q * F.lit(0.5) + line).alias("Packet Length Std"))


def raw_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_raw_features(flow_vectors(spark, sf_dir)).drop("status")


def as_raw_features(vectors: DataFrame) -> DataFrame:
    """Feature maps of texts as they arrive, with gaps, bad texts and extra names."""
    q = F.col("Total Fwd Packets")
    taken = [name for name in RAW_FEATURES if name not in ("Packet Length Std", "Bwd Packet Length Max")]
    plain = [F.struct(F.lit(name).alias("name"), F.col(f"`{name}`").cast("string").alias("raw")) for name in taken]
    std = F.struct(F.lit("Packet Length Std").alias("name"),
                   F.when(q == 3, "nan").when(q == 4, "abc").when(q == 5, " ")
                   .when(q == 6, "Infinity").when(q == 7, "1_000")
                   .otherwise(F.col("`Packet Length Std`").cast("string")).alias("raw"))
    longest = F.struct(F.lit("Bwd Packet Length Max").alias("name"),
                       F.when(q != 8, F.col("`Bwd Packet Length Max`").cast("string")).alias("raw"))
    size = F.struct(F.lit("Average Packet Size").alias("name"),
                    F.when(F.col("status") == "F", F.lit("12.5")).otherwise("1e3").alias("raw"))
    extra = F.struct(F.lit("unused_column").alias("name"), F.lit("1").alias("raw"))
    shortest = taken.index("Fwd Packet Length Min")
    entries = [*plain, std, longest, size, extra]
    entries = (F.when(q == 9, F.array(*entries[:shortest], *entries[shortest + 1:]))
               .when(q == 10, F.array(*entries[:-1])).otherwise(F.array(*entries)))
    return vectors.select("row_id", "flag", "status", F.map_from_entries(entries).alias("features"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("row_id"),
        F.concat(F.lit("class-"), F.col("label").cast("string")).alias("label"),
        F.col("embedding").cast("array<double>").alias("vector"))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_packets(table(spark, sf_dir, "events"))


def as_packets(events: DataFrame) -> DataFrame:
    """A packet per event: 48 host pairs, 30 days squeezed into some twenty minutes."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    forward = F.expr("event_id div 5 % 2") == 0
    client = F.concat(F.lit("10.1.0."), (F.col("user_id") % 12).cast("string"))
    server = F.concat(F.lit("10.2.0."), (k % 4).cast("string"))
    client_port, server_port = F.lit(40000) + F.col("user_id") % 12, F.lit(80) + k % 4
    length = (F.floor(F.col("value")) + 40).cast("long")
    return events.select(
        F.col("event_id").alias("packet_id"),
        (F.lit(T0_MICROS) + F.expr(
            f"(unix_micros(cast(ts as timestamp)) - {T0_MICROS}L) div 2000") + F.expr(
            f"(unix_micros(cast(ts as timestamp)) - {T0_MICROS}L) div 864000000000L") * 400000000)
        .alias("time_us"),
        F.when(forward, client).otherwise(server).alias("src_ip"),
        F.when(forward, server).otherwise(client).alias("dst_ip"),
        F.when(forward, client_port).otherwise(server_port).cast("int").alias("src_port"),
        F.when(forward, server_port).otherwise(client_port).cast("int").alias("dst_port"),
        F.when(F.col("event_id") % 50 == 49, 1).when(k % 4 == 3, 17).otherwise(6)
        .cast("int").alias("protocol"),
        length.alias("length"),
        F.when(F.col("event_id") % 9 == 0, 24).otherwise(20).cast("long").alias("header_bytes"),
        F.when(F.col("event_id") % 4 == 3, 0).otherwise(length - 40).cast("long")
        .alias("payload_bytes"),
        F.when(F.col("event_id") % 6 == 0, 0).otherwise(F.col("event_id") % 1000).cast("long")
        .alias("window_bytes"),
        F.when(F.col("event_type") == "view", "S").when(F.col("event_type") == "click", "PA")
        .when(F.col("event_type") == "purchase", "A").when(F.col("event_type") == "signup", "FA")
        .otherwise("UR").alias("flags"))


EVIDENCE_FEATURES = ["Flow Duration", "Total Fwd Packets", "SYN Flag Count"]


def explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated explanation texts with the evidence each was given."""
    doc = F.col("doc_id")
    decision = F.when(doc % 2 == 0, "ATTACK").otherwise("BENIGN")
    sentence = F.concat(
        F.when(doc % 2 == 0, "The traffic looks like an attack").otherwise("The traffic is normal"),
        F.when(doc % 3 == 0, ". Flow Duration is higher and points toward attack")
        .when(doc % 3 == 1, ". Flow Duration is lower").otherwise(""),
        F.when(doc % 4 < 2, F.concat(F.lit(", Total Fwd Packets of "), F.col("n_chars").cast("string"),
                                     F.lit(" increase the score"))).otherwise(""),
        F.when(doc % 5 == 0, ". HTTP on port 8080, payload unread").otherwise(""),
        F.when(doc % 7 == 0, F.concat(F.lit(". See port "), (doc % 100).cast("string"))).otherwise(""),
        F.when(doc % 2 == 0, ". Ask an analyst to verifik the feature values. ").otherwise(". "))
    signs = F.array(F.lit(1.0), F.lit(-1.0), F.lit(1.0))
    values = F.array(F.col("n_chars").cast("double"), F.col("n_chars") / 8, (doc % 100).cast("double"))
    evidence = F.transform(
        F.arrays_zip(F.array(*[F.lit(n) for n in EVIDENCE_FEATURES]).alias("feature"),
                     values.alias("value"), signs.alias("sign")),
        lambda e: F.struct(e["feature"].alias("feature"), e["value"].alias("value"),
                           (e["sign"] * (doc % 10 + 1) / 16).alias("contribution")))
    return spread(table(spark, sf_dir, "documents")).select(
        doc.alias("explanation_id"), (doc * 3).alias("alarm_id"),
        F.when(doc % 3 == 0, "claude-x").when(doc % 3 == 1, "Claude-y").otherwise("other-1")
        .alias("text_model"),
        F.when(doc % 9 == 8, F.lit(None).cast("string")).otherwise(F.concat(F.lit("prompt-"), "lang"))
        .alias("prompt_version"),
        F.when(doc % 6 != 0, F.col("n_chars").cast("double") / 4).alias("latency_ms"),
        F.when(doc % 4 == 1, "USEFUL").when(doc % 4 == 2, "WRONG").alias("rating"),
        decision.alias("decision"), (doc % 50 / 64).alias("confidence"), evidence.alias("evidence"),
        F.when(doc % 8 < 6, "with_evidence").otherwise("without_evidence").alias("condition"),
        F.concat(sentence, F.col("text")).alias("text"))


def dirty_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates with infinite, NaN and null values, a constant and a nearly constant column."""
    q, price = F.col("quantity"), F.col("extendedprice")
    infinite, nan = F.lit(float("inf")), F.lit(float("nan"))
    return spread(features(spark, sf_dir)).select(
        "row_id", F.concat(F.lit(" "), F.replace("label", F.lit("DoS Hulk"), F.lit("Web Attack \x96 XSS")))
        .alias("Label"),
        F.when((F.col("discount") == 0) & (q > 25), infinite).when((F.col("tax") == 0) & (q < 3), nan)
        .otherwise(price / (q * 100)).alias("Flow Bytes/s"),
        F.when((F.col("tax") == 0) & (q > 48), -infinite).when(q != 7, q - 10).alias("Flow Packets/s"),
        (price / 64).alias("Flow Duration"), F.lit(0.0).alias("Bwd PSH Flags"),
        F.when((q == 50) & (F.col("discount") < 0.03), 1.0).otherwise(0.0).alias("ECE Flag Count"))


def clock_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times as ``d/m/yyyy h:MM[:SS]`` on a 12-hour clock."""
    ts = F.col("ts").cast("timestamp")
    hour = F.when(F.hour(ts) % 12 == 0, 12).otherwise(F.hour(ts) % 12)
    text = F.concat(F.day(ts).cast("string"), F.lit("/"), F.month(ts).cast("string"), F.lit("/"),
                    F.year(ts).cast("string"), F.lit(" "), hour.cast("string"), F.lit(":"),
                    F.date_format(ts, "mm"),
                    F.when(F.col("event_id") % 2 == 0, F.date_format(ts, ":ss")).otherwise(""))
    return table(spark, sf_dir, "events").select("event_id", text.alias("text"))


def time_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times as text in every form a capture may use, junk included."""
    ts = F.col("ts").cast("timestamp")
    kind = F.col("event_id") % 10
    text = (F.when(kind == 0, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
            .when(kind == 1, F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("+02:00")))
            .when(kind == 2, F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
            .when(kind == 3, F.date_format(ts, "dd/MM/yyyy HH:mm:ss"))
            .when(kind == 4, F.date_format(ts, "d/M/yyyy H:mm"))
            .when(kind == 5, F.date_format(ts, "yyyy/MM/dd HH:mm:ss"))
            .when(kind == 6, F.unix_seconds(ts).cast("string"))
            .when(kind == 7, F.concat(F.lit("  "), F.date_format(ts, "yyyy-MM-dd"), F.lit(" ")))
            .when(kind == 8, "not a time"))
    return table(spark, sf_dir, "events").select("event_id", ts.alias("ingested_at"), text.alias("text"))


def capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A capture table: texts under capture names, some columns absent."""
    name_of = {v: k for k, v in contract.CAPTURE_TO_CONTRACT.items()}
    v = flow_vectors(spark, sf_dir)
    q = F.col("Total Fwd Packets")
    columns = []
    for name in RAW_FEATURES:
        text = F.col(f"`{name}`").cast("string")
        if name == "Packet Length Std":
            text = F.when(q == 3, "nan").when(q == 4, "x").when(q == 5, "").when(q == 6, "-inf").otherwise(text)
        if name == "Bwd Packet Length Min":
            text = F.when(q == 8, F.lit(None).cast("string")).when(q > 30, F.concat(F.lit("-"), text)).otherwise(text)
        columns.append(text.alias(name_of[name]))
    return v.select("row_id", F.lit("10.0.0.1").alias("src_ip"), *columns,
                    F.lit("7").alias("bwd_psh_flags"), F.lit("unused").alias("comment"))
